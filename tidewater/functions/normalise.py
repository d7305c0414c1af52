"""Row-level rules for prices, symbols, dates, filings and payloads, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Venue suffixes of two data vendors, broker suffixes, titles, order states, kinds, quote units, warrants, secret keys.
SUFFIXES = {
    "XLON": ".L", "XETR": ".DE", "XPAR": ".PA", "XAMS": ".AS", "XMIL": ".MI", "XMAD": ".MC", "XSWX": ".SW", "XSTO": ".ST",
    "XHEL": ".HE", "XCSE": ".CO", "XOSL": ".OL", "XDUB": ".IR", "XLIS": ".LS", "XBRU": ".BR", "XWBO": ".VI", "XWAR": ".WA",
}
US_VENUES = ("XNAS", "XNYS", "ARCX", "BATS")
CODES = {
    "XNAS": "US", "XNYS": "US", "ARCX": "US", "BATS": "US", "XLON": "LSE", "XETR": "XETRA", "XPAR": "PA", "XAMS": "AS", "XBRU": "BR", "XMIL": "MI",
    "XMAD": "MC", "XSWX": "SW", "XWBO": "VI", "XLIS": "LS", "XDUB": "IR", "XSTO": "ST", "XHEL": "HE", "XCSE": "CO", "XOSL": "OL", "XWAR": "WAR",
}
BROKER_SUFFIXES = {"l_EQ": "XLON", "_US_EQ": "XNAS", "d_EQ": "XETR", "p_EQ": "XPAR", "a_EQ": "XAMS", "m_EQ": "XMIL", "e_EQ": "XMAD", "s_EQ": "XSWX", "_SW_EQ": "XSWX"}
CHIEFS = ("ceo", "cfo", "cto", "coo", "cio", "cmo", "clo", "cao", "chro", "ciso", "cro", "cco", "cdo")
TITLE_CHIEF, TITLE_PRESIDENT, TITLE_VICE = r"(?i)chief[a-z &.,/()-]*officer", r"(?i)\bpresident\b", r"(?i)vice[ -]president|\b[esv]vp\b"
ORDER_STATES = {
    "LOCAL": "pending", "UNCONFIRMED": "pending", "NEW": "submitted", "CONFIRMED": "submitted", "SUBMITTED": "submitted", "REPLACING": "submitted", "REPLACED": "submitted",
    "CANCELLING": "submitted", "PARTIALLY_FILLED": "partially_filled", "FILLED": "filled", "CANCELLED": "cancelled", "REJECTED": "rejected", "EXPIRED": "expired",
}
TERMINAL_STATES = ("filled", "cancelled", "rejected", "expired")
KINDS = {
    "STOCK": "stock", "REIT": "stock", "ETF": "etf", "ETC": "etc", "TRUST": "trust", "CORPACT": "unknown", "CRYPTOCURRENCY": "unknown", "CVR": "unknown", "FOREX": "unknown",
    "FUTURES": "unknown", "INDEX": "unknown", "WARRANT": "unknown",
}
PENCE, UNITS = ("GBp", "GBX", "GBp "), ("GBP", "GBX", "USD", "EUR", "CHF", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF")
WARRANTS, SEPARATORS = ("_RGT", "_RTS", "_WAR"), "_/-"
SECRET_KEYS = ("api_key", "apikey", "authorization", "password", "secret", "token", "session_token", "private_key", "encrypted_api_key")
REDACTED, REDACTION_DEPTH = "[redacted]", 6
LINK = r"\[([^\]]*)\]\([^)]*\)"


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(known, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def bar_stamp(raw: Column, interval: Column) -> Column:
    """Daily and weekly bars keep the exchange's calendar date at midnight; intraday ones convert to UTC."""
    return F.when(interval.isin("1d", "1w"), F.try_to_timestamp(F.substring(raw, 1, 10))).otherwise(F.try_to_timestamp(raw))


def number(raw: Column) -> Column:
    """A finite number, or NULL for text, NaN and infinity."""
    x = raw.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def normalise_price(price: Column, unit: Column) -> Column:
    """Pence become pounds; applying it twice divides twice."""
    return F.when(unit == "GBX", price / 100).otherwise(price)


def infer_unit(symbol: Column, currency: Column) -> Column:
    """The currency decides where it is a known unit, then a London symbol (pence); dollars otherwise."""
    said = F.upper(currency)
    return F.when(currency.isin(*PENCE), "GBX").when(said.isin(*UNITS), said).when(F.upper(symbol).endswith(".L"), "GBX").otherwise("USD")


def major_unit(unit: Column) -> Column:
    return F.when(unit == "GBX", "GBP").otherwise(unit)


def settlement_currency(currency: Column) -> Column:
    return F.when(currency == "GBX", "GBP").otherwise(F.coalesce(currency, F.lit("USD")))


def ticker(raw: Column) -> Column:
    """Upper case, separators as dashes, none at the end; NULL for warrants and rights, and where nothing is left."""
    t = F.upper(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    right = F.lit(False)
    for mark in WARRANTS:
        right = right | F.contains(t, F.lit(mark))
    bare = F.translate(F.regexp_replace(t, f"[{SEPARATORS}]+$", ""), "/_", "--")
    return F.when(~right & (bare != ""), bare)


def vendor_symbol(tick: Column, venue: Column) -> Column:
    return F.when(venue.isin(*US_VENUES), tick).otherwise(F.concat(tick, lookup(SUFFIXES, venue)))


def second_vendor_symbol(tick: Column, venue: Column) -> Column:
    return F.concat(tick, F.lit("."), lookup(CODES, venue))


def broker_venue(code: Column) -> Column:
    """The longest suffix that matches decides."""
    out = F
    for s in sorted(BROKER_SUFFIXES, key=lambda x: (-len(x), x)):
        out = out.when(code.endswith(s), BROKER_SUFFIXES[s])
    return out


def broker_bare(code: Column) -> Column:
    out = F
    for s in sorted(BROKER_SUFFIXES, key=lambda x: (-len(x), x)):
        out = out.when(code.endswith(s), F.substring(code, F.lit(1), F.length(code) - len(s)))
    return out.otherwise(F.substring_index(code, "_", 1))


def is_c_suite(title: Column) -> Column:
    """A chief officer by words or initials, or a president; vice presidents are neither."""
    chief = title.rlike(TITLE_CHIEF) | title.rlike(rf"(?i)\b({'|'.join(CHIEFS)})\b")
    return F.coalesce(chief | (title.rlike(TITLE_PRESIDENT) & ~title.rlike(TITLE_VICE)), F.lit(False))


def accession(url: Column) -> Column:
    digits = F.regexp_extract(url, r"(\d{10})-?(\d{2})-?(\d{6})", 0)
    dashed = F.regexp_replace(digits, r"^(\d{10})-?(\d{2})-?(\d{6})$", "$1-$2-$3")
    return F.when(digits != "", dashed).otherwise(F.right(url, F.lit(32)))


def unescape(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def masked(account: Column) -> Column:
    return F.when(F.length(account) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(account, F.lit(4))))


def redact(value: Column, kind: DataType, depth: int = 0) -> Column:
    """A payload of type ``kind`` with the values of secret keys, whatever their case, replaced.

    Looks into fields, maps and lists down to REDACTION_DEPTH. A secret value that is no text becomes
    NULL, as a column has one type; without a secret below, a value stays as it is.
    """
    if depth > REDACTION_DEPTH:
        return value
    mark = lambda t: F.lit(REDACTED) if isinstance(t, StringType) else F.lit(None).cast(t)
    if isinstance(kind, StructType):
        own = [mark(f.dataType) if f.name.lower() in SECRET_KEYS else redact(value[f.name], f.dataType, depth + 1) for f in kind]
        return F.when(value.isNotNull(), F.struct(*[c.alias(f.name) for c, f in zip(own, kind, strict=True)]))
    if isinstance(kind, MapType):
        secret = lambda k: F.lower(k.cast("string")).isin(*SECRET_KEYS)
        return F.transform_values(value, lambda k, v: F.when(secret(k), mark(kind.valueType)).otherwise(redact(v, kind.valueType, depth + 1)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact(x, kind.elementType, depth + 1))
    return value


def json_safe(metrics: Column, digits: int = 6) -> Column:
    return F.transform_values(metrics, lambda _, v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.round(v, digits)))


def known_fields(*cols: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0))


def order_problem(kind: Column, quantity: Column, limit_price: Column, stop_price: Column) -> Column:
    """NULL for a valid order, else why it is not."""
    return (
        F.when(~(quantity > 0) | quantity.isNull(), "quantity must be positive")
        .when(kind.isin("limit", "stop_limit") & limit_price.isNull(), "limit price required")
        .when(kind.isin("stop", "stop_limit") & stop_price.isNull(), "stop price required")
    )


def any_of(values: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(values.isin(*allowed), F.lit(False))


def signed_percent(x: Column) -> Column:
    return F.format_string("%+.1f%%", x * 100)
