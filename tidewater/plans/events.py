"""Queries over event logs that state is folded from: halts, reconciliation, watchlists, the audit chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, lifecycle
from ..sources import fixtures as fx
from ..sources.fixtures import with_tables
from . import catalogue

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# --- halts ------------------------------------------------------------------------------------------------

#: A log of halt events: one in ten ends a kind, two end one halt, the others begin one; a third of these by a user.
_LOG = """h AS (SELECT event_id, ts, CASE event_id % 10 WHEN 0 THEN 'clear_kind' WHEN 1 THEN 'clear' WHEN 2 THEN 'clear' ELSE 'activate' END AS action, event_type AS kind,
                CASE WHEN event_id // 10 % 20 = 0 THEN 'global' WHEN event_id // 10 % 20 <= 5 THEN 'strategy' ELSE 'instrument' END AS scope,
                CASE WHEN event_id // 10 % 20 > 5 THEN user_id % 97 END AS instrument_id, CASE WHEN event_id // 10 % 20 BETWEEN 1 AND 5 THEN 's' || user_id % 7 END AS strategy,
                'event ' || event_id AS reason, CASE WHEN event_id % 3 = 0 THEN user_id END AS by_user FROM events)"""
#: Each halt stepped through its own events and those that end its kind, one after the other.
_STEPS = f"""WITH RECURSIVE {_LOG},
    k AS (SELECT DISTINCT kind, scope, instrument_id FROM h WHERE action <> 'clear_kind'),
    e AS MATERIALIZED (SELECT k.kind, k.scope, k.instrument_id, coalesce(k.instrument_id, -1) AS target, action, strategy, reason, by_user, ts, row_number() OVER (PARTITION BY k.kind, k.scope, k.instrument_id ORDER BY ts, event_id) AS n
          FROM k JOIN h ON h.kind = k.kind AND (action = 'clear_kind' OR (h.scope = k.scope AND h.instrument_id IS NOT DISTINCT FROM k.instrument_id))),
    s AS (SELECT kind, scope, instrument_id, target, 0::BIGINT AS n, NULL::TIMESTAMP AS since, NULL::VARCHAR AS strategy, NULL::VARCHAR AS reason, NULL::BIGINT AS by_user, NULL::TIMESTAMP AS ended, NULL::VARCHAR AS how FROM e WHERE n = 1
          UNION ALL
          SELECT e.kind, e.scope, e.instrument_id, e.target, e.n, CASE WHEN s.ended IS NOT NULL OR s.since IS NULL THEN CASE WHEN e.action = 'activate' THEN e.ts END ELSE s.since END,
                 CASE WHEN s.ended IS NOT NULL OR s.since IS NULL THEN e.strategy ELSE s.strategy END, CASE WHEN s.ended IS NOT NULL OR s.since IS NULL THEN e.reason ELSE s.reason END,
                 CASE WHEN s.ended IS NOT NULL OR s.since IS NULL THEN e.by_user ELSE s.by_user END,
                 CASE WHEN s.ended IS NULL AND s.since IS NOT NULL AND (e.action = 'clear' OR (e.action = 'clear_kind' AND s.by_user IS NULL)) THEN e.ts END, e.action
          FROM s JOIN e ON e.kind = s.kind AND e.scope = s.scope AND e.target = s.target AND e.n = s.n + 1),
    p AS (SELECT kind, scope, instrument_id, strategy, reason, by_user, since AS activated_at, max(ended) AS cleared_at, max(how) FILTER (ended IS NOT NULL) AS cleared_by FROM s WHERE since IS NOT NULL GROUP BY ALL)"""


def halt_log(spark, d):
    e, k = fx.read(spark, d, "events"), F.col("event_id")
    act = F.when(k % 10 == 0, "clear_kind").when(k % 10 <= 2, "clear").otherwise("activate")
    place = F.floor(k / 10) % 20
    scope = F.when(place == 0, "global").when(place <= 5, "strategy").otherwise("instrument")
    strategy = F.when((place > 0) & (place <= 5), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")))
    return e.select(
        k, "ts", act.alias("action"), F.col("event_type").alias("kind"), scope.alias("scope"), F.when(place > 5, F.col("user_id") % 97).alias("instrument_id"), strategy.alias("strategy"),
        F.concat(F.lit("event "), k.cast("string")).alias("reason"), F.when(k % 3 == 0, F.col("user_id")).alias("by_user"),
    )


@query("st10_halt_periods", _STEPS + " SELECT * FROM p")
def _(spark, d):
    return lifecycle.halt_periods(halt_log(spark, d))


@query("st10_halt_state", _STEPS + " SELECT kind, scope, instrument_id, reason, activated_at FROM p WHERE cleared_at IS NULL")
def _(spark, d):
    return lifecycle.halt_periods(halt_log(spark, d)).where("cleared_at IS NULL").select("kind", "scope", "instrument_id", "reason", "activated_at")


@query("p8_blocking_halts", _STEPS + """, t AS (SELECT DISTINCT date_trunc('day', ts) AS asked FROM events), a AS (SELECT * FROM p JOIN t ON activated_at <= asked AND (cleared_at IS NULL OR cleared_at > asked) WHERE scope <> 'strategy')
    SELECT asked AS "at", s_suppkey AS instrument_id, coalesce(min(kind) FILTER (scope = 'global'), min(kind)) AS kind, CASE WHEN bool_or(scope = 'global') THEN 'global' ELSE 'instrument' END AS scope
    FROM a JOIN supplier ON scope = 'global' OR instrument_id = s_suppkey GROUP BY asked, s_suppkey""")
def _(spark, d):
    times = fx.read(spark, d, "events").select(F.date_trunc("day", "ts").alias("at")).distinct()
    return lifecycle.blocking_halts(lifecycle.halts_at(lifecycle.halt_periods(halt_log(spark, d)), times), fx.instruments(spark, d))


@query("st12_reconcile_halts", with_tables("intents") + """, q AS (SELECT intent_id FROM intents WHERE status = 'SUBMITTED' AND intent_id NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT intent_id FROM intents WHERE status = 'RECONCILED' AND fill_price IS NULL),
    r AS (SELECT created_at AS ts, account % 3 AS broker, count(q.intent_id) AS discrepancies FROM intents LEFT JOIN q USING (intent_id) GROUP BY ALL),
    o AS (SELECT *, discrepancies = 0 AS clean, lag(discrepancies = 0, 1, true) OVER (ORDER BY ts, broker) AS was_clean, min(ts) FILTER (discrepancies = 0) OVER (ORDER BY ts, broker ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_clean FROM r)
    SELECT 'broker ' || broker || ': ' || discrepancies || ' discrepancies' AS reason, ts AS activated_at, next_clean AS cleared_at FROM o WHERE NOT clean AND was_clean""")
def _(spark, d):
    problems = catalogue.QUERIES["j13_reconciliation"](spark, d).select("intent_id", F.lit(1).alias("problem"))
    intents = fx.intents(spark, d).join(problems, "intent_id", "left")
    runs = intents.groupBy(F.col("created_at").alias("ts"), (F.col("account") % 3).alias("n")).agg(F.count("problem").alias("discrepancies"))
    runs = runs.select("ts", (F.unix_date(F.to_date("ts")) * 3 + F.col("n")).alias("run_id"), F.concat(F.lit("broker "), F.col("n").cast("string")).alias("broker"), "discrepancies")
    events = lifecycle.reconciliation_events(runs.unionByName(runs))  # told twice: what a replay does
    return lifecycle.halt_periods(events).select("reason", "activated_at", "cleared_at")


# --- watchlists -------------------------------------------------------------------------------------------


@query("st17_watchlist_membership", with_tables("candles") + """, w AS (SELECT o_custkey % 100 AS list_id, o_orderkey % 97 AS instrument_id, o_orderkey AS event_id, o_orderdate AS ts, o_orderstatus <> 'F' AS adds, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 2 = 0 THEN 'note ' || o_orderkey END AS note FROM orders),
    g AS (SELECT *, coalesce(sum((NOT adds)::INT) OVER (PARTITION BY list_id, instrument_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS later FROM w),
    m AS (SELECT list_id, instrument_id, min(row(ts, event_id)) AS f, arg_max(note, row(ts, event_id)) FILTER (note IS NOT NULL) AS note FROM g WHERE later = 0 GROUP BY ALL)
    SELECT list_id, (row_number() OVER (PARTITION BY list_id ORDER BY f))::INTEGER AS place, instrument_id, f[1] AS pinned_at, note, instrument_id IN (SELECT instrument_id FROM candles GROUP BY 1 HAVING count(*) >= 30) AS scannable FROM m""")
def _(spark, d):
    k = F.col("o_orderkey")
    add = F.col("o_orderstatus") != "F"
    note = F.when(add & (k % 2 == 0), F.concat(F.lit("note "), k.cast("string")))
    log = catalogue.orders(spark, d).select((F.col("o_custkey") % 100).alias("list_id"), (k % 97).alias("instrument_id"), k.alias("event_id"), F.col("o_orderdate").alias("ts"), F.when(add, "add").otherwise("remove").alias("action"), note.alias("note"))
    return lifecycle.watchlist(lifecycle.memberships(log), bars.counts(fx.candles(spark, d), 30))


# --- audit ------------------------------------------------------------------------------------------------

#: One chain over all events, each hash made from the one before.
_CHAIN = """WITH RECURSIVE ev AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id) AS sequence, event_id, event_type AS kind, 'user ' || user_id AS summary FROM events),
    ch AS (SELECT sequence, event_id, kind, summary, repeat('0', 64) AS previous_hash, sha256('{"chain":0,"kind":"' || kind || '","previous":"' || repeat('0', 64) || '","sequence":1,"summary":"' || summary || '"}') AS event_hash FROM ev WHERE sequence = 1
           UNION ALL SELECT ev.sequence, ev.event_id, ev.kind, ev.summary, ch.event_hash, sha256('{"chain":0,"kind":"' || ev.kind || '","previous":"' || ch.event_hash || '","sequence":' || ev.sequence || ',"summary":"' || ev.summary || '"}') FROM ch JOIN ev ON ev.sequence = ch.sequence + 1),
    """
#: Some rows changed, some removed, some swapped with the next.
_TAMPERED = """t AS (SELECT CASE sequence % 1019 WHEN 7 THEN sequence + 1 WHEN 8 THEN sequence - 1 ELSE sequence END AS sequence, kind, CASE WHEN sequence % 1009 = 3 THEN 'tampered' ELSE summary END AS summary, previous_hash, event_hash
                 FROM ch WHERE sequence % 1013 <> 5),
    l AS (SELECT *, previous_hash = lag(event_hash, 1, repeat('0', 64)) OVER (ORDER BY sequence) AS ok_link, event_hash = sha256('{"chain":0,"kind":"' || kind || '","previous":"' || previous_hash || '","sequence":' || sequence || ',"summary":"' || summary || '"}') AS ok_hash FROM t)
    """


def audit(spark, d):
    e = fx.read(spark, d, "events")
    return lifecycle.append_chain(e.select(F.lit(0).cast("long").alias("chain"), "event_id", F.col("event_type").alias("kind"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("summary")))


def tampered(spark, d):
    s = F.col("sequence")
    moved = F.when(s % 1019 == 7, s + 1).when(s % 1019 == 8, s - 1).otherwise(s)
    rows = audit(spark, d).where(s % 1013 != 5).withColumn("summary", F.when(s % 1009 == 3, "tampered").otherwise(F.col("summary")))
    return rows.withColumn("sequence", moved)


@query("au1_audit_append", _CHAIN + "x AS (SELECT 1) SELECT 0::BIGINT AS chain, event_id, kind, summary, sequence, previous_hash, event_hash FROM ch")
def _(spark, d):
    return audit(spark, d)


@query("au2_chain_verification", _CHAIN + _TAMPERED + "SELECT 0::BIGINT AS chain, sequence, 'hash' AS problem FROM l WHERE NOT ok_hash UNION ALL SELECT 0, sequence, 'link' FROM l WHERE NOT ok_link")
def _(spark, d):
    return lifecycle.verify_chain(tampered(spark, d))


@query("w7_chain_predecessors", _CHAIN + _TAMPERED + "SELECT 0::BIGINT AS chain, count(*) AS n, count(*) FILTER (ok_link) AS linked FROM l")
def _(spark, d):
    return lifecycle.linked(tampered(spark, d)).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok_link").alias("linked"))


@query("p9_audit_listing", """WITH a AS (SELECT event_id AS sequence, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'order' END AS subject_type, user_id::VARCHAR AS subject_id FROM events),
    c AS (SELECT 'kind' AS listing, * FROM (SELECT * FROM a WHERE kind = 'error' ORDER BY sequence DESC LIMIT 30) UNION ALL SELECT 'subject', * FROM (SELECT * FROM a WHERE subject_type = 'user' AND subject_id = '17' ORDER BY sequence DESC LIMIT 20)
          UNION ALL SELECT 'both', * FROM (SELECT * FROM a WHERE kind = 'click' AND subject_type = 'order' ORDER BY sequence DESC LIMIT 20) UNION ALL SELECT 'all', * FROM (SELECT * FROM a ORDER BY sequence DESC LIMIT 20)) SELECT listing, sequence, kind, subject_type, subject_id FROM c""")
def _(spark, d):
    e = fx.read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("sequence"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("order").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"))
    asked = {"kind": (30, "error", None, None), "subject": (20, None, "user", "17"), "both": (20, "click", "order", None), "all": (20, None, None, None)}
    found = [lifecycle.audit_listing(rows, *a).select(F.lit(name).alias("listing"), *rows.columns) for name, a in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
