"""State that changes by events: halts, backoff, proposals, mappings, watchlists, quotas, audit chains."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.scratch import folder, stored

GENESIS = "0" * 64


def last_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest event of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(*keys, "e.*")


def running_count(rows: DataFrame, keys: list[str], flag: Column, order: list[str], day: str, name: str) -> DataFrame:
    """``rows`` with the number of flagged rows of the same keys up to each one, itself included.

    Counted within the days of a key and carried on from day to day, so that no task needs all rows of a key.
    ``keys`` and ``day`` are not null; ``rows`` are read twice.
    """
    within = Window.partitionBy(*keys, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*keys, day).agg(F.sum(flag.cast("long")).alias("_n"))
    carry = days.select(*keys, day, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    counted = rows.withColumn(name, F.sum(flag.cast("long")).over(within))
    return counted.join(carry, [*keys, day]).withColumn(name, F.col(name) + F.col("_carry")).drop("_carry")


def halt_periods(log: DataFrame) -> DataFrame:
    """Every time that a halt was active: kind, scope, instrument_id, strategy, reason, by_user, activated_at, cleared_at, cleared_by.

    log: event_id, ts, action, kind, scope, instrument_id, strategy, reason, by_user (NULL: the system). A halt
    is one of a kind, scope and instrument. ``activate`` does nothing while it is active, so the first reason
    and time stay. ``clear`` ends it, whoever began it; ``clear_kind`` ends all halts of a kind that the system
    began. What is still active has no cleared_at.

    Clearings cut a halt's time into stretches, and clearings of its kind cut these into pieces. A stretch
    without a user's halt starts each piece inactive, so a piece's first activation begins a period. The
    first piece that a user begins goes on to the end of the stretch.
    """
    key, at = ["kind", "scope", "target"], ["ts", "event_id"]
    rows = log.withColumns({"target": F.coalesce("instrument_id", F.lit(-1)), "day": F.to_date("ts")})
    rows = stored(running_count(rows, ["kind"], F.col("action") == "clear_kind", at, "day", "piece"), "halts")
    own = stored(running_count(rows.where("action <> 'clear_kind'"), key, F.col("action") == "clear", at, "day", "stretch"), "halts")
    what = F.struct("ts", "event_id", "instrument_id", "strategy", "reason", "by_user")
    first = own.where("action = 'activate'").groupBy(*key, "stretch", "piece").agg(F.min_by(what, F.struct(*at)).alias("a"))
    held = first.where("a.by_user IS NOT NULL").groupBy(*key, "stretch").agg(F.min("piece").alias("held"))
    begun = first.join(held, [*key, "stretch"], "left").where("held IS NULL OR piece <= held").select(*key, "stretch", "piece", "a.*")
    cleared = own.where("action = 'clear'").select(*key, (F.col("stretch") - 1).alias("stretch"), F.struct(*at, F.lit("clear").alias("how")).alias("own_end"))
    swept = rows.where("action = 'clear_kind'").select("kind", (F.col("piece") - 1).alias("piece"), F.struct(*at, F.lit("clear_kind").alias("how")).alias("kind_end"))
    out = begun.join(cleared, [*key, "stretch"], "left").join(swept, ["kind", "piece"], "left")
    end = F.least("own_end", F.when(F.col("by_user").isNull(), F.col("kind_end")))
    return out.select("kind", "scope", "instrument_id", "strategy", "reason", "by_user", F.col("ts").alias("activated_at"), end["ts"].alias("cleared_at"), end["how"].alias("cleared_by"))


def halts_at(periods: DataFrame, times: DataFrame) -> DataFrame:
    """The halts that are active at each of a few ``times`` (one column, at)."""
    active = (F.col("activated_at") <= F.col("at")) & (F.col("cleared_at").isNull() | (F.col("cleared_at") > F.col("at")))
    return periods.join(F.broadcast(times), active)


def blocking_halts(active: DataFrame, instruments: DataFrame) -> DataFrame:
    """The halt that blocks each instrument at each time: a global one, else its own; strategy halts block none."""
    every = active.where("scope = 'global'").groupBy("at").agg(F.min("kind").alias("kind"))
    own = active.where("scope = 'instrument'").groupBy("at", "instrument_id").agg(F.min("kind").alias("kind"))
    shut = every.join(instruments.select("instrument_id"), F.lit(True)).select("at", "instrument_id", "kind", F.lit("global").alias("scope"))
    open_days = own.join(F.broadcast(every.select("at")), "at", "left_anti").join(instruments.select("instrument_id"), "instrument_id")
    return shut.unionByName(open_days.select("at", "instrument_id", "kind", F.lit("instrument").alias("scope")))


def reconciliation_events(runs: DataFrame) -> DataFrame:
    """Halt events of reconciliation runs (ts, run_id, broker, discrepancies): a divergence halts all trading, a clean run clears.

    A run that is told twice counts once.
    """
    once = runs.groupBy("run_id").agg(F.max(F.struct("ts", "broker", "discrepancies")).alias("r")).select("run_id", "r.*")
    clean = F.col("discrepancies") == 0
    reason = F.when(~clean, F.format_string("%s: %d discrepancies", "broker", "discrepancies"))
    none = F.lit(None)
    return once.select(
        F.col("run_id").alias("event_id"), "ts", F.when(clean, "clear_kind").otherwise("activate").alias("action"), F.lit("reconciliation").alias("kind"), F.lit("global").alias("scope"),
        none.cast("long").alias("instrument_id"), none.cast("string").alias("strategy"), reason.alias("reason"), none.cast("long").alias("by_user"),
    )


def memberships(log: DataFrame) -> DataFrame:
    """list_id, instrument_id, pinned_at, event_id, note, removed_at of every stay on a watchlist.

    log: event_id, ts, action (add or remove), list_id, instrument_id, note. Adding what is on the list keeps
    its place; its note changes if one is given. After a removal an addition starts a new stay, with its own note.
    """
    key, at = ["list_id", "instrument_id"], ["ts", "event_id"]
    rows = stored(running_count(log.withColumn("day", F.to_date("ts")), key, F.col("action") == "remove", at, "day", "stay"), "watch")
    added = rows.where("action = 'add'").groupBy(*key, "stay").agg(F.min(F.struct(*at)).alias("first"), F.max_by("note", F.when(F.col("note").isNotNull(), F.struct(*at))).alias("note"))
    gone = rows.where("action = 'remove'").select(*key, (F.col("stay") - 1).alias("stay"), F.col("ts").alias("removed_at"))
    return added.join(gone, [*key, "stay"], "left").select(*key, F.col("first.ts").alias("pinned_at"), F.col("first.event_id").alias("event_id"), "note", "removed_at")


def watchlist(stays: DataFrame, scannable: DataFrame) -> DataFrame:
    """What is on each list in the order it was pinned, with its note, and whether it can be scanned (instrument_id, has_history)."""
    place = F.row_number().over(Window.partitionBy("list_id").orderBy("pinned_at", "event_id"))
    rows = stays.where("removed_at IS NULL").join(scannable.select("instrument_id", "has_history"), "instrument_id", "left")
    return rows.select("list_id", place.alias("place"), "instrument_id", "pinned_at", "note", F.coalesce("has_history", F.lit(False)).alias("scannable"))


def backoff(fetches: DataFrame, most: int = 3, rest_days: int = 30) -> DataFrame:
    """Empty fetches since the last success; from ``most`` on the symbol rests. Errors don't count."""
    counted = fetches.where("outcome <> 'error'")
    later = Window.partitionBy("symbol").orderBy(F.col("ts").desc(), F.col("fetch_id").desc())
    since = counted.withColumn("successes", F.sum((F.col("outcome") == "ok").cast("int")).over(later))
    out = since.groupBy("symbol").agg(F.count_if(F.col("successes") == 0).alias("empties"), F.max(F.when(F.col("successes") == 0, F.col("ts"))).alias("last_empty"))
    rest = F.when(F.col("empties") >= most, F.to_date("last_empty") + rest_days)
    return out.select("symbol", "empties", rest.alias("retry_after"))


def proposal_states(proposals: DataFrame, decisions: DataFrame, as_of: str) -> DataFrame:
    """Pending proposals take their decision unless they expired before it."""
    out = proposals.join(decisions, "proposal_id", "left")
    expired = F.col("expires_at") <= F.coalesce("decided_at", F.lit(as_of).cast("timestamp"))
    return out.select("proposal_id", F.when(expired, "expired").otherwise(F.coalesce("decision", F.lit("pending"))).alias("state"))


def decide(proposals: DataFrame, actions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(proposals after, what came of each action): only a pending proposal is actionable, once.

    proposals: proposal_id, status, expires_at, suspended (its instrument). actions: proposal_id, nth (their
    order), action (approve or reject), at. Approving an expired proposal expires it; approving one of a
    suspended instrument is refused and changes nothing; rejecting needs neither. What is still pending and
    past its time by ``as_of`` expires.
    """
    rows = actions.join(proposals, "proposal_id")
    late = F.col("expires_at") <= F.col("at")
    to = F.when(F.col("action") == "reject", "rejected").when(late, "expired").when(~F.col("suspended"), "approved")
    before = Window.partitionBy("proposal_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("to", to).withColumn("done", (F.col("status") != "pending") | F.coalesce(F.max(F.col("to").isNotNull()).over(before), F.lit(False)))
    rows = rows.withColumn("outcome", F.when(F.col("done"), "not actionable").when(F.col("to").isNull(), "suspended").otherwise(F.col("to")))
    moves = rows.where("NOT done AND to IS NOT NULL").select("proposal_id", "to", "at")
    out = proposals.join(moves, "proposal_id", "left")
    swept = (F.col("status") == "pending") & F.col("to").isNull() & (F.col("expires_at") <= F.lit(as_of).cast("timestamp"))
    after = F.coalesce("to", F.when(swept, "expired"), "status")
    return out.select("proposal_id", after.alias("status"), F.when(F.col("to").isin("approved", "rejected"), F.col("at")).alias("decided_at")), rows.select("proposal_id", "nth", "action", "outcome")


def admit(requests: DataFrame, daily: int, reserve: int, minute: int, critical: int = 2) -> DataFrame:
    """Quota over a request log: provider, day, ts, request_id, priority -> granted, reason.

    A day's limit is soft for critical priorities, which may draw on the reserve. A minute counts every
    call that passed the day's check, granted or not; the day counts granted calls only. Each decision
    depends on the ones before, so providers' days are dealt to tasks, sorted, and folded row by row; a
    task holds the counters of one day, not its requests.
    """

    def fold(frames):
        key, used, minute_of, in_minute = None, 0, None, 0
        for frame in frames:
            out = []
            for provider, day, rid, ts, rank in frame[["provider", "day", "request_id", "ts", "priority"]].itertuples(index=False):
                if (provider, day) != key:
                    key, used, minute_of, in_minute = (provider, day), 0, None, 0
                limit = daily + (reserve if rank <= critical else 0)
                if used >= limit:
                    out.append((rid, False, "reserve exhausted" if rank <= critical else "daily limit"))
                    continue
                bucket = ts.floor("min")
                in_minute = in_minute + 1 if bucket == minute_of else 1
                minute_of = bucket
                if in_minute > minute:
                    out.append((rid, False, "minute limit"))
                    continue
                out.append((rid, True, "reserve" if used >= daily else "within budget"))
                used += 1
            yield pd.DataFrame(out, columns=["request_id", "granted", "reason"])

    ordered = requests.repartition("provider", "day").sortWithinPartitions("provider", "day", "ts", "request_id")
    return ordered.mapInPandas(fold, "request_id long, granted boolean, reason string")


def canonical(event: dict) -> str:
    return json.dumps(event, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Events of a chain that are hashed in one go: what a task sorts at a time.
CHAIN_ROWS = 1_000_000


def append_chain(events: DataFrame, rows_a_part: int = CHAIN_ROWS) -> DataFrame:
    """Hash chains: chain, event_id, kind, summary -> sequence, previous_hash, event_hash.

    Every hash covers the one before. What each hash covers besides is written out first, in all tasks, in ranges of
    ``rows_a_part`` events; then the ranges are hashed in turn, each beginning with the last hash of the one before. Ranges
    that begin with another chain than the one before ended with wait for nothing: the first ranges of all such runs
    are hashed together, then the second ones. One chain alone is one task's hashing by its nature, a range at a
    time; ``linked`` and ``verify_chain`` check it in all tasks.
    """
    spark = events.sparkSession
    at, folded = ["chain", "event_id"], folder(spark, "chain-hashed")
    quoted = lambda c: _json_text(F.col(c))
    # {"chain":..,"kind":..,"previous":"<hash>","sequence":<n>,"summary":..}, as canonical() writes it
    head = F.concat(F.lit('{"chain":'), F.col("chain").cast("string"), F.lit(',"kind":'), quoted("kind"), F.lit(',"previous":"'))
    tail = F.concat(F.lit(',"summary":'), quoted("summary"), F.lit("}"))
    found = stored(events.select(*at, "kind", "summary"), "chain-events")
    n = -(-found.count() // rows_a_part) or 1
    ranged = found.repartitionByRange(n, *at).withColumn("part", F.spark_partition_id()).withColumns({"head": head, "tail": tail})
    ranges = stored(ranged, "chain-ranges")
    ends = ranges.groupBy("part").agg(F.min("chain").alias("first"), F.max("chain").alias("last")).orderBy("part").collect()  # a row a range
    turns: list[list[int]] = []
    turn, before = 0, None
    for r in ends:
        turn, before = turn + 1 if before == r["first"] else 0, r["last"]
        if turn == len(turns):
            turns.append([])
        turns[turn].append(r["part"])
    carried: dict[int, tuple[str, int]] = {}
    for k, parts in enumerate(turns):
        rows = ranges.where(F.col("part").isin(parts)).repartition(len(parts), "part").sortWithinPartitions("part", *at)
        rows.mapInArrow(_fold_ranges(carried), f"{CHAIN}, part int").write.parquet(f"{folded}/turn-{k}")
        if k + 1 < len(turns):
            done = spark.read.schema(f"{CHAIN}, part int").parquet(f"{folded}/turn-{k}")
            last = done.groupBy("part").agg(F.max(F.struct("chain", "sequence", "event_hash")).alias("e")).select("e.*").collect()  # a row a range
            carried = {r["chain"]: (r["event_hash"], r["sequence"]) for r in last}
    return spark.read.schema(CHAIN).parquet(*[f"{folded}/turn-{k}" for k in range(len(turns))]) if turns else spark.createDataFrame([], CHAIN)


CHAIN = "chain long, event_id long, kind string, summary string, sequence long, previous_hash string, event_hash string"


@F.pandas_udf(StringType())
def _json_text(texts: pd.Series) -> pd.Series:
    """Each text as canonical() writes it."""
    return texts.astype(object).map(lambda x: json.dumps(x if isinstance(x, str) else None, ensure_ascii=False))


def _fold_ranges(carried: dict[int, tuple[str, int]]):
    """A fold over sorted ranges; ``carried`` has the last hash and sequence of chains that began in earlier ranges."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, previous, n = None, GENESIS, 0
        for batch in batches:
            numbers, befores, hashes = [], [], []
            for part, chain, head, tail in zip(*(batch.column(c).to_pylist() for c in ("part", "chain", "head", "tail")), strict=True):
                if (part, chain) != of:
                    # the first chain of a range goes on where it was left; later ones begin
                    previous, n = carried.get(chain, (GENESIS, 0)) if of is None or of[0] != part else (GENESIS, 0)
                    of = (part, chain)
                n += 1
                befores.append(previous)
                previous = hashlib.sha256(f'{head}{previous}","sequence":{n}{tail}'.encode()).hexdigest()
                numbers.append(n)
                hashes.append(previous)
            own = [batch.column(c) for c in ("chain", "event_id", "kind", "summary")]
            made = [pa.array(numbers, pa.int64()), pa.array(befores, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *made, batch.column("part")], names=["chain", "event_id", "kind", "summary", "sequence", "previous_hash", "event_hash", "part"])

    return fold


def linked(chain: DataFrame) -> DataFrame:
    """``chain`` with ok_link: whether previous_hash is the hash of the event before, the genesis hash at first.

    Sequences may have gaps. Events are range-partitioned by sequence; each part looks back within itself and
    takes the last hash of the part before it, so a chain of any length is checked by all tasks.
    """
    rows = stored(chain.repartitionByRange("chain", "sequence").withColumn("part", F.spark_partition_id()), "chain")
    own = Window.partitionBy("chain", "part").orderBy("sequence")
    last = rows.groupBy("chain", "part").agg(F.max_by("event_hash", "sequence").alias("last"))  # a row a part
    carry = last.select("chain", "part", F.lag("last").over(Window.partitionBy("chain").orderBy("part")).alias("carry"))
    out = rows.withColumn("before", F.lag("event_hash").over(own)).join(carry, ["chain", "part"])
    return out.withColumn("ok_link", F.col("previous_hash") == F.coalesce("before", "carry", F.lit(GENESIS))).drop("part", "before", "carry")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Problems of chains: a hash that its row doesn't give, and a predecessor that isn't the event before."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', "$1")
    body = F.concat(F.lit('{"chain":'), F.col("chain").cast("string"), F.lit(',"kind":'), quoted("kind"), F.lit(',"previous":'), quoted("previous_hash"), F.lit(',"sequence":'), F.col("sequence").cast("string"), F.lit(',"summary":'), quoted("summary"), F.lit("}"))
    found = F.array_compact(F.array(F.when(F.sha2(body, 256) != F.col("event_hash"), "hash"), F.when(~F.col("ok_link"), "link")))
    return linked(chain).select("chain", "sequence", F.explode(found).alias("problem"))


def audit_listing(events: DataFrame, most: int, kind: str | None = None, subject_type: str | None = None, subject_id: str | None = None) -> DataFrame:
    """The newest events, of a kind or about a subject where these are given."""
    for column, value in (("kind", kind), ("subject_type", subject_type), ("subject_id", subject_id)):
        if value is not None:
            events = events.where(F.col(column) == value)
    return events.orderBy(F.col("sequence").desc()).limit(most)
