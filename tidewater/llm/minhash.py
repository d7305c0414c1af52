"""Near-duplicates by MinHash with tensored banding, linked by exact similarity of shingle sets.

Two collections of ``COLLECTIONS`` half keys are made, each half key of ``ROWS`` minima. Every half key of the
first is combined with every one of the second, which gives ``COLLECTIONS`` squared tables with keys of twice
``ROWS`` minima, from 2 * COLLECTIONS * ROWS minima instead of that many a table. A pair of similarity s shares
a table unless all half keys of one collection differ: 2 * (1 - s ** ROWS) ** COLLECTIONS at most (7 of 100,000
at 0.85, 2 of a million at 0.9), whatever the length of the texts.

Texts of one table key meet: walks over texts whose minima agree in ``LEAST`` of 32 places or more give a
spanning forest of each file, and what the forests connect is a cluster. Within a cluster walks over exact links
on the full sets give the links. A walk compares the text that it is at with those it has not reached yet, so a
group of alike texts costs one comparison a text. Groups larger than a block meet by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, table, text_batches
from .components import connected_components
from .simhash import SEED, word_spans

#: Half keys of a collection and minima of a half key; places of all minima in which texts of a file must agree
#: to meet exactly. Of pairs in a file that have a similarity of 0.85, one of three million agrees in less.
COLLECTIONS, ROWS, LEAST = 8, 2, 17
#: Texts of a file, and of a cluster, that meet at once.
BLOCK, EXACT_BLOCK = 4096, 512
_rng = np.random.default_rng(0x7E25)
_TIMES = _rng.integers(0, 1 << 63, 2 * COLLECTIONS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 64, 2 * COLLECTIONS * ROWS, np.uint64, endpoint=False)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles, the whole sequence if it has fewer words; none without words."""
    line, starts, ends = word_spans(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    last = min(shingle, len(starts)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: len(starts) - last].tolist(), ends[last:].tolist(), strict=True)), np.uint64, len(starts) - last))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles."""
    least = np.full(len(_TIMES), np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _TIMES + _PLUS).min(0))
    return _mix(least)


def half_keys(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half keys of both collections, from the minima of one text (or of many, a row each)."""
    groups = least.reshape(*least.shape[:-1], 2 * COLLECTIONS, ROWS)
    keys = np.zeros(groups.shape[:-1], np.uint64)
    for j in range(ROWS):
        keys = _mix(keys * np.uint64(31) ^ groups[..., j])
    return keys[..., :COLLECTIONS], keys[..., COLLECTIONS:]


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, text hashes t1 and t2, text) -> set size n, 128 bits of the set's hash, half keys a and b, one byte a minimum."""

    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches):
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            least = np.stack([minima(s) for s in sets]) if sets else np.zeros((0, len(_TIMES)), np.uint64)
            sigs = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            a, b = (k.view(np.int64) for k in map(np.ascontiguousarray, half_keys(least)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "t1", "t2")), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(sigs[:, 0]), pa.array(sigs[:, 1]),
                    *(pa.array(list(k), pa.list_(pa.int64())) for k in (a, b)), pa.array([r.tobytes() for r in (least & np.uint64(255)).astype(np.uint8)], pa.binary()),
                ],
                names=["id", "t1", "t2", "n", "s1", "s2", "a", "b", "bits"],
            )

    return docs.mapInArrow(run, "id long, t1 long, t2 long, n long, s1 long, s2 long, a array<long>, b array<long>, bits binary")


def walk(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Ends of a spanning forest of the graph in which ``near(x, others)`` tells which others are next to x."""
    left, one, two = np.arange(n), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            found = left[hit].tolist()
            one += [x] * len(found)
            two += found
            queue += found
            left = left[~hit]
    return one, two


def _agree(bits: np.ndarray, n: np.ndarray, percent: int, least: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether sizes allow the similarity, and enough minima are equal in their last byte."""

    def near(x: int, others: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(n[x], n[others]) >= percent * np.maximum(n[x], n[others])
        hit = np.flatnonzero(fits)
        fits[hit] = (bits[others[hit]] == bits[x]).sum(1) >= least
        return fits

    return near


def _linked(sets: list[np.ndarray], n: np.ndarray, maybe: Callable[[int, np.ndarray], np.ndarray], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether full sets share ``percent`` of their union."""

    def near(x: int, others: np.ndarray) -> np.ndarray:
        fits = maybe(x, others)
        own = sets[x]
        for at in np.array_split(hit := np.flatnonzero(fits), 1 + int(n[others[hit]].sum()) // (1 << 22)) if fits.any() else []:
            if len(at):
                some = [sets[k] for k in others[at]]
                flat = np.concatenate(some)
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                shared = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum([0, *map(len, some[:-1])]))
                fits[at] = 100 * shared >= percent * (n[others[at]] + len(own) - shared)
        return fits

    return near


def _groups(batches: Iterator) -> Iterator[pa.Table]:
    """Rows in whole groups of equal first three columns, which they are sorted by; of two rows at least."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in (rows.column(i).to_numpy() for i in range(3))])) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True) if len(ends) else []:
            if b - a > 1:
                yield rows.slice(a, b - a)
        rest = rows.slice(ends[-1]) if len(ends) else rows
    if rest is not None and rest.num_rows > 1:
        yield rest


def _forests(percent: int, least: int, exact: bool) -> Callable[[Iterator], Iterator]:
    """What makes (src, dst) edges of whole groups; ``exact``: by the sets in column held."""

    def run(batches: Iterator) -> Iterator:
        one, two = [], []

        def out() -> pa.RecordBatch:
            a, b = np.array(one, np.int64), np.array(two, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["src", "dst"])

        for rows in _groups(batches):
            node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
            bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(n), -1)
            near = _agree(bits, n, percent, least)
            if exact:
                near = _linked([np.frombuffer(h, np.uint64) for h in rows.column("held").to_pylist()], n, near, percent)
            a, b = walk(len(n), near)
            one += node[a].tolist()
            two += node[b].tolist()
            if len(one) > 100_000:
                yield out()
                one, two = [], []
        yield out()

    return run


def _meet(rows: DataFrame, key: str, held: DataFrame, block: int) -> DataFrame:
    """(key, node) rows whose key has others, with the columns of ``held`` by node, sorted by (key, one, two): the groups that meet."""
    counts = table(rows.groupBy(key).count().where("count > 1").select(key, F.ceil(F.col("count") / block).alias("blocks")))
    dealt = rows.join(lookup(counts, counts.count()), key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("own <> other OR blocks = 1")
    dealt = dealt.select(F.col(key).alias("key"), F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node").join(held, "node")
    run = ["key", "one", "two"]
    return dealt.select(*run, "node", *[c for c in held.columns if c != "node"]).repartition(*run).sortWithinPartitions(*run)


def _held_sets(clusters: DataFrame, distinct: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, n, bits, held) of every text in a cluster, from one of its rows."""

    def sets(batches: Iterator) -> Iterator:
        seen: set[int] = set()  # a task makes each set once, however often its text occurs
        for batch in text_batches(batches):
            nodes, fresh = batch.column("node").to_pylist(), []
            for k, node in enumerate(nodes):
                if node not in seen:
                    seen.add(node)
                    fresh.append(k)
            batch = batch.take(pa.array(fresh, pa.int64()))
            held = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "bits", "part")), pa.array(held, pa.binary())], names=["node", "n", "bits", "part", "held"])

    inside = table(clusters.join(distinct, "node").select("node", "n", "bits", "t1", "t2"))
    cut = docs.select("t1", "t2", "text").join(lookup(inside, inside.count()), ["t1", "t2"]).select("node", "n", "bits", F.spark_partition_id().alias("part"), "text")
    made = table(cut.mapInArrow(sets, "node long, n long, bits binary, part int, held binary"))
    first = made.groupBy("node").agg(F.min("part").alias("part"))
    first = table(first)
    return made.join(lookup(first, first.count()), ["node", "part"]).drop("part")


def minhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85, least: int = LEAST, block: int = BLOCK, exact_block: int = EXACT_BLOCK
) -> DataFrame:
    """One row for each row of ``docs``: id_col (long), n_shingles, component_id and kept.

    Sets of distinct word shingles (A-Z in lower case) link if 100 times what they share is ``percent`` times
    their union or more. Fewer words than a shingle form one shingle; texts without words, null and empty ones
    too, have no shingles and link with nothing. component_id is the smallest identifier of a row that links
    reach. Rows of equal sets are linked, whether their identifiers differ, repeat or are null; a row without
    one can connect others, and where no row of a component has one, component_id is null. kept: the
    identifier is component_id, both null included. Rows that repeat an identifier with another text are
    judged each by its text. An empty table gives no rows. Texts may have any length.

    Every link is exact; which pairs meet is decided by MinHash (see above for the share that does not).
    """
    body = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("other"), body).alias("t2"), body.alias("text"))
    made = table(_sketches(docs, shingle))
    sets = ["s1", "s2", "n"]
    whole = [F.first(F.struct("a", "b", "bits", "t1", "t2")).alias("r"), F.min("id").alias("least"), F.count("*").alias("rows")]
    distinct = made.where("n > 0").groupBy(*sets).agg(*whole).select(*sets, "least", "rows", "r.*")
    distinct = table(distinct.withColumn("node", F.monotonically_increasing_id()))
    keys = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i, j))))
    files = table(distinct.select(F.explode(keys).alias("key"), "node"))
    edges = table(_meet(files, "key", distinct.select("node", "n", "bits"), block).mapInArrow(_forests(percent, least, False), "src long, dst long").distinct())
    clusters = table(connected_components(edges))
    held = table(_held_sets(clusters.select("node"), distinct, docs, shingle))
    links = _meet(clusters.select("component", "node"), "component", held, exact_block).mapInArrow(_forests(percent, least, True), "src long, dst long")
    found = connected_components(table(links))
    reached = table(distinct.join(found, "node", "left").select("s1", "s2", "rows", "least", F.coalesce("component", "node").alias("c"), F.col("component").isNotNull().alias("many")))
    smallest = reached.where("many").groupBy("c").agg(F.min("least").alias("component_id"))
    labels = reached.where("many").join(smallest, "c").select("s1", "s2", "component_id")
    labels = table(labels.unionByName(reached.where("not many AND rows > 1").select("s1", "s2", F.col("least").alias("component_id"))).withColumn("labelled", F.lit(True)))
    rows = made.select("id", "n", "s1", "s2").join(lookup(labels, labels.count()), (F.col("n") > 0) & made["s1"].eqNullSafe(labels["s1"]) & made["s2"].eqNullSafe(labels["s2"]), "left")
    component = F.when(F.col("labelled"), F.col("component_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
