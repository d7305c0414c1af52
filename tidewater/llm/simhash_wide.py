"""Near-duplicates by shingle similarity, with wide SimHash fingerprints and pigeonring filtering.

Texts of similarity 0.8 differ in about a seventh of a fingerprint's bits, so many that no chain of equal
segments is long enough to file fingerprints under (``simhash`` files them at 4 bits of 64). Here texts are
filed under bands of shingle minima instead; texts of one file whose sizes allow it are compared by
fingerprints of 256 bits, where the pigeonring's chain budgets prune pairs before the full distance. A file
yields a spanning forest of the pairs that are near enough; what these forests connect is a cluster. In a
cluster pairs that are near enough are looked at again, nearest first, and link if the similarity of their
sets of shingles, computed exactly, is high enough; pairs that links connect already are left out. Files and
clusters of more texts than ``BLOCK`` and ``EXACT_BLOCK`` meet block by block.
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

#: 64-bit words of a fingerprint; minima and how many of them form a band; texts of a file that meet at once.
WORDS, MINIMA, BAND, BLOCK, EXACT_BLOCK = 4, 64, 4, 1024, 256
#: Bits in which fingerprints may differ, of 256: at a similarity of 0.8 they differ in 39 on average, in more than
#: 62 with a probability of 1 in 20,000. Shingles below which bits tell too little, and pairs of a file meet without
#: being pruned. Segments of the ring, and lengths of chains that are tried before the full distance.
MOST_BITS, SHORT, SEGMENTS, CHAINS = 62, 40, 16, 4
_rng = np.random.default_rng(0xD0C5)
_TIMES = _rng.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 64, MINIMA, np.uint64, endpoint=False)
_SALT = _rng.integers(0, 1 << 64, WORDS, np.uint64, endpoint=False)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; no words: the one hash 0."""
    line, starts, ends = word_spans(text)
    if not len(starts):
        return np.zeros(1, np.uint64)
    last = min(shingle, len(starts)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: len(starts) - last].tolist(), ends[last:].tolist(), strict=True)), np.uint64, len(starts) - last))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wide fingerprint of a set of shingles and its band keys."""
    counts, least = np.zeros((WORDS, 64), np.int64), np.full(MINIMA, np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        least = np.minimum(least, (part[:, None] * _TIMES + _PLUS).min(0))
        for k, salt in enumerate(_SALT):
            counts[k] += np.unpackbits(_mix(part ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(shingles), axis=1, bitorder="little")
    bands = least.reshape(-1, BAND)
    keys = np.arange(len(bands), dtype=np.uint64)
    for j in range(BAND):
        keys = _mix(keys ^ bands[:, j])
    return bits.view(np.uint64).reshape(-1), keys


def within(differ: np.ndarray, most: int) -> np.ndarray:
    """Which rows of XORed fingerprints (n, WORDS) have ``most`` set bits or fewer, by chains of the ring first."""
    each = np.bitwise_count(np.ascontiguousarray(differ).view(np.uint16).reshape(len(differ), SEGMENTS)).astype(np.int16)
    left, run = np.arange(len(each)), np.zeros_like(each)
    alive = np.ones_like(each, bool)
    for n in range(CHAINS):
        run += np.roll(each, -n, axis=1)
        alive &= run * SEGMENTS <= (n + 1) * most
        some = alive.any(1)
        left, each, run, alive = left[some], each[some], run[some], alive[some]
    return left[each.sum(1) <= most]


def near_pairs(differ: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """Which pairs may be similar, by XORed fingerprints and the smaller number of shingles of each: short ones all."""
    long = np.flatnonzero(least >= SHORT)
    return np.union1d(np.flatnonzero(least < SHORT), long[within(differ[long], most)])


def shortest_forest(
    fps: np.ndarray, sizes: np.ndarray, group: np.ndarray, side: np.ndarray, most: int, similarity: float, linked: Callable[[int, int], bool] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of a forest of the nearest pairs within runs of equal ``group``.

    side: rows of side 0 meet all others of their group, rows of side 1 only those of side 2. linked: asked
    for each pair that the forest does not connect yet, nearest pairs first; without it, all near pairs link.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = np.arange(len(fps) - 1)
    for shift in range(1, len(fps)):
        left = left[left < len(fps) - shift]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            break
        right = left + shift
        fits = np.minimum(sizes[left], sizes[right]) >= similarity * np.maximum(sizes[left], sizes[right])
        meet = left[fits & ((side[left] == 0) | (side[left] != side[right]))]
        differ = fps[meet] ^ fps[meet + shift]
        near = near_pairs(differ, np.minimum(sizes[meet], sizes[meet + shift]), most)
        found.append((np.bitwise_count(differ[near]).sum(1, dtype=np.int64), meet[near], meet[near] + shift))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(far, kind="stable")
    parent, kept = list(range(len(fps))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q and (linked is None or linked(x, y)):
            parent[max(p, q)] = min(p, q)
            kept.append(k)
    return a[kept], b[kept]


_FPS = [f"f{j}" for j in range(WORDS)]


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches):
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            made = [sketch(s) for s in sets]
            fps = np.stack([f for f, _ in made]).view(np.int64) if made else np.zeros((0, WORDS), np.int64)
            keys = pa.array([k.view(np.int64) for _, k in made], pa.list_(pa.int64()))
            sig = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sig, pa.array(np.array([len(s) for s in sets], np.int64)), keys, *(pa.array(fps[:, j]) for j in range(WORDS))], names=["id", "sig", "n", "keys", *_FPS])

    cut = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut.mapInArrow(run, "id long, sig long, n long, keys array<long>, " + ", ".join(f"{f} long" for f in _FPS))


def _whole_groups(batches: Iterator) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in whole groups of equal first three columns (key, one, two), of two rows at least, with the
    group's number and the side of each row, which follows from the fourth column (own)."""
    rest = None

    def numbered(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        _, one, two, own = (rows.column(i).to_numpy() for i in range(4))
        group = np.concatenate(([0], np.cumsum(changes(rows))))
        many = np.flatnonzero(np.bincount(group)[group] > 1)
        side = np.where(one == two, 0, np.where(own == one, 1, 2))
        return rows.take(pa.array(many)), group[many], side[many]

    def changes(rows: pa.Table) -> np.ndarray:
        return np.logical_or.reduce([c[1:] != c[:-1] for c in (rows.column(i).to_numpy() for i in range(3))])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        last = np.flatnonzero(changes(rows))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield numbered(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield numbered(rest)


def _meet(rows: DataFrame, key: str, block: int) -> DataFrame:
    """``rows`` sorted by (key, one, two), which are the groups that meet: all of a key, or two blocks of it; keys of one row left out."""
    counts = table(rows.groupBy(key).count().where("count > 1").select(key, F.ceil(F.col("count") / block).alias("blocks")))
    dealt = rows.join(lookup(counts, counts.count()), key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rest = [c for c in rows.columns if c != key]
    dealt = dealt.select(F.col(key).alias("key"), F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", *rest)
    run = ["key", "one", "two"]
    return dealt.repartition(*run).sortWithinPartitions(*run, "node")


def _forests(most: int, similarity: float, exact: bool) -> Callable[[Iterator], Iterator]:
    """What makes (src, dst) edges of whole groups; ``exact``: by the sets in column held."""

    def run(batches: Iterator) -> Iterator:
        for rows, group, side in _whole_groups(batches):
            n, node = rows.column("n").to_numpy(), rows.column("node").to_numpy()
            fps = np.stack([rows.column(f).to_numpy() for f in _FPS], 1).view(np.uint64)
            held = rows.column("held").to_pylist() if exact else None

            def linked(x: int, y: int) -> bool:
                a, b = (np.frombuffer(held[k], np.uint64) for k in (x, y))  # noqa: B023
                shared = len(np.intersect1d(a, b, assume_unique=True))
                return shared >= similarity * (len(a) + len(b) - shared)

            a, b = shortest_forest(fps, n, group, side, most, similarity, linked if exact else None)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], names=["src", "dst"])

    return run


def candidate_clusters(distinct: DataFrame, similarity: float, most: int, block: int) -> DataFrame:
    """(node, n, keys, fingerprint) -> (node, component): clusters of texts that share files and are near by fingerprint."""
    files = table(distinct.select(F.explode("keys").alias("key"), "n", "node", *_FPS))
    edges = _meet(files, "key", block).mapInArrow(_forests(most, similarity, False), "src long, dst long")
    return connected_components(table(edges.distinct()))


def exact_links(clusters: DataFrame, distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, most: int, block: int) -> DataFrame:
    """(src, dst) edges of forests that connect what exact links between near texts of a cluster connect."""

    def sets(batches: Iterator) -> Iterator:
        for batch in text_batches(batches):
            held = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(held, pa.binary())], names=[*batch.schema.names[:-1], "held"])

    inside = table(clusters.join(distinct.select("node", "n", *_FPS), "node"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    cut = texts.join(lookup(inside, inside.count()), "node").select("node", "component", "n", *_FPS, "text")
    held = table(cut.mapInArrow(sets, "node long, component long, n long, " + ", ".join(f"{f} long" for f in _FPS) + ", held binary"))
    return _meet(held, "component", block).mapInArrow(_forests(most, similarity, True), "src long, dst long")


def near_components(
    docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, most_bits: int = MOST_BITS, block: int = BLOCK
) -> DataFrame:
    """One row for each row of ``docs``: id_col (long), component_id, the smallest identifier that links reach.

    id_col: a number of its own for each row. Texts link if the sets of their word shingles (A-Z in lower
    case, words as in ``simhash``) share ``similarity`` or more of all their shingles. Fewer words than a
    shingle form one shingle; texts without words (null and empty ones too) are alike. Equal sets count as
    one text. An empty table gives no rows. Every link that is used is exact; a linked pair can be missed if
    both have ``SHORT`` shingles or more and their fingerprints are further apart than ``most_bits`` (1 of
    20,000 at a similarity of 0.8, less above) or all its bands differ (1 of 5,000), and no other text
    connects it.
    """
    made = table(_sketches(docs, id_col, text_col, shingle))
    distinct = table(made.groupBy("sig", "n").agg(F.min("id").alias("node"), F.first("keys").alias("keys"), *[F.first(f).alias(f) for f in _FPS]))
    clusters = candidate_clusters(distinct, similarity, most_bits, block)
    links = exact_links(clusters, distinct, docs, id_col, text_col, shingle, similarity, most_bits, min(block, EXACT_BLOCK))
    found = connected_components(table(links))
    labels = table(distinct.join(found, "node", "left").select("sig", "n", F.coalesce("component", "node").alias("component_id")))
    out = made.select("id", "sig", "n").join(lookup(labels, labels.count()), ["sig", "n"])
    return out.select(F.col("id").alias(id_col), "component_id")
