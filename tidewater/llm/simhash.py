"""Near-duplicates by 64-bit SimHash fingerprints, linked through pigeonring filtering.

Fingerprints that differ in at most ``t`` bits are split into a ring of ``SEGMENTS`` segments. By the
pigeonring principle some segment starts a chain in which the first ``l`` segments differ in at most
``l * t / SEGMENTS`` bits, for every ``l``. With t = 4 and five segments the first is equal, the first two
differ in one bit at most and the first three in two. So of ``a`` parts of the second all but one are
equal, and of ``b`` parts of the third all but two: a fingerprint is filed under (start, first segment,
some a - 1 parts of the second, some b - 2 of the third), and only fingerprints of one file meet. The
more fingerprints there are by count, the finer the parts, and the more bits a file's fingerprints share.
In a file the budgets of longer chains prune pairs before the full Hamming check. Fingerprints are made
distinct first, and a file yields a spanning forest of its links rather than all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, table, text_batches
from .components import connected_components

SEED, SHINGLE, SEGMENTS = 42, 4, 5
#: Rows of one file that meet in one task; larger files meet block by block.
BLOCK = 4096
#: (fingerprints up to which it serves, parts of the second segment, parts of the third). They share 19,
#: 22, 25 and 28 bits in a file, for 10, 20, 45 and 120 files of a fingerprint.
FILINGS = ((1 << 22, 2, 2), (1 << 26, 4, 2), (1 << 30, 3, 3), (None, 4, 4))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def word_spans(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words, A-Z in lower case, joined by one space, and where each starts and ends."""
    words = _SPLIT.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate(([0], ends[:-1] + 1))[: len(words)], ends


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text; 0 without words."""
    line, starts, ends = word_spans(text)
    if not len(starts):
        return 0
    last = min(shingle, len(starts)) - 1
    counts, n = np.zeros(64, np.int64), len(starts) - last
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        digest, seed = xxhash.xxh64_intdigest, SEED
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + last : to + last].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * counts > n) @ (1 << np.arange(64, dtype=object)))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def ring(distance: int, segments: int = SEGMENTS) -> tuple[list[int], list[list[int]], list[int]]:
    """Segment masks, chain masks by start and length, and chain budgets by length."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    chains = [[sum(masks[(s + k) % segments] for k in range(n)) for n in range(1, segments + 1)] for s in range(segments)]
    return masks, chains, [n * distance // segments for n in range(1, segments + 1)]


def _parts(mask: int, n: int) -> list[int]:
    """A segment's mask cut to ``n`` masks of nearly equal width."""
    places = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in places[len(places) * i // n : len(places) * (i + 1) // n]) for i in range(n)]


@cache
def file_masks(distance: int, second: int = 2, third: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(bits that the fingerprints of a file share, segment that starts the chain), one a file kind."""
    masks, _, budgets = ring(distance)
    if budgets[0] or budgets[1] > 1 or budgets[2] > 2:
        raise ValueError("this filing needs a distance of at most four bits")
    kinds = [
        (masks[s] | sum(a) | sum(b), s)
        for s in range(SEGMENTS)
        for a in combinations(_parts(masks[(s + 1) % SEGMENTS], second), second - 1)
        for b in combinations(_parts(masks[(s + 2) % SEGMENTS], third), third - 2)
    ]
    return np.array([m for m, _ in kinds], np.uint64), np.array([s for _, s in kinds])


def file_keys(fps: np.ndarray, distance: int, second: int = 2, third: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each file kind and fingerprint: (number of the kind, key), as arrays of shape (kinds, rows)."""
    masks, _ = file_masks(distance, second, third)
    kinds = np.repeat(np.arange(len(masks), dtype=np.int32)[:, None], len(fps), 1)
    return kinds, (fps[None, :] & masks[:, None]).view(np.int64)


def near(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs pass the budgets of the chain that starts at a segment, the whole ring included."""
    _, chains, budgets = ring(distance)
    differ, alive = a ^ b, np.ones(len(a), bool)
    for n, budget in enumerate(budgets):
        masks = np.array([c[n] for c in chains], np.uint64)[start]
        left = np.flatnonzero(alive)
        alive[left] = np.bitwise_count(differ[left] & masks[left]) <= budget
    return alive


def forest_edges(fps: np.ndarray, nodes: np.ndarray, group: np.ndarray, side: np.ndarray, start: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within runs of equal ``group``.

    side: rows of side 0 meet all others of their group, rows of side 1 only those of side 2.
    """
    n, label, out = len(fps), np.arange(len(fps)), []
    left = np.arange(n - 1)
    for shift in range(1, n):
        left = left[left < n - shift]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            break
        meet = left[(side[left] == 0) | (side[left] != side[left + shift])]
        meet = meet[label[meet] != label[meet + shift]]
        hit = meet[near(fps[meet], fps[meet + shift], start[meet], distance)]
        for i in hit.tolist():
            a, b = label[i], label[i + shift]
            if a != b:
                span = slice(np.searchsorted(group, group[i], "left"), np.searchsorted(group, group[i], "right"))
                label[span][label[span] == max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[i + shift])))
    return out


def links(distinct: DataFrame, distance: int, block: int = BLOCK, filing: tuple[int, int] | None = None) -> DataFrame:
    """(fp, node) of distinct fingerprints -> (src, dst) edges that connect what all links connect.

    filing: parts of the second and third segment; chosen by the number of fingerprints without it.
    """
    if filing is None:
        rows = distinct.count()
        filing = next(parts for most, *parts in FILINGS if most is None or rows <= most)
    second, third = filing

    def file(batches: Iterator) -> Iterator:
        for batch in batches:
            fp, node = (batch.column(i).to_numpy() for i in (0, 1))
            kinds, keys = file_keys(fp.view(np.uint64), distance, second, third)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.ravel()), pa.array(keys.ravel()), pa.array(np.tile(fp, len(kinds))), pa.array(np.tile(node, len(kinds)))],
                names=["kind", "key", "fp", "node"],
            )

    def edges(kind, key, one, two, own, fp, node) -> pa.RecordBatch:
        group = np.concatenate(([0], np.cumsum(_changes(kind, key, one, two))))
        side = np.where(one == two, 0, np.where(own == one, 1, 2))
        found = forest_edges(fp.view(np.uint64), node, group, side, file_masks(distance, second, third)[1][kind], distance)
        src, dst = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    def meet(batches: Iterator) -> Iterator:
        rest: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(7)]
            if rest:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            last = np.flatnonzero(_changes(*cols[:4]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield edges(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
        if rest and len(rest[0]):
            yield edges(*rest)

    files = table(distinct.mapInArrow(file, "kind int, key long, fp long, node long"))
    large = table(files.groupBy("kind", "key").count().where(F.col("count") > block).select("kind", "key", F.ceil(F.col("count") / block).alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    dealt = (
        files.join(lookup(large, large.count()), ["kind", "key"], "left")
        .withColumn("own", F.pmod(F.xxhash64("fp"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("kind", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "fp", "node")
    )
    run = ["kind", "key", "one", "two"]
    return dealt.repartition(*run).sortWithinPartitions(*run).mapInArrow(meet, "src long, dst long")


def _changes(*cols: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([c[1:] != c[:-1] for c in cols])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: id_col (long), fp (long), component_id.

    Texts are compared whole, with A-Z in lower case, as runs of characters other than the six ASCII
    white spaces. Fewer words than a shingle form one shingle; texts without words (null and empty
    ones too) have fingerprint 0 and are linked like any other. component_id is the smallest identifier
    that links reach. Repeated rows have one component. Rows with a null identifier link nothing; they
    get the component of their fingerprint, null if no other row has it. An empty table gives no rows.
    distance: bits in which linked fingerprints may differ, four at most.
    """
    prints = table(fingerprints(docs, id_col, text_col, shingle))
    distinct = table(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    found = connected_components(table(links(distinct, distance)))
    labels = table(distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    out = prints.join(lookup(labels, labels.count()), "fp", "left")
    return out.select(F.col("id").alias(id_col), "fp", "component_id")
