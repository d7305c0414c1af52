"""Vector code compression: product codebooks trained by Lloyd rounds that rescan only what can have changed.

Vectors are cut into consecutive parts, each with a codebook of its own. A part keeps its entry and the exact
distance to it. After an update some entries of a codebook have moved. A part whose own entry stayed where it
was knows that no other resting entry is nearer, so it compares the moved entries with the distance that it
holds; a part whose entry moved looks at all entries. All figures are integers, so distances are exact and
ties go to the lower index either way.

A round is one pass over a table of vectors and their state in the shared folder, which writes the next such
table and, as rows of another folder, what each task adds up for each entry; the sums are merged by entry in
Spark, and only the codebooks (``PARTS`` times ``ENTRIES`` rows, whatever the input) reach the driver. The
table before the last is deleted once the next one is whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, remove, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers up to this size are held in 64 bits, where the squares of 8,192 differences add up safely; larger
#: ones in integers of any size. The most integers of one array of differences.
NARROW, AT_ONCE = 1 << 24, 1 << 21
MOST_LONG = (1 << 63) - 1


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit integers where all are small, else as Python's."""
    with np.errstate(over="ignore"):
        down = np.floor(vectors * SCALE)
    if not down.size or np.abs(down).max() < NARROW:
        return down.astype(np.int64)
    whole = [int(d) if math.isfinite(d) else int(x) * SCALE for x, d in zip(vectors.ravel().tolist(), down.ravel().tolist(), strict=True)]
    return np.array(whole, object).reshape(vectors.shape)


def cuts(dimensions: int) -> list[tuple[int, int]]:
    return [(dimensions * p // PARTS, dimensions * (p + 1) // PARTS) for p in range(PARTS)]


def _scan(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of ``entries`` to each row, and its squared distance."""
    best, far = np.zeros(len(rows), np.int64), np.zeros(len(rows), rows.dtype)
    step = max(1, AT_ONCE // max(1, entries.size))
    for at in range(0, len(rows), step):
        d = ((rows[at : at + step, None, :] - entries[None]) ** 2).sum(2)
        best[at : at + step] = near = d.argmin(1)
        far[at : at + step] = d[np.arange(len(d)), near]
    return best, far


def assign(rows: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray | None = None, dist: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row of one part; ties to the lower index.

    moved: which entries changed since ``code`` and ``dist`` were right for the rows. Without these all is scanned.
    """
    if code is None:
        return _scan(rows, book)
    code, dist = code.copy(), dist.astype(rows.dtype)
    again, rest = np.flatnonzero(moved[code]), np.flatnonzero(~moved[code])
    code[again], dist[again] = _scan(rows[again], book)
    active = np.flatnonzero(moved)
    if len(active) and len(rest):
        best, far = _scan(rows[rest], book[active])
        best = active[best]
        wins = (far < dist[rest]) | ((far == dist[rest]) & (best < code[rest]))
        code[rest[wins]], dist[rest[wins]] = best[wins], far[wins]
    return code, dist


def _held(rows: np.ndarray, kind: str) -> list[bytes]:
    """Each row of integers as bytes: of one integer type, or decimal text if they are Python's."""
    if rows.dtype == object:
        return [b"t" + ",".join(map(str, r)).encode() for r in rows.tolist()]
    return [b"n" + r.tobytes() for r in np.ascontiguousarray(rows.astype(kind))]


def _unheld(held: list[bytes], kind: str) -> np.ndarray:
    if all(h[:1] == b"n" for h in held):
        return np.frombuffer(b"".join(h[1:] for h in held), kind).reshape(len(held), -1).astype(np.int64)
    whole = [np.frombuffer(h[1:], kind).tolist() if h[:1] == b"n" else [int(x) for x in h[1:].split(b",")] for h in held]
    return np.array(whole, object).reshape(len(held), -1)


def _passes(books: list[np.ndarray], moved: list[np.ndarray], dimensions: int, first: bool, with_sums: bool):
    """One round over (vec_id, label, vec[, codes, dist]) in Arrow batches; sums come as rows of kind 1 at the end of a task."""
    bounds = cuts(dimensions)
    wide = any(b.dtype == object for b in books)

    def run(batches: Iterator) -> Iterator:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                rows, codes, dist = scaled(flat.reshape(batch.num_rows, -1)), None, None
            else:
                rows = _unheld(batch.column("vec").to_pylist(), "<i4")
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
                dist = _unheld(batch.column("dist").to_pylist(), "<i8")
            if wide or rows.dtype == object or (dist is not None and dist.dtype == object):
                rows = rows.astype(object)
            made = [assign(rows[:, a:b], books[p], moved[p], *(() if first else (codes[:, p], dist[:, p]))) for p, (a, b) in enumerate(bounds)]
            codes, dist = np.stack([c for c, _ in made], 1), np.stack([d for _, d in made], 1)
            if with_sums:
                for p, (a, b) in enumerate(bounds):
                    counts[p] += np.bincount(codes[:, p], minlength=ENTRIES)
                    for j in np.unique(codes[:, p]):
                        sums[p][j] = sums[p][j] + rows[codes[:, p] == j, a:b].sum(0).astype(object)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array(np.zeros(batch.num_rows, np.int32)), "vec_id": batch.column("vec_id"), "label": batch.column("label"), "vec": pa.array(_held(rows, "<i4"), pa.binary()),
                    "codes": pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), "dist": pa.array(_held(dist, "<i8"), pa.binary()),
                    "part": none.cast(pa.int32()), "entry": none.cast(pa.int32()), "n": none.cast(pa.int64()), "sums": none.cast(pa.string()),
                }
            )
        used = [(p, int(j)) for p in range(PARTS) for j in np.flatnonzero(counts[p])]
        if used:
            yield _sum_rows(used, [counts[p][j] for p, j in used], [sums[p][j] for p, j in used])

    def _sum_rows(used: list, counts: list, sums: list) -> pa.RecordBatch:
        none = pa.nulls(len(used))
        return pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([1] * len(used), pa.int32()), "vec_id": none.cast(pa.int64()), "label": none.cast(label_type), "vec": none.cast(pa.binary()), "codes": none.cast(pa.binary()),
                "dist": none.cast(pa.binary()), "part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([j for _, j in used], pa.int32()), "n": pa.array(counts, pa.int64()),
                "sums": pa.array([",".join(map(str, s)) for s in sums], pa.string()),
            }
        )

    label_type = pa.int64()
    return run


_STATE = "kind int, vec_id long, label long, vec binary, codes binary, dist binary, part int, entry int, n long, sums string"


def _merged(batches: Iterator) -> Iterator:
    """Sums and counts of the entries that a task was dealt, each once."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            own = held.setdefault((r["part"], r["entry"]), [0, [0] * len(r["sums"].split(","))])
            own[0] += r["n"]
            own[1] = [x + int(y or 0) for x, y in zip(own[1], r["sums"].split(","), strict=True)]
    yield pa.RecordBatch.from_pydict(
        {
            "part": pa.array([p for p, _ in held], pa.int32()), "entry": pa.array([j for _, j in held], pa.int32()), "n": pa.array([n for n, _ in held.values()], pa.int64()),
            "sums": pa.array([",".join(map(str, s)) for _, s in held.values()], pa.string()),
        }
    )


def _whole(rows: list, width: int) -> np.ndarray:
    """Integers as one array, of 64 bits where they are small."""
    small = all(abs(x) < NARROW for r in rows for x in r)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), width)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id_col, code, error, label, label_error) of each kept vector, and the final codebook of each part.

    Vectors that are null, or hold nulls, NaN or infinities, take no part; nor do those of another length than
    the first kept one's. Codebooks start as the parts of the vectors with the ``ENTRIES`` smallest identifiers
    (null identifiers last, equal ones by vector), of fewer where there are fewer vectors. Where the length is
    no multiple of ``PARTS``, parts differ by one component. Repeated rows count as often as they occur. Labels
    are whole numbers; null is one of its own. ``error`` and ``label_error`` stop at the largest 64-bit integer.
    No vectors give no rows and no codebooks.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec")).where(vec.isNotNull() & finite)
    order = [F.col("vec_id").asc_nulls_last(), "vec"]
    lead = rows.orderBy(*order).limit(1).collect()
    if not lead:
        none = "vec_id long, code string, error long, label long, label_error long"
        return spark.createDataFrame([], none).withColumnRenamed("vec_id", id_col), []
    dimensions = len(lead[0]["vec"])
    rows = rows.where(F.size("vec") == dimensions)
    seeds = [scaled(np.array([r["vec"]], np.float64)).ravel().tolist() for r in rows.orderBy(*order).limit(ENTRIES).collect()]
    bounds = cuts(dimensions)
    books = [_whole([s[a:b] for s in seeds], b - a) for a, b in bounds]
    moved = [np.ones(len(b), bool) for b in books]
    state, path = rows, None
    for k in range(rounds + 1):
        made = state.mapInArrow(_passes(books, moved, dimensions, k == 0, k < rounds), _STATE)
        both, fresh = written(made, by="kind")
        if path:
            remove(spark, path)
        state, path = both.where("kind = 0").select("vec_id", "label", "vec", "codes", "dist"), fresh
        if k < rounds:
            sums = both.where("kind = 1").select("part", "entry", "n", "sums").repartition("part", "entry").mapInArrow(_merged, "part int, entry int, n long, sums string")
            books, moved = _updated(books, sums.collect())
    return _with_errors(state, id_col), books


def _updated(books: list[np.ndarray], sums: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The codebooks after an update, and which of their entries are others than before."""
    new = [b.tolist() for b in books]
    for r in sums:
        new[r["part"]][r["entry"]] = [int(x or 0) // r["n"] for x in r["sums"].split(",")][: books[r["part"]].shape[1]]
    after = [_whole(n, b.shape[1]) for n, b in zip(new, books, strict=True)]
    return after, [(a != b).any(1) if b.size else np.zeros(len(b), bool) for a, b in zip(after, books, strict=True)]


def _with_errors(state: DataFrame, id_col: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            errors = [min(sum(r), MOST_LONG) for r in _unheld(batch.column("dist").to_pylist(), "<i8").tolist()] if batch.num_rows else []
            codes = ["".join(f"{c:02x}" for c in held) for held in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes, pa.string()), pa.array(errors, pa.int64()), batch.column("label")], names=["vec_id", "code", "error", "label"])

    out = table(state.mapInArrow(run, "vec_id long, code string, error long, label long"))
    most = F.lit(MOST_LONG)
    by_label = table(out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("e")).select(F.col("label").alias("_label"), F.least("e", most).cast("long").alias("label_error")))
    joined = out.join(lookup(by_label, by_label.count()), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("vec_id").alias(id_col), "code", "error", "label", "label_error")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for r in b.tolist() for x in r).encode()).hexdigest()
