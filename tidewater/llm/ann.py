"""Approximate nearest neighbours by cosine with multiprobe p-stable hashing.

Vectors are scaled to length one, where cosine and Euclidean distance order alike. A table hashes a
vector to a bucket: its cells in random projections. A query visits a table's buckets in the order of
their estimated success, the probability that a neighbour at distance ``reach``, whose projections are
normal around the query's, lies in the bucket, until they add up to ``SUCCESS``. The candidates of all
tables are merged and reranked by exact cosine on the original vectors.

A vector goes once to each table, to the task that holds its bucket; a query goes to the tasks whose
buckets it visits. Buckets of one prefix (the first projections' cells) share a task, so that a query's
buckets, which differ in few cells, lie in few of them. Prefixes with many vectors are dealt to parts,
prefixes that many queries visit to blocks of queries, and every part meets every block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, table

#: Tables; cell width in units of ``reach``; summed success at which a query stops in a table, and most buckets.
TABLES, WIDTH, SUCCESS, PROBES, SEED = 8, 2.8, 0.3, 1024, 20
#: Vectors of a task's share of a table, queries of a block, cells that a probe goes from home in a projection.
SHARD, QUERY_BLOCK, SPAN = 8192, 4096, 1
#: Rows of the sample that ``reach`` is measured on: vectors and queries. They are those of the smallest hashes.
SAMPLE, SAMPLE_QUERIES = 8192, 256
#: Fewest and most projections of a table; one for each doubling of the vectors between.
LEAST_HASHES, MOST_HASHES = 8, 24


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, which is exact, so that squares stay finite; and their lengths then."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(-1))[1][..., None])
    return x, np.sqrt((x * x).sum(-1))


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by a rational approximation good to 1e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * np.exp(-z * z)
    return np.where(x < 0, half, 1 - half)


class Table:
    """One hash table's projections for vectors of a dimension."""

    def __init__(self, number: int, dim: int, hashes: int, prefix: int, reach: float):
        rng = np.random.default_rng([SEED, number, dim])
        self.reach, self.width, self.prefix = reach, WIDTH * reach, prefix
        self.axes, self.shift = rng.standard_normal((dim, hashes)), rng.uniform(0, self.width, hashes)
        self.factors = rng.integers(1, 1 << 62, hashes) * 2 + 1

    def project(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.axes + self.shift) / self.width

    def buckets(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix and code of each vector's bucket."""
        parts = np.cumsum(np.floor(self.project(units)).astype(np.int64) * self.factors, axis=1)
        return parts[:, self.prefix - 1] if self.prefix else np.zeros(len(units), np.int64), parts[:, -1]

    def _likeliest(self, gain: np.ndarray, cells: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed gains, codes and prefixes of the ``most`` likeliest cells of some projections, likeliest first.

        The likeliest cells of the first projections are extended one projection at a time; as successes
        multiply, the ``most`` likeliest of each step hold those of the next.
        """
        n = len(gain)
        best, code, prefix = np.zeros((n, 1)), np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int64)
        for j in range(gain.shape[1]):
            best = (best[:, :, None] + gain[:, j, None, :]).reshape(n, -1)
            code = (code[:, :, None] + cells[:, j, None, :]).reshape(n, -1)
            prefix = code if j < self.prefix else np.repeat(prefix, gain.shape[2], axis=1)
            if best.shape[1] > most:
                keep = np.argpartition(-best, most - 1, axis=1)[:, :most]
                best, code, prefix = (np.take_along_axis(a, keep, 1) for a in (best, code, prefix))
        order = np.argsort(-best, axis=1, kind="stable")
        return tuple(np.take_along_axis(a, order, 1) for a in (best, code, prefix))

    def probes(self, units: np.ndarray, success: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query prefixes and codes of the buckets that it visits, likeliest first.

        The projections are taken in two halves. A bucket of the ``most`` likeliest is the i-th of one half
        with the j-th of the other for some i * j <= most.
        """
        at = self.project(units)
        home, steps = np.floor(at), np.arange(-SPAN, SPAN + 1)
        edges = home[..., None] + np.append(steps, SPAN + 1) - at[..., None]
        gain = np.log(np.maximum(np.diff(_normal(edges * (self.width / self.reach)), axis=-1), 1e-12))
        cells = (home[..., None] + steps).astype(np.int64) * self.factors[:, None]
        half = max(self.prefix, at.shape[1] // 2)
        (gain_a, code_a, first), (gain_b, code_b, _) = self._likeliest(gain[:, :half], cells[:, :half], most), self._likeliest(gain[:, half:], cells[:, half:], most)
        pairs = [(i, j) for i in range(gain_a.shape[1]) for j in range(min(gain_b.shape[1], most // (i + 1)))]
        i, j = np.array(pairs).T
        best = gain_a[:, i] + gain_b[:, j]
        if best.shape[1] > most:
            keep = np.argpartition(-best, most - 1, axis=1)[:, :most]
        else:
            keep = np.tile(np.arange(best.shape[1]), (len(best), 1))
        order = np.take_along_axis(keep, np.argsort(-np.take_along_axis(best, keep, 1), axis=1, kind="stable"), 1)
        best = np.exp(np.take_along_axis(best, order, 1))
        before = np.cumsum(best, axis=1) - best
        for q in range(len(units)):
            own = order[q][before[q] < success]
            yield first[q][i[own]], code_a[q][i[own]] + code_b[q][j[own]]


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dimension, rows, their vectors scaled to length one)."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
        x, norm = scaled(rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
        yield int(dim), rows, x / norm[:, None]


class Vectors:
    """Vectors of a task with what finding the best of some of them needs."""

    def __init__(self, ids: np.ndarray, v: list):
        self.ids = ids
        self.x, self.norm = scaled(np.stack(v).astype(np.float64))
        self.rough = (self.x / self.norm[:, None]).astype(np.float32)

    def best(self, q: np.ndarray, q_norm: float, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``k`` of the vectors at ``found``.

        Those that single precision, whose error is far below the margin, leaves no chance are not scored.
        """
        if len(found) > 4 * k:
            near = self.rough[found] @ (q / q_norm).astype(np.float32)
            found = found[near >= np.partition(near, -k)[-k] - 1e-4]
        score = (self.x[found] * q).sum(1) / (self.norm[found] * q_norm)
        order = np.lexsort((self.ids[found], -score))[:k]
        return found[order], score[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim): vectors that are not null, not zero and have finite components only."""
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    cut = vectors.where(F.col(id_col).isNotNull() & fine & F.exists(F.col(vector_col), lambda x: x.cast("double") != 0))
    return cut.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"))


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """Rows with a number each; of equal vectors those that can be among the best ``k`` of some query.

    Equal vectors are equally near, and ties go to the smaller id: besides the query's own id only the
    rows of the k + 1 smallest ids count, and of one id k rows.
    """
    same = Window.partitionBy("hash", "v").orderBy("id")
    own = Window.partitionBy("hash", "v", "id").orderBy("dim")
    rows = vectors.withColumn("hash", F.xxhash64("v")).withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1)
    rows = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k)
    return table(rows.select("id", "v", "dim", F.monotonically_increasing_id().alias("row")))


def measure_reach(x: DataFrame, q: DataFrame, rows: int, asked: int, k: int) -> dict[int, float]:
    """By dimension the distance within which a query has its ``k`` nearest, from a bounded sample.

    In a sample of the share f of the rows the neighbour of rank k * f stands for the k-th; its distance
    for three quarters of the queries is taken. Dimensions that the sample lacks get 1.
    """


    def smallest(of: DataFrame, count: int, most: int, salt: str) -> list:
        drawn = F.shiftrightunsigned(F.xxhash64("id", "v", F.lit(salt)), 2)
        share = min(1.0, 1.2 * most / max(1, count))
        return of.select("id", "v", "dim", drawn.alias("drawn")).where(F.col("drawn") < int(share * (1 << 62))).orderBy("drawn", "id").limit(most).collect()

    some, few = smallest(x, rows, SAMPLE, "vectors"), smallest(q, asked, SAMPLE_QUERIES, "queries")
    reach: dict[int, float] = {}
    for dim in {r["dim"] for r in few}:
        a, ids = (np.array([r[c] for r in some if r["dim"] == dim], t) for c, t in (("v", float), ("id", np.int64)))
        b, own = (np.array([r[c] for r in few if r["dim"] == dim], t) for c, t in (("v", float), ("id", np.int64)))
        if len(a) < 2:
            continue
        (a, a_norm), (b, b_norm) = scaled(a), scaled(b)
        cos = np.where(own[:, None] == ids, -1.0, (b / b_norm[:, None]) @ (a / a_norm[:, None]).T)
        rank = min(len(a) - 1, max(1, round(k * len(some) / max(1, rows))))
        reach[dim] = float(np.clip(np.quantile(np.sqrt(np.maximum(0, 2 - 2 * np.sort(cos, 1)[:, -rank])), 0.75), 0.05, 1.5))
    return reach


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    success: float = SUCCESS,
    most_probes: int = PROBES,
    shard: int = SHARD,
    query_block: int = QUERY_BLOCK,
    with_visited: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest rows of ``vectors`` to each row of ``queries``.

    Nearest by cosine in double precision, ties to the smaller id. A query never finds rows of its own
    id; a repeated row is a candidate each time, a repeated query id counts once. Null, zero and
    non-finite vectors take no part, and vectors meet only those of their own dimension. A query whose
    buckets hold fewer than k candidates looks at all rows, so every query gets k rows if there are as
    many. Empty tables give no rows. Other columns are ignored. with_visited: (query_id, visited) instead,
    how many rows the query's buckets hold in all tables together, to measure how well they choose.
    """
    x, q = candidates(usable(vectors, id_col, vector_col), k), table(usable(queries, id_col, vector_col).dropDuplicates(["id"]))
    rows, asked = x.count(), q.count()
    reach = measure_reach(x, q, rows, asked, k)
    hashes = min(MOST_HASHES, max(LEAST_HASHES, round(math.log2(max(1, rows)))))
    prefix = min(hashes, max(0, math.floor(math.log2(max(1, rows) / shard))))

    def hashing(number: int, dim: int) -> Table:
        return Table(number, dim, hashes, prefix, reach.get(dim, 1.0))

    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            for dim, _, units in _by_dimension(batch):
                for t in range(tables):
                    own, n = np.unique(hashing(t, dim).buckets(units)[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"dim": np.full(len(n), dim, np.int32), "tab": np.full(len(n), t, np.int32), "prefix": own, "n": n.astype(np.int64)})

    def file(batches: Iterator) -> Iterator:
        for batch in batches:
            for dim, own, units in _by_dimension(batch):
                for t in range(tables):
                    first, code = hashing(t, dim).buckets(units)
                    yield pa.RecordBatch.from_arrays([own.column("dim"), pa.array(np.full(len(code), t, np.int32)), pa.array(first), pa.array(code), *(own.column(c) for c in ("id", "row", "v"))], names=["dim", "tab", "prefix", "code", "id", "row", "v"])

    def visit(batches: Iterator) -> Iterator:
        for batch in batches:
            for dim, own, units in _by_dimension(batch):
                for t in range(tables):
                    hasher = hashing(t, dim)
                    for at in range(0, len(units), 64):
                        take, prefixes, codes = [], [], []
                        for i, (first, code) in enumerate(hasher.probes(units[at : at + 64], success, most_probes), at):
                            for p in np.unique(first):
                                take.append(i)
                                prefixes.append(int(p))
                                codes.append(code[first == p])
                        some = own.take(pa.array(take))
                        yield pa.RecordBatch.from_arrays([some.column("dim"), pa.array(np.full(len(take), t, np.int32)), pa.array(prefixes, pa.int64()), pa.array(codes, pa.list_(pa.int64())), some.column("id"), some.column("v")], names=["dim", "tab", "prefix", "codes", "id", "v"])

    def search(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        if len(some) and len(asked):
            some = some.sort_values("code", kind="stable")
            code, ids, row = (some[c].to_numpy(np.int64) for c in ("code", "id", "row"))
            held = Vectors(ids, some["v"].to_list())
            qs, q_norm = scaled(np.stack(asked["v"].to_numpy()).astype(np.float64))
            for i, (qid, codes) in enumerate(zip(asked["id"].to_numpy(np.int64), asked["codes"], strict=True)):
                lo, hi = np.searchsorted(code, codes, "left"), np.searchsorted(code, codes, "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = at[ids[at] != qid]
                found, score = held.best(qs[i], q_norm[i], at, len(at) if with_visited else k)
                out += [(int(qid), int(row[a]), int(ids[a]), float(s)) for a, s in zip(found, score, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"])

    key = ["dim", "tab", "prefix"]
    def deal(rows: DataFrame, most: int, name: str) -> DataFrame:
        """How many pieces of about ``most`` rows the prefixes of more than twice as many are cut into."""
        cut = table(rows.groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") > 2 * most).select(*key, F.ceil(F.col("n") / most).alias(name)))
        return lookup(cut, cut.count())

    one = F.lit(1).cast("long")
    own = lambda name, *by: F.pmod(F.xxhash64(*by), F.coalesce(name, one))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(name, one) - 1))
    large = deal(x.mapInArrow(count, "dim int, tab int, prefix long, n long"), shard, "parts")
    filed = x.mapInArrow(file, f"dim int, tab int, prefix long, code long, id long, row long, v {dict(x.dtypes)['v']}").join(large, key, "left").withColumn("part", own("parts", "row"))
    probes = q.mapInArrow(visit, f"dim int, tab int, prefix long, codes array<long>, id long, v {dict(q.dtypes)['v']}")
    if asked > 2 * query_block:
        # A query visits a prefix once: with fewer queries no prefix can have more.
        probes = table(probes)
        busy = deal(probes.select(*key, F.lit(1).alias("n")), query_block, "blocks")
        filed, probes = (rows.join(busy, key, "left") for rows in (filed, probes))
    else:
        filed, probes = (rows.withColumn("blocks", one) for rows in (filed, probes))
    filed = filed.withColumn("block", every("blocks")).drop("parts", "blocks")
    probes = probes.join(large, key, "left").withColumn("block", own("blocks", "id")).withColumn("part", every("parts")).drop("parts", "blocks")
    key += ["part", "block"]
    found = filed.groupBy(*key).cogroup(probes.groupBy(*key)).applyInPandas(search, "query_id long, row long, vec_id long, score double")
    if with_visited:
        return found.groupBy("query_id").agg(F.count_distinct("row").alias("visited"))
    found = table(_ranked(found.dropDuplicates(["query_id", "row"]), k))
    short = q.join(found.groupBy(F.col("query_id").alias("id")).count(), "id", "left").where(F.coalesce("count", F.lit(0)) < k).select("id", "v", "dim")
    short = table(short)
    few = short.count()
    if not few:
        return found
    done = found.join(lookup(short.select(F.col("id").alias("query_id")), few), "query_id", "left_anti")
    return done.unionByName(_ranked(look_at_all(x, short, rows, few, k), k))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def look_at_all(x: DataFrame, q: DataFrame, rows: int, asked: int, k: int) -> DataFrame:
    """The best ``k`` of every shard of the vectors for each query, shard by block of queries."""
    shards, blocks = max(1, math.ceil(rows / SHARD)), max(1, math.ceil(asked / QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit("deal")), F.lit(n)).cast("int")
    left = x.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", spread(blocks))
    right = q.withColumn("block", deal(blocks)).withColumn("shard", spread(shards))
    key = ["dim", "shard", "block"]

    def search(some: pd.DataFrame, few: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        if len(some) and len(few):
            ids, row = some["id"].to_numpy(np.int64), some["row"].to_numpy(np.int64)
            held = Vectors(ids, some["v"].to_list())
            qs, q_norm = scaled(np.stack(few["v"].to_numpy()).astype(np.float64))
            for i, qid in enumerate(few["id"].to_numpy(np.int64)):
                found, score = held.best(qs[i], q_norm[i], np.flatnonzero(ids != qid), k)
                out += [(int(qid), int(row[a]), int(ids[a]), float(s)) for a, s in zip(found, score, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, row long, vec_id long, score double")
