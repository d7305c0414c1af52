"""A quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of whole texts. The trees are fitted on a bounded sample of labelled
rows (``MOST_ROWS``), on feature histograms of ``BINS`` quantile bins, and flattened into arrays that
every task walks for all its rows at once with numpy.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, sample_by_id, table, text_batches

#: The most labelled rows that a model is fitted on: those with the smallest hash of the identifier.
MOST_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_LEAF, RIDGE = 64, 60, 4, 0.2, 5, 1.0
FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "pipe_share",
    "exclaim_share", "punct_share", "wide_share", "newline_share", "distinct_share", "same_as_last_share",
    "short_share", "long_share", "upper_words", "symbol_words", "hash_like_share",
)
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_PUNCT = b".,;:?'\"-()"
_PLAIN = bytes(range(97, 123)) + _UPPER + _DIGIT + _PUNCT + b" \t\n\r\x0b\x0c" + bytes(range(128, 256))
_WIDE = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one whole text; a null or empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    words = raw.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    joined = np.array([x[:1].isupper() and x.isupper() and len(x) > 1 for x in words], bool) if words else np.zeros(0, bool)
    symbols = sum(1 for x in words if x[-1] in b"*#$%&!|~^=+<>@")
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean() if len(words) else 0.0, share(_UPPER), share(_DIGIT),
        1 - share(_PLAIN), raw.count(b"|") / n, raw.count(b"!") / n, share(_PUNCT), share(_WIDE), raw.count(b"\n") / n,
        len(set(words)) / w, sum(map(operator.eq, words, words[1:])) / w, (sizes <= 2).sum() / w, (sizes >= 14).sum() / w,
        joined.sum() / w, symbols / w, (raw.count(b"http") + raw.count(b"@")) / w,
    ]


@dataclass
class Trees:
    """Flattened trees: node ``i`` of all trees sends a row left if its feature is at most the threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                step = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, step)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit by second-order boosting of the logistic loss. Both labels may be absent: a constant then."""
    rate = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        raw = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            roots.append(node())
            todo = [(roots[-1], np.arange(len(y)), 0)]
            while todo:
                k, rows, depth = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = RATE * gs / (hs + RIDGE)
                best = (1e-6, 0, 0)
                for j, e in enumerate(edges if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF else []):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                    gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
                if best[0] > 1e-6:
                    _, j, cut = best
                    goes = binned[rows, j] <= cut
                    feature[k], threshold[k], left[k], right[k] = j, float(edges[j][cut]), node(), node()
                    todo += [(left[k], rows[goes], depth + 1), (right[k], rows[~goes], depth + 1)]
                else:
                    raw[rows] += value[k]
    as_array = lambda a, t: np.array(a, t)
    return Trees(as_array(roots, np.int64), as_array(feature, np.int64), as_array(threshold, float), as_array(left, np.int64), as_array(right, np.int64), as_array(value, float), base)


def document_statistics(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches):
            stats = [statistics(t) for t in batch.column("text").to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(stats, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "stats"])

    cut = docs.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes[:-1])
    return cut.mapInArrow(run, f"{schema}, stats array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Trees:
    """Fit on about ``most_rows`` labelled rows at most, chosen by the hash of the identifier.

    labels: id_col and label_col (0 or 1); null labels and ids without a document are left out. The
    chosen labels are counted and broadcast, so no text is shuffled; only statistics of the sample reach
    the driver, a row for each identifier and label. An identifier's repeated labels count once, different
    ones each; of its rows the text with the smallest hash counts, however many there are. Without rows
    the model gives every text the same score. Texts are whole; a text is one unit of work, read once.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).distinct()
    chosen = table(sample_by_id(known, "id", most_rows, known.count()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(lookup(chosen, chosen.count()), "id")
    one = document_statistics(rows, "text", F.col("y"), F.col("id"), F.col("h")).groupBy("id", "y").agg(F.min_by("stats", "h").alias("stats"))
    found = one.toPandas().sort_values(["id", "y"], kind="stable")
    x = np.stack(found["stats"].to_numpy()) if len(found) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T, found["y"].to_numpy(float), found["id"].to_numpy()]) if len(found) else np.zeros(0, int)
    return fit_trees(x[order], found["y"].to_numpy(float)[order])


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row's whole text; null and empty texts have one score too.

    Rows are scored each, so repeated ones alike, whatever their identifier. An empty table gives no rows.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand nodes at most

    def run(batches: Iterator) -> Iterator:
        trees = handle.value
        for batch in text_batches(batches):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(trees.score(x), pa.float64())], names=["id", "score"])

    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cut.mapInArrow(run, f"id {cut.dtypes[0][1]}, score double").withColumnRenamed("id", id_col)
