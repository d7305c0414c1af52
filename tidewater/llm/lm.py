"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

The mixture weights depend on how often the context occurs (a bucket for each power of two). They are
learned by expectation-maximisation on training documents that the counts for it leave out ("deleted"),
and then applied to the counts of all training documents.

Tokens are hashed to 64 bits and bigrams to ``KEY_BITS``. A task turns its documents into chunks: the
distinct tokens and, for every token, its place among them. A chunk asks for the counts of its distinct
keys, range-partitioned over the key space; each part sums what all chunks hold and answers each chunk
in the order of its keys. So a frequent key costs one entry a chunk, whatever its frequency, and texts
are read once and never shuffled. A chunk asks only the parts that its own keys lie in. A part that many
chunks ask, as it holds a frequent key, is dealt to shares of the chunks: shares are summed in a tree, and
each answers its chunks from the sums of the whole part. Counts of the whole corpus stay spread over the
parts; the driver gets only the totals and a histogram of quantised probability ratios.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, table, text_batches

#: Text bytes of a chunk, bits of a bigram key, most keys that one part of the key space holds on average.
CHUNK_BYTES, KEY_BITS, PART_KEYS = 4 << 20, 52, 1_000_000
#: Chunks that ask one share of a part at most (about), shares whose sums are added at once, values that are not compressed.
PART_ROWS, FAN, PLAIN = 262_144, 8, 32
#: One in so many training documents is left out to learn the weights; EM rounds; ratio steps a nat.
DELETED, ROUNDS, STEPS, BUCKETS = 10, 40, 8, 32
END, BEGIN = np.uint64(0x9E6C63D0876A9A47), np.uint64(0x2545F4914F6CDD1D)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def token_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of all texts, an END after each, and the number of tokens of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    line = np.frombuffer(b"\n".join(raw), np.uint8)
    inside = ~_SPACE[line]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1))) if len(at) else at
    sizes = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, sizes)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(sizes.max(initial=1)), np.uint64(0x5851F42D4C957F2D)))))
    value = (_LOWER[line[at]] + np.uint64(1)) * powers[within]
    words = _mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(first) else np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    text = np.searchsorted(ends, at[first], "right") if len(first) else first
    counts = np.bincount(text, minlength=len(texts)) + 1
    keys = np.full(len(words) + len(texts), END)
    keys[np.arange(len(words)) + text] = words
    return keys, counts


def _pack(values: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes after their width, or a few as they are after a zero."""
    if len(values) < PLAIN:
        return b"\0" + values.astype("<u8").tobytes()
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    if not width:
        return np.frombuffer(blob, "<u8", offset=1)
    planes = np.frombuffer(pa.decompress(blob[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(keys if len(keys) < PLAIN else np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    values = _unpack(blob)
    return np.cumsum(values, dtype=np.uint64) if blob[0] else values


@dataclass
class Chunk:
    """Documents as places among their distinct tokens, and the bigrams that they form."""

    train: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    place: np.ndarray
    bigrams: np.ndarray = field(init=False)
    pair: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        keys = self.tokens[self.place]
        self.first = np.cumsum(self.counts) - self.counts
        before = np.roll(keys, 1)
        before[self.first] = BEGIN
        pairs = _mix(_mix(before) * np.uint64(0x9E3779B97F4A7C15) + keys) >> np.uint64(64 - KEY_BITS)
        self.bigrams, self.pair = np.unique(pairs, return_inverse=True)

    @property
    def trained(self) -> np.ndarray:
        return np.repeat(self.train, self.counts)


def chunks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """One row for each chunk. Documents that are left out to learn the weights are in chunks of their own."""

    def chunk(ids: pa.Array, train: np.ndarray, texts: list[str], deleted: bool) -> pa.RecordBatch:
        keys, counts = token_keys(texts)
        tokens, place = np.unique(keys, return_inverse=True)
        row = {
            "chunk": uuid.uuid4().int >> 65, "deleted": deleted, "ids": ids.to_pylist(), "train": _pack(train.astype(np.uint64)),
            "counts": _pack(counts.astype(np.uint64)), "tokens": _pack_sorted(tokens), "place": _pack(place.astype(np.uint64)),
            "n_keys": len(tokens) + len(keys), "n_train": int(counts[train].sum()), "docs_train": int(train.sum()),
        }
        return pa.RecordBatch.from_pylist([row], schema=kinds)

    kinds = pa.schema(
        [("chunk", pa.int64()), ("deleted", pa.bool_()), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("train", "counts", "tokens", "place")), ("n_keys", pa.int64()), ("n_train", pa.int64()), ("docs_train", pa.int64())]
    )

    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches, CHUNK_BYTES):
            trained, out = (np.array(batch.column(i).to_pylist(), bool) for i in (1, 2))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for deleted in (False, True):
                rows = np.flatnonzero(out == deleted)
                if len(rows):
                    yield chunk(batch.column(0).take(pa.array(rows)), trained[rows], [texts[i] for i in rows], deleted)

    trained = F.coalesce(train, F.lit(False))
    out = trained & (F.pmod(F.xxhash64(F.col(id_col), F.lit("deleted")), F.lit(DELETED)) == 0)
    cut = docs.select(F.col(id_col).cast("long").alias("id"), trained.alias("train"), out.alias("deleted"), F.col(text_col).alias("text"))
    schema = "chunk long, deleted boolean, ids array<long>, train binary, counts binary, tokens binary, place binary, n_keys long, n_train long, docs_train long"
    return table(cut.mapInArrow(run, schema))


def _chunk(row) -> Chunk:
    return Chunk(_unpack(row["train"]).astype(bool), _unpack(row["counts"]).astype(np.int64), _unpack_sorted(row["tokens"]), _unpack(row["place"]).astype(np.int64))


def _split(keys: np.ndarray, bits: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted keys of ``bits`` bits lie in, by their first ``cut`` bits, and where each begins and the last ends."""
    part = (keys >> np.uint64(1)) >> np.uint64(bits - 1 - cut)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return part[first], np.append(first, len(keys))


def _summed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all rows, their sums of both counts, the place of every row's keys among them, and where rows end.

    A chunk's row has one count; it is left out of the second sum where its documents are deleted.
    """
    held = [_unpack_sorted(b) for b in frame["keys"]]
    ends = np.cumsum([len(h) for h in held])
    keys, place = np.unique(np.concatenate(held), return_inverse=True)
    del held
    add = lambda n: np.bincount(place, n.astype(np.float64), len(keys)).astype(np.uint64)
    total = np.concatenate([_unpack(b) for b in frame["total"]])
    if "rest" in frame:
        rest = np.concatenate([_unpack(b) for b in frame["rest"]])
    else:
        rest = np.where(np.repeat(frame["deleted"].to_numpy(bool), np.diff(ends, prepend=0)), np.uint64(0), total)
    return keys, add(total), add(rest), place, ends


def _sum_shares(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for all of them: their keys and the sums of their counts."""
    keys, total, rest, _, _ = _summed(frame)
    one = frame.iloc[0]
    return pd.DataFrame({"kind": [one["kind"]], "part": [one["part"]], "share": [one["share"]], "shares": [one["shares"]], "keys": [_pack_sorted(keys)], "total": [_pack(total)], "rest": [_pack(rest)]})


def _answer(asked: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """What chunks asked, from the sums of the whole part, or from what they hold themselves where it has one share only.

    The first share of a part of tokens also tells how many of them occur, in a row of no chunk (-1).
    """
    chunk, deleted, total, rest = [], [], [], []
    if len(asked):
        keys, n, n_rest, place, ends = _summed(asked)
        own = n, n_rest
        chunk, deleted = asked["chunk"].to_list(), asked["deleted"].to_list()
    if len(sums):
        row = sums.iloc[0]
        own = _unpack(row["total"]), _unpack(row["rest"])
        if len(asked):
            at = np.searchsorted(_unpack_sorted(row["keys"]), keys)
            n, n_rest = own[0][at], own[1][at]
    one = (sums if len(sums) else asked).iloc[0]
    if len(asked):
        spans = [place[b:e] for b, e in zip(np.append(0, ends[:-1]), ends, strict=True)]
        total, rest = [_pack(n[s]) for s in spans], [_pack(n_rest[s]) if d else None for s, d in zip(spans, deleted, strict=True)]
    seen = [0] * len(chunk), [0] * len(chunk)
    if one["kind"] == 0 and one["share"] == 0:
        chunk, deleted, total, rest = [*chunk, -1], [*deleted, False], [*total, None], [*rest, None]
        seen = tuple([*s, int((x > 0).sum())] for s, x in zip(seen, own, strict=True))
    return pd.DataFrame({"chunk": chunk, "kind": one["kind"], "part": one["part"], "deleted": deleted, "total": total, "rest": rest, "v_total": seen[0], "v_rest": seen[1]})


def answers(made: DataFrame, chunks: int, keys: int) -> DataFrame:
    """For each chunk, kind of key and part: training counts of its keys, all and without the deleted.

    A part cannot be asked by more chunks than there are; only beyond ``PART_ROWS`` chunks parts are counted,
    and those that more chunks ask are dealt to shares. As parts hold ``PART_KEYS`` keys, the sums that are
    sent to all shares of such parts are no more than a few times the keys that chunks hold.
    """
    cut = max(0, math.ceil(math.log2(max(1, keys / PART_KEYS))))

    def ask(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                c = _chunk(row)
                trained = c.trained
                for kind, own, place, bits in ((0, c.tokens, c.place, 64), (1, c.bigrams, c.pair, KEY_BITS)):
                    counts = np.bincount(place[trained], minlength=len(own)).astype(np.uint64)
                    part, ends = _split(own, bits, cut)
                    spans = list(zip(ends[:-1], ends[1:], strict=True))
                    head = [part.astype(np.int64), np.full(len(part), kind, np.int32), np.full(len(part), row["chunk"]), np.full(len(part), row["deleted"])]
                    blobs = [_pack_sorted(own[b:e]) for b, e in spans], [_pack(counts[b:e]) for b, e in spans]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, head), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "kind", "chunk", "deleted", "keys", "total"])

    asked = made.select("chunk", "deleted", "train", "counts", "tokens", "place").mapInArrow(ask, "part long, kind int, chunk long, deleted boolean, keys binary, total binary")
    key, sums = ["kind", "part", "share"], "kind int, part long, share long, shares long, keys binary, total binary, rest binary"
    schema = "chunk long, kind int, part long, deleted boolean, total binary, rest binary, v_total long, v_rest long"
    if chunks <= PART_ROWS:
        whole = asked.withColumn("share", F.lit(0).cast("long"))
        return table(whole.groupBy(*key).applyInPandas(lambda frame: _answer(frame, frame[:0]), schema))
    asked = table(asked)
    hot = table(asked.groupBy("kind", "part").count().where(F.col("count") > PART_ROWS).select("kind", "part", F.ceil(F.col("count") / PART_ROWS).alias("shares")))
    count, most = hot.agg(F.count("*"), F.max("shares")).first()
    hot = lookup(hot, count)
    dealt = asked.join(hot, ["kind", "part"], "left").withColumn("share", F.pmod(F.xxhash64("chunk"), F.coalesce("shares", F.lit(1).cast("long"))))
    whole = dealt.where(F.col("shares").isNotNull()).groupBy(*key).applyInPandas(_sum_shares, sums)
    left = most or 1
    while left > 1:
        whole = table(whole).withColumn("share", F.floor(F.col("share") / FAN)).groupBy(*key).applyInPandas(_sum_shares, sums)
        left = math.ceil(left / FAN)
    sent = table(whole).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    return table(dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(_answer, schema))


@dataclass
class Weights:
    """Mixture weights of bigram, unigram and uniform estimates for each context bucket."""

    table: np.ndarray
    tokens: int
    distinct: int
    docs: int


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket for each power of two."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def _estimates(c: Chunk, replies: pd.DataFrame, column: str, n: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Count of each token, of its context, bigram estimate and unigram estimate."""
    counts = []
    for kind in (0, 1):
        own = replies[replies["kind"] == kind].sort_values("part")
        counts.append(np.concatenate([_unpack(b) for b in own[column]]).astype(np.float64))
    one = counts[0][c.place]
    context = np.roll(one, 1)
    context[c.first] = docs
    two = counts[1][c.pair]
    return one, context, np.divide(two, context, out=np.zeros_like(two), where=context > 0), one / max(1, n)


def learn_weights(made: DataFrame, replies: DataFrame, totals: dict) -> Weights:
    """Deleted interpolation: EM over (bucket, ratio, ratio) cells of the deleted documents."""
    n, docs, uniform = totals["n_rest"], totals["docs_rest"], 1 / (totals["v_rest"] + 1)

    def tally(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"bucket": [], "two": [], "one": [], "n": []})
        c = _chunk(left.iloc[0])
        _, context, two, one = _estimates(c, right, "rest", n, docs)
        level = lambda p: np.where(p > 0, np.round(STEPS * np.log(np.maximum(p, 1e-300) / uniform)), -9999).astype(np.int64)
        cells, count = np.unique(np.stack([buckets(context), level(two), level(one)], 1)[c.trained], axis=0, return_counts=True)
        return pd.DataFrame({"bucket": cells[:, 0], "two": cells[:, 1], "one": cells[:, 2], "n": count})

    left, right = made.where("deleted"), replies.where("deleted").select("chunk", "kind", "part", "rest")
    cells = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInPandas(tally, "bucket long, two long, one long, n long")
    found = cells.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    out[0] = [0.0, 0.85, 0.15]
    for b, cell in found.groupby("bucket"):
        ratio = lambda x: np.where(x > -9999, np.exp(x / STEPS), 0.0)
        p = np.stack([ratio(cell["two"].to_numpy()), ratio(cell["one"].to_numpy()), np.ones(len(cell))], 1)
        w, lam = cell["n"].to_numpy(float), out[int(b)]
        for _ in range(ROUNDS):
            share = p * lam
            lam = (w[:, None] * share / share.sum(1, keepdims=True)).sum(0) / w.sum()
        lam = np.maximum(lam, [0.0, 1e-6, 1e-6])
        out[int(b)] = lam / lam.sum()
    return Weights(out, totals["n"], totals["v"], totals["docs"])


def interpolated_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1) -> DataFrame:
    """One row for each row of ``docs``: id_col (long), n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words with A-Z in lower case, split at the six ASCII white spaces, and one end a document;
    a null or empty text is its end alone. train: which rows the model learns from (null: not). score is
    the model's log10 probability of the text, base_score that of unigrams with ``add`` added to every
    count and to one unknown token. Repeated rows count and are scored each. Without training rows the
    model is uniform over one token. An empty table gives no rows. Texts are whole.
    """
    made = chunks(docs, id_col, text_col, train)
    sums = made.agg(
        F.count("*").alias("chunks"), F.sum("n_keys").alias("keys"), F.sum("n_train").alias("n"), F.sum("docs_train").alias("docs"),
        F.sum(F.when(~F.col("deleted"), F.col("n_train"))).alias("n_rest"), F.sum(F.when(~F.col("deleted"), F.col("docs_train"))).alias("docs_rest"),
    ).first()
    totals = {k: int(v or 0) for k, v in sums.asDict().items()}
    replies = answers(made, totals["chunks"], totals["keys"])
    seen = replies.agg(F.sum("v_total").alias("v"), F.sum("v_rest").alias("v_rest")).first()
    totals |= {k: int(v or 0) for k, v in seen.asDict().items()}
    model = learn_weights(made, replies, totals)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        c = _chunk(row)
        one, context, two, single = _estimates(c, right, "total", model.tokens, model.docs)
        lam = model.table[buckets(context)]
        p = np.log10(lam[:, 0] * two + lam[:, 1] * single + lam[:, 2] / (model.distinct + 1))
        base = np.log10((one + add) / (model.tokens + add * (model.distinct + 1)))
        total = lambda x: np.add.reduceat(x, c.first)
        return pd.DataFrame(
            {"id": pd.array(list(row["ids"]), "Int64"), "n_tokens": c.counts, "n_known": total((one > 0).astype(np.int64)), "train_tokens": model.tokens, "base_score": total(base), "score": total(p)}
        )

    right = replies.where("chunk >= 0").select("chunk", "kind", "part", "total")
    out = made.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInPandas(score, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
