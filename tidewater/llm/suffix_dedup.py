"""Removal of byte strings that occur elsewhere, by sorting sampled suffixes.

Two equal strings of ``length`` bytes have, at the same offset, the same smallest gram (of half that
length); so only the suffixes that start at such anchors are sorted, about one in fifty. Leading token
of a suffix is the hash of its gram; second token the hash of its span: all ``length``-byte windows that
share the anchor. Spark's sampled splitters range-partition the suffixes by these tokens; a partition
is sorted by the leading token in Spark and its ties by multikey quicksort, neighbours are compared, and
what stands at its ends is compared across the boundary.
Suffixes with both tokens in common repeat as a whole. Where only the leading token is shared, the
single windows of the span become suffixes of their own and are sorted the same way.
"""

from __future__ import annotations
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, table, text_batches

#: Bytes of a text that are hashed at once, less than 2**PLACE_BITS.
PIECE, PLACE_BITS = 1 << 19, 20
#: Most rows of one group that a task holds.
HELD = 200_000
_rng = np.random.default_rng(0x5EED)
_BYTE, _OTHER_BYTE = (_rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, 2 * PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _tables["up"] = np.cumprod(np.concatenate((one, np.full(size - 1, _BASE))))
        _tables["down"] = np.cumprod(np.concatenate((one, np.full(size - 1, inverse))))
    return _tables["up"], _tables["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(line: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    up, _ = _powers(len(line) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[line] * up[: len(line)], dtype=np.uint64)))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, the same wherever they stand."""
    _, down = _powers(len(prefix))
    return _mix((prefix[end] - prefix[start]) * down[start])


def pieces_of(raw: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to pieces: (bytes, text number, first byte in the piece, first byte in the text).

    Long texts are cut so that every window of ``length`` bytes lies in one piece whole.
    """
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for k, text in enumerate(raw):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            if held and held + len(part) > PIECE:
                yield _joined(parts)
                parts, held = [], 0
            parts.append((k, at, part))
            held += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for _, _, p in parts])
    return np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), np.array([k for k, _, _ in parts]), np.cumsum(sizes) - sizes, np.array([at for _, at, _ in parts])


def anchors(line: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: part number, first window, number of windows, both tokens."""
    gram = length // 2
    prefix, n = prefix_hash(line), len(line)
    _, down = _powers(n + 1)
    at = np.arange(n - gram + 1)
    grams = _mix((prefix[gram:] - prefix[: n - gram + 1]) * down[: n - gram + 1])
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~place) | at.astype(np.uint64)
    width, wide = 1, length - gram + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: n - length + 1], least[wide - width :])
    anchor = (least & place).astype(np.int64)
    part = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))[: n - length + 1]
    ends = np.append(first[1:], n)
    fits = np.arange(n - length + 1) + length <= ends[part]
    starts = np.flatnonzero(fits & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
    stops = np.flatnonzero(fits & np.concatenate(((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | ~fits[1:], [True])))
    shape = ((anchor[starts] - starts) * (length + 1) + stops - starts).astype(np.uint64)
    second = span_hash(prefix, starts, stops + length) ^ _mix(shape + np.uint64(1))
    return part[starts], starts, stops - starts + 1, grams[anchor[starts]], second


ROW = "g long, s long, id long, sig long, p long, n int"
_NAMES = ["g", "s", "id", "sig", "p", "n"]


def _rows(g, s, ids: pa.Array, sig, p, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), ids, pa.array(sig, pa.int64()), pa.array(p, pa.int64()), pa.array(n, pa.int32())], names=_NAMES)


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches, PIECE):
            sigs = batch.column("sig").to_numpy()
            for line, text, first, at in pieces_of([(t or "").encode() for t in batch.column("text").to_pylist()], length):
                part, start, n, g, s = anchors(line, first, length)
                own = text[part]
                yield _rows(g.view(np.int64), s.view(np.int64), batch.column("id").take(pa.array(own)), sigs[own], start - first[part] + at[part], n)

    return texts.mapInArrow(run, ROW)


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(.., runs) -> every window of the runs as a suffix of its own; its tokens are two hashes of it, by other values of the bytes."""

    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches, PIECE):
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode()
                sig, ids = batch.column("sig")[i].as_py(), batch.column("id").slice(i, 1)
                runs = sorted({(r["p"], r["n"]) for r in batch.column("runs")[i].as_py()})
                for lo in range(0, len(raw), PIECE):
                    own = np.array([r for r in runs if lo <= r[0] < lo + PIECE], np.int64).reshape(-1, 2)
                    if not len(own):
                        continue
                    end = int(own.sum(1).max()) + length - 1
                    line = np.frombuffer(raw[lo:end], np.uint8)
                    p = np.repeat(own[:, 0] - np.cumsum(own[:, 1]) + own[:, 1], own[:, 1]) + np.arange(own[:, 1].sum())
                    g, s = (span_hash(prefix_hash(line, values), p - lo, p - lo + length).view(np.int64) for values in (_BYTE, _OTHER_BYTE))
                    yield _rows(g, s, ids.take(pa.array(np.zeros(len(p), np.int64))), np.full(len(p), sig), p, np.ones(len(p), np.int32))

    return texts.mapInArrow(run, ROW)


def _next_segments(start: np.ndarray, sizes: np.ndarray, depth: np.ndarray, depths: int) -> tuple[np.ndarray, ...]:
    """Segments of more than one row that parts (less, equal, greater: rows of ``sizes``) leave to be sorted."""
    first = (start + np.cumsum(sizes, 0) - sizes).ravel()
    deep = (depth + np.array([[0], [1], [0]])).ravel()
    left = (sizes.ravel() > 1) & (deep < depths)
    return first[left], sizes.ravel()[left], deep[left]


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their tokens: multikey quicksort; rows of equal tokens keep their order.

    A segment is parted in three by a pivot's token at its depth; the equal part goes on with the next token.
    All segments are parted in the same steps. Where rows come in order of the first token, only its ties are sorted.
    """
    rows, n = np.stack(tokens), len(tokens[0])
    order = np.arange(n)
    start, size, depth = np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)
    if n and (rows[0, 1:] >= rows[0, :-1]).all():
        new = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        sizes = np.stack([np.zeros_like(new), np.diff(np.append(new, n)), np.zeros_like(new)])
        start, size, depth = _next_segments(new, sizes, np.zeros_like(new), len(tokens))
    while n and len(start):
        own = np.repeat(np.arange(len(start)), size)
        begin = np.cumsum(size) - size
        place = np.arange(len(own)) - begin[own]
        at = order[start[own] + place]
        value, pivot = rows[depth[own], at], rows[depth, order[start + size // 2]][own]
        sizes, ahead = [], np.zeros(len(start), np.int64)
        for part in (value < pivot, value == pivot, value > pivot):
            upto = np.concatenate(([0], np.cumsum(part)))
            sizes.append(upto[begin + size] - upto[begin])
            of = own[part]
            order[start[of] + ahead[of] + upto[:-1][part] - upto[begin][of]] = at[part]
            ahead = ahead + sizes[-1]
        start, size, depth = _next_segments(start, np.stack(sizes), depth, len(tokens))
    return order


def _classify(g: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of sorted suffixes if their groups are whole, and if the groups may go on elsewhere.

    Whole: "r" repeats; "o" shares only the leading token; "ro" repeats, and stands for the spans equal to
    it beside others with its leading token. Elsewhere: "r" repeats; "e" is yet alone; "re" repeats, and
    stands for the spans equal to it.
    """
    new_g = np.concatenate(([True], g[1:] != g[:-1]))
    new_s = new_g | np.concatenate(([True], s[1:] != s[:-1]))
    group, span = np.cumsum(new_g) - 1, np.cumsum(new_s) - 1
    size, spans = np.bincount(span)[span], np.bincount(group, new_s)[group]
    edge = np.where(size == 1, "e", np.where(new_s, "re", "r")).astype("U2")
    whole = np.where(size > 1, np.where((spans > 1) & new_s, "ro", "r"), np.where(spans > 1, "o", "")).astype("U2")
    return whole, edge


def _neighbours(batches: Iterator) -> Iterator:
    """Sort the ties of one partition, which comes in order of the leading token, and compare neighbours.

    Suffixes that are like no neighbour are left out.

    The first and the last group may go on in the partition before or after: they get the kinds "e" and
    "re", and so does a group of more than HELD rows, so that no group is held whole.
    """
    rest, first, flushed = None, None, None

    def out(batch: pa.RecordBatch, at_edge: bool = False) -> pa.RecordBatch:
        g, s = (batch.column(k).to_numpy() for k in (0, 1))
        order = multikey_order([g, s])
        g, s, batch = g[order], s[order], batch.take(pa.array(order))
        whole, edge = _classify(g, s)
        kind = edge if at_edge else np.where((g == first) | (g == flushed if flushed is not None else False), edge, whole)
        keep = np.flatnonzero(kind != "")
        edge = (kind[keep] == "e") | (kind[keep] == "re")
        tokens = [pa.array(np.where(edge, x[keep], 0)) for x in (g, s)]
        others = [batch.column(k).take(pa.array(keep)) for k in range(2, 6)]
        return pa.RecordBatch.from_arrays([*tokens, *others, pa.array(kind[keep].astype(object), pa.string())], names=[*_NAMES, "kind"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        g = batch.column(0).to_numpy()
        first = g[0] if first is None else first
        change = np.flatnonzero(g[1:] != g[:-1])
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield out(batch.slice(0, cut))
        rest = batch.slice(cut)
        if rest.num_rows > HELD:
            flushed = g[-1]
            yield out(rest, at_edge=True)
            rest = None
    if rest is not None:
        yield out(rest, at_edge=True)


def compare_suffixes(suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): suffixes that repeat as a whole, and those whose single windows are to be compared."""
    tokens = ["g", "s", "id", "p"]
    done = table(suffixes.repartitionByRange(*tokens).sortWithinPartitions("g").mapInArrow(_neighbours, ROW + ", kind string"))
    edge = done.where("kind IN ('e', 're')")
    again = (F.count(F.lit(1)) > 1) | F.bool_or(F.col("kind") == "re")
    spans = table(edge.groupBy("g", "s").agg(again.alias("again"), F.min(F.struct("id", "sig", "p")).alias("least")))
    groups = table(spans.groupBy("g").agg(F.count(F.lit(1)).alias("spans")))
    stats = table(spans.join(lookup(groups, groups.count()), "g"))
    settled = table(edge.join(lookup(stats, stats.count()), ["g", "s"]).drop("g", "s"))
    cols = ["id", "sig", "p", "n"]
    repeated = done.where("kind IN ('r', 'ro', 're')").select(*cols).unionByName(settled.where("again AND kind = 'e'").select(*cols))
    stands = (F.col("spans") > 1) & F.struct("id", "sig", "p").eqNullSafe(F.col("least"))
    return repeated, done.where("kind IN ('o', 'ro')").select(*cols).unionByName(settled.where(stands).select(*cols))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row for each row of ``docs``: id_col (long), n_bytes, spans (start, end), kept (binary).

    Texts are UTF-8 bytes, a null text is empty. Each byte that a string of ``length`` bytes covers which
    also starts anywhere else, in the same text or another, overlaps included, is removed; strings are
    judged on the input, and never reach over two texts. spans are the maximal removed runs, kept is what
    is left. Repeated rows repeat each other, so of them nothing but the rest of texts below ``length``
    stays. Texts shorter than ``length`` stay whole. An empty table gives no rows. Strings count as equal if
    two 64-bit hashes of them are (of gram and span, or of the window by two tables of byte values); texts of
    rows which share or lack an identifier if one is. length: an even number of bytes.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sig"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated, opened = compare_suffixes(_suffixes(texts, length))
    runs = opened.groupBy("id", "sig").agg(F.collect_set(F.struct("p", "n")).alias("runs"))
    named = runs.withColumnsRenamed({"id": "r_id", "sig": "r_sig"})
    same = lambda x: F.col("id").eqNullSafe(F.col(f"{x}_id")) & (F.col("sig") == F.col(f"{x}_sig"))
    windows, _ = compare_suffixes(_windows(texts.join(named, same("r")).select("id", "sig", "runs", "text"), length))
    covered = repeated.unionByName(windows).groupBy("id", "sig")
    # repeated rows of one identifier and text give the same spans, of which one stays
    spans = covered.agg(F.collect_set(F.struct(F.col("p").alias("start"), (F.col("p") + F.col("n") + (length - 1)).alias("end"))).alias("found"))
    joined = texts.join(spans.withColumnsRenamed({"id": "s_id", "sig": "s_sig"}), same("s"), "left").select("id", "found", "text")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator) -> Iterator:
        for batch in text_batches(batches, 1 << 22):
            sizes, removed, kept = [], [], []
            for k in range(batch.num_rows):
                raw, found = batch.column("text")[k].as_py().encode(), batch.column("found")[k]
                sizes.append(len(raw))
                merged: list[dict] = []
                if found.is_valid:
                    flat = found.values.flatten()
                    start, end = (x.to_numpy() for x in flat)
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    heads = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                    tails = np.append(heads[1:], len(start)) - 1
                    merged = [{"start": int(start[a]), "end": int(reach[b])} for a, b in zip(heads, tails, strict=True)]
                edges = [0, *(x for m in merged for x in (m["start"], m["end"])), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, span_type), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    out = joined.mapInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
