"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Documents become pieces of at most ``capacity`` tokens in parallel tasks. Pieces are dealt by a hash of
their identity into groups of about ``GROUP_BINS`` full sequences each, and every group is packed by
best-fit decreasing with a segment tree over the remaining capacities. A group wastes about one
sequence, so many groups in parallel come within a fraction of a percent of packing all pieces at once.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_batches

#: Full sequences that one packing group holds on average; entries of a task's caches, by generation.
GROUP_BINS, CACHE_RUNS, CACHE_PARTS = 1024, 200_000, 400_000
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: a node counts the open bins below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of at least ``need``: (room, bin)."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not count[node]
        room = node - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; bins are numbered from 0 in the order they are opened."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if found := tree.tightest(need):
            room, bin_ = found
        else:
            room, bin_, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = bin_, capacity - room
        if room > need:
            tree.put(room - need, bin_)
    return bins, offsets


class Cache(dict):
    """What a function gives for a key, kept for about the last ``most`` to twice as many distinct keys."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old, self.parts = make, most, {}, None

    def forget(self) -> None:
        self.old = {}
        self.clear()

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_encoders: dict[str, Cache] = {}
_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Controls that str.split takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile(r"[!-;=?-~\xa1-\xff]*\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: itself if it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


def _encoder(path: str) -> Cache:
    """Token ids, as little-endian unsigned 32-bit numbers, of a run of characters without white space.

    The tokenizer drops white space and splits the rest by its own pattern before it looks for tokens,
    so plain runs are split likewise and every distinct part goes to its model once; other runs (those
    that normalisation may change, or that may hold special tokens) are encoded whole.
    """
    if path not in _encoders:
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        rules = json.loads(tokenizer.to_str())
        pack = lambda ids: np.array(ids, "<u4").tobytes()
        encode = lambda x: pack(tokenizer.encode(x, add_special_tokens=False).ids)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lower = any(n.get("type") == "Lowercase" for n in (rules.get("normalizer") or {}).get("normalizers", []))
        if lower and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            letters, tokenize = _byte_letters(), tokenizer.model.tokenize
            model = lambda x: pack([t.id for t in tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(letters))])
            parts, find = Cache(model, CACHE_PARTS), regex.compile(steps[0]["pattern"]["Regex"]).findall

            def run(x: str) -> bytes:
                if not _PLAIN.match(x):
                    return encode(x)
                x = x.lower()
                if x.isalpha():
                    return parts[x]
                if x[-1] in ".,;:!?" and x[:-1].isalpha():
                    return parts[x[:-1]] + parts[x[-1]]
                return b"".join(map(parts.__getitem__, find(x)))

            _encoders[path] = Cache(run, CACHE_RUNS)
            _encoders[path].parts = parts
        else:
            _encoders[path] = Cache(encode, CACHE_RUNS)
    return _encoders[path]


def _ids(texts: list[str], path: str) -> list[bytes]:
    known = _encoder(path).__getitem__
    return [b"".join(map(known, _CHUNK.findall(t) if _ODD.search(t) else t.split())) for t in texts]


def _forget(path: str) -> None:
    """Drop what a task has cached, as its worker may wait long for the next; the tokenizer stays."""
    for cache in (_encoder(path), _encoder(path).parts):
        if cache is not None:
            cache.forget()


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator) -> Iterator:
        for batch in text_batches(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("id").to_pylist(), _ids([t or "" for t in batch.column("text").to_pylist()], tokenizer_path), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )
        _forget(tokenizer_path)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def pack_best_fit(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bins: int = GROUP_BINS,
) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end_id``; a null or empty text is ``end_id`` alone. Only
    documents longer than ``capacity`` are cut. Pieces in a sequence lie without gaps from offset 0;
    equal lengths keep the order of (id, piece). Repeated rows are packed each. The path of the
    tokenizer file must exist on every executor. An empty table gives no rows.
    """
    slim = tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    slim = table(slim.withColumn("row", F.monotonically_increasing_id()))
    total = slim.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / (capacity * group_bins)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "piece", "start"], kind="stable", na_position="last")
        bins, offsets = best_fit_decreasing(frame["length"].to_numpy(np.int64), capacity)
        return frame.assign(sequence_id=frame["grp"].to_numpy(np.int64) + bins * groups, offset=offsets).drop(columns="grp")

    dealt = slim.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")).drop("row")
    packed = dealt.groupBy("grp").applyInPandas(pack, PIECES + ", sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
