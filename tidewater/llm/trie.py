"""Prefix trie of conversations, with totals of every subtree by time-forward processing.

Turns are range-partitioned and sorted by conversation, so that a conversation of any length is dealt over
several partitions and numbered across them. A node stands for a sequence of first turns; its key is the XOR
of one number a turn, taken from the SHA-256 of the turn's place and content, so that running keys can be
computed partition by partition and carried on across them (120 bits; equal keys count as equal sequences).

A node's weight is the number of turns that its members have from it on, which bounds the nodes below it.
Weights fall along every path. Nodes heavier than a thousandth of all turns (``SHARDS``) are the top of the
trie, at most ``SHARDS`` of them at a depth; what hangs below a top node falls into whole subtrees, the shards.
Spark deals shards to tasks and sorts a task's nodes by reverse level order. Each node takes the messages that
wait for it in a priority queue, which spills sorted runs to a file, and sends its totals to its parent. What
shard roots send is added up by parent in Spark; then the top's nodes are processed the same way, across shards.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, lookup, table

#: Shares of all turns of which a shard holds one at most; messages that a queue holds in memory; identifiers
#: of a chunk of members.
SHARDS, IN_MEMORY, CHUNK = 1000, 1 << 18, 1 << 14


class SpillingQueue:
    """A priority queue of tuples: what exceeds ``most`` in memory goes to sorted runs in a file of the task's own."""

    def __init__(self, most: int = IN_MEMORY) -> None:
        self.most, self.heap, self.runs = most, [], []

    def push(self, item: tuple) -> None:
        if len(self.heap) >= self.most:
            run = tempfile.TemporaryFile()  # noqa: SIM115  gone with the task
            for x in sorted(self.heap):
                pickle.dump(x, run, pickle.HIGHEST_PROTOCOL)
            run.seek(0)
            self.runs.append([pickle.load(run), run])
            self.heap = []
        heapq.heappush(self.heap, item)

    def first(self) -> tuple | None:
        return min([*self.heap[:1], *(head for head, _ in self.runs)], default=None)

    def pop(self) -> tuple:
        item = self.first()
        if self.heap and self.heap[0] == item:
            return heapq.heappop(self.heap)
        run = next(r for r in self.runs if r[0] == item)
        try:
            run[0] = pickle.load(run[1])
        except EOFError:
            run[1].close()
            self.runs.remove(run)
        return item


def _forward(most: int, top: bool):
    """Totals of nodes that come in reverse level order: (depth, x1, x2, p1, p2, root, own, children, leaves, saved) each,
    where the last three are what has come from other tasks. ``top``: the nodes of the top, otherwise of whole shards."""

    def run(batches: Iterator) -> Iterator:
        queue = SpillingQueue(most)
        for batch in batches:
            out: list[tuple] = []
            for depth, x1, x2, p1, p2, root, own, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, saved = (-depth, x1, x2), saved + own
                while (head := queue.first()) is not None and head[:3] == key:
                    _, _, _, more_leaves, more_saved = queue.pop()
                    children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
                leaves = leaves or 1
                if depth and (top or not root):
                    queue.push((1 - depth, p1, p2, leaves, saved))
                out.append((depth, x1, x2, children, leaves, saved))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6, names=["depth", "x1", "x2", "children", "leaves", "saved"])

    return run


_TOTALS = "depth long, x1 long, x2 long, children long, leaves long, saved long"


def _numbered_in_task(batches: Iterator) -> Iterator:
    """Places of sorted turns within their conversation, as far as this task has it."""
    last, at = None, 0
    for batch in batches:
        places = []
        for c in batch.column(0).to_pylist():
            at = at + 1 if c == last else 0
            last = c
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])


def sorted_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, place, digest, words) of every turn; place counts from 0 in the order of turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv_id IS NOT NULL")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    words = F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long")
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("part"), digest.alias("digest"), words.alias("words"))
    parts = table(cut.mapInArrow(_numbered_in_task, "conv_id long, part int, digest string, words long, place long"))
    held = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # of a conversation that lies in one part nothing is before; others are no more than parts
    carry = table(held.withColumn("before", F.sum("n").over(before)).where("before IS NOT NULL").select("conv_id", "part", "before"))
    placed = parts.join(lookup(carry, carry.count()), ["conv_id", "part"], "left")
    return placed.select("conv_id", "part", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")


def shared_heads(turns: DataFrame, every: int, most: int) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then the own ones after the first h.

    turns: as from ``sorted_turns``. h is crc32(decimal c) % (most + 1). Gives (conv_id, part, at, digest, words, n):
    at counts from 0, n is the rebuilt length, part orders runs of turns; a conversation without turns has one row
    whose ``at`` is null.
    """
    c = F.col("conv_id")
    head = F.crc32(c.cast("string")) % (most + 1)
    heads = turns.where((c % every == 0) & (F.col("place") < most)).groupBy(c.alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("lead"))  # ``most`` turns each
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": head, "base": c - c % every})
    convs = convs.join(heads, "base", "left").withColumn("lead", F.expr("slice(coalesce(lead, array()), 1, cast(h AS int))"))
    convs = convs.withColumn("k", F.size("lead").cast("long"))
    convs = table(convs.select("conv_id", "h", "k", "lead", (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("k")).alias("n")))
    few = convs.select("conv_id", "h", "k", "n")
    own = turns.join(lookup(few, few.count()), "conv_id").where("place >= h").select("conv_id", "part", (F.col("place") - F.col("h") + F.col("k")).alias("at"), "digest", "words", "n")
    lead = convs.select("conv_id", "n", F.explode_outer("lead").alias("t")).select("conv_id", F.lit(-1).alias("part"), F.col("t.place").alias("at"), "t.digest", "t.words", "n")
    return own.unionByName(lead.where("at IS NOT NULL OR n = 0").select(*own.columns))


def running_keys(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, p1, p2, words, n): for every turn the key of the node that it leads to, and of its parent."""
    mark = F.sha2(F.concat(F.col("at").cast("string"), F.lit(":"), "digest"), 256)
    bits = lambda first: F.conv(F.substring("mark", first, 15), 16, 10).cast("long")
    marked = rebuilt.where("at IS NOT NULL").withColumn("mark", mark).select("conv_id", "part", "at", bits(1).alias("m1"), bits(16).alias("m2"), "words", "n")
    marked = table(marked)
    runs = marked.groupBy("conv_id", "part").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = table(runs.select("conv_id", "part", F.bit_xor("m1").over(before).alias("c1"), F.bit_xor("m2").over(before).alias("c2")).where("c1 IS NOT NULL"))
    upto = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = marked.withColumns({"x1": F.bit_xor("m1").over(upto), "x2": F.bit_xor("m2").over(upto)})
    whole = own.join(lookup(carry, carry.count()), ["conv_id", "part"], "left").withColumns({x: F.col(x).bitwiseXOR(F.coalesce(c, F.lit(0))) for x, c in (("x1", "c1"), ("x2", "c2"))})
    return whole.select("conv_id", (F.col("at") + 1).alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("m2")).alias("p2"), "words", "n")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, conv_id) -> (depth, x1, x2, ends): SHA-256 of each node's identifiers, ascending, joined by commas.

    Nodes and identifiers are range-partitioned together, so that the members of one node are dealt over several
    tasks, which join them to chunks; a node's chunks are then hashed in order.
    """
    key = ["depth", "x1", "x2"]

    def chunks(batches: Iterator) -> Iterator:
        node, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=[*key, "first", "ids"])

        for batch in batches:
            for *at, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (at != node or len(held) >= CHUNK):
                    yield out()
                    held = []
                node = at
                held.append(c)
        if held:
            yield out()

    def digests(batches: Iterator) -> Iterator:
        node, sha = None, None

        def out() -> tuple:
            return (*node, sha.hexdigest())

        for batch in batches:
            done: list[tuple] = []
            for *at, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != node:
                    if node:
                        done.append(out())
                    node, sha = at, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if done:
                yield _ends(done)
        if node:
            yield _ends([out()])

    def _ends(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*key, "ends"])

    cut = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").select(*key, "conv_id")
    cut = table(cut.mapInArrow(chunks, "depth long, x1 long, x2 long, first long, ids string"))
    return cut.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digests, "depth long, x1 long, x2 long, ends string")


def subtree_totals(nodes: DataFrame, members: DataFrame, shards: int = SHARDS, in_memory: int = IN_MEMORY) -> DataFrame:
    """(depth, x1, x2, children, leaves, saved) of every node: children, childless nodes and saved words of its subtree.

    nodes: (depth, x1, x2, p1, p2, conv_id, weight, own). members: (conv_id, depth, x1, x2), which has the path of
    every node's conv_id. No node is processed in two shards, and what a task holds is its queue.
    """
    key = ["depth", "x1", "x2"]
    total = nodes.agg(F.max("weight")).first()[0]
    least = max(1, (total or 0) // shards)
    heavy = (F.col("weight") > least) | (F.col("depth") == 0)
    top = table(nodes.where(heavy))
    count = top.count()
    # the root of the shard that a node is in: the first light node on its way, which its own conv_id passes too
    light = members.join(lookup(top.select(*key), count), key, "left_anti")
    roots = table(light.groupBy("conv_id").agg(F.min_by(F.struct("depth", F.col("x1").alias("r1"), F.col("x2").alias("r2")), "depth").alias("r")).select("conv_id", F.col("r.depth").alias("r0"), "r.r1", "r.r2"))
    below = nodes.where(~heavy).join(lookup(roots, roots.count()), "conv_id")
    zero = F.lit(0).cast("long")
    sent = [zero.alias("children"), zero.alias("leaves"), zero.alias("saved")]
    work = below.select(*key, "p1", "p2", (F.col("depth") == F.col("r0")).alias("root"), "own", *sent, "r0", "r1", "r2")
    order = [F.col("depth").desc(), "x1", "x2"]
    columns = [*key, "p1", "p2", "root", "own", "children", "leaves", "saved"]
    in_shards = table(work.repartition("r0", "r1", "r2").sortWithinPartitions(*order).select(*columns).mapInArrow(_forward(in_memory, False), _TOTALS))
    shard_roots = below.where("depth = r0").select(*key, "p1", "p2").join(in_shards, key)
    messages = shard_roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    across = top.join(messages, key, "left").na.fill(0, ["children", "leaves", "saved"])
    above = across.select(*key, "p1", "p2", F.lit(True).alias("root"), "own", "children", "leaves", "saved").coalesce(1).sortWithinPartitions(*order).mapInArrow(_forward(in_memory, True), _TOTALS)
    return in_shards.unionByName(table(above))


def prefix_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 20, most: int = 3, shards: int = SHARDS, in_memory: int = IN_MEMORY
) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see ``shared_heads``), from the textless root on.

    Gives conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Turns without a conv_id take no part. Null roles and texts are empty. Turns of equal number (null
    comes first, and may repeat) go by role and text. % keeps the sign of its left side. Texts may have any
    length. No turns give no nodes. The top of the trie is one task's work: ``shards`` nodes at a depth at most,
    so the longest path bounds it.
    """
    rebuilt = table(shared_heads(table(sorted_turns(turns, id_col, turn_col, role_col, text_col)), every, most))
    members = table(running_keys(rebuilt))
    key = ["depth", "x1", "x2"]
    weight = F.col("n") - F.col("depth") + 1
    least = lambda c: F.min(c).alias(c)
    inner = members.groupBy(*key).agg(least("p1"), least("p2"), least("conv_id"), F.count("*").alias("n_convs"), F.sum(weight).alias("weight"), F.min("words").alias("words"))
    zero = F.lit(0).cast("long")
    # every rebuilt conversation has one row that is its first, or its only one without a turn
    start = rebuilt.where("at IS NULL OR at = 0")
    root = start.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), (F.sum("n") + F.count("*")).alias("weight")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in (*key, "p1", "p2")), "conv_id", "n_convs", "weight", zero.alias("words"))
    nodes = table(inner.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("words")))
    totals = subtree_totals(nodes, members, shards, in_memory)
    none = rebuilt.where("at IS NULL").select(*(zero.alias(c) for c in key), "conv_id")
    ends = table(ends_digests(members.where("depth = n").select(*key, "conv_id").unionByName(none)))
    parents = nodes.select(F.col("depth").alias("d"), F.col("x1").alias("q1"), F.col("x2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    count = nodes.count()
    out = nodes.join(lookup(totals, count), key).join(lookup(ends, count), key, "left")
    out = out.join(lookup(parents, count), (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left")
    return out.select(
        F.col("conv_id").alias(id_col), "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
