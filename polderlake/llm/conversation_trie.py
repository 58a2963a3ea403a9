"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is the sequence of a conversation's first turns. It is named by its depth and by two running exclusive-ors of
turn hashes that are salted with the turn's place, 128 bits in all. Nodes with more members than a limit are the top of
the trie; the limit grows with the input, so that the top has at most `TOP_NODES` nodes and is broadcast. What hangs
below the top are the shards: each holds the subtree of one node outside the top, however hot the turns above it are.

Within a shard Spark sorts the nodes in reverse level order, spilling to disk. A task reads them in that order and sends
each node's totals forward to its parent through a priority queue that spills as well. When a parent is reached, all
messages to it are at the queue's head. They carry the children's finished rows, which now learn who their parent is.
The totals of shard roots are summed by parent, and the same pass runs over the top.
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

from polderlake.llm.frames import stored
from polderlake.session import freeze

#: Nodes of the top at most, and members that a node outside the top may have in any case.
TOP_NODES = 1 << 17
SHARD_MEMBERS = 100
#: Messages that a queue holds in memory.
QUEUE_ITEMS = 100_000
#: Conversations of one family borrow the opening of the family's first one; at most so many turns less one.
FAMILY = 100
OPENINGS = 6
#: Neighbouring conv_ids that are joined to one string before a digest reads them.
ID_RANGE = 256
NODE = ["depth", "x1", "x2"]
PARENT = ["px1", "px2"]


class SpillingQueue:
    """A priority queue of (key, payload); beyond `items` entries the later half is written out as a sorted run."""

    def __init__(self, items: int = QUEUE_ITEMS):
        self.items = max(items, 2)
        self.heap: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []
        self.sent = 0
        self.in_memory = 0

    def push(self, key: tuple, payload: object) -> None:
        self.sent += 1
        heapq.heappush(self.heap, (key, self.sent, payload, -1))
        self.in_memory += 1
        if self.in_memory > self.items:
            self._spill()

    def _spill(self) -> None:
        own = sorted((x for x in self.heap if x[3] < 0), key=lambda x: x[:2])
        heads = [x for x in self.heap if x[3] >= 0]
        keep, later = own[: self.items // 2], own[self.items // 2 :]
        # A file without a name: it goes with the task, whatever becomes of it.
        file = tempfile.TemporaryFile()
        for key, number, payload, _ in later:
            pickle.dump((key, number, payload, len(self.runs)), file)
        file.seek(0)
        self.runs.append(self._read(file, len(later)))
        self.heap = [*keep, *heads, next(self.runs[-1])]
        heapq.heapify(self.heap)
        self.in_memory = len(keep)

    @staticmethod
    def _read(file, count: int) -> Iterator[tuple]:
        with file:
            for _ in range(count):
                yield pickle.load(file)

    def __bool__(self) -> bool:
        return bool(self.heap)

    def next_key(self) -> tuple | None:
        return self.heap[0][0] if self.heap else None

    def pop(self) -> object:
        _, _, payload, run = heapq.heappop(self.heap)
        if run < 0:
            self.in_memory -= 1
        else:
            following = next(self.runs[run], None)
            if following is not None:
                heapq.heappush(self.heap, following)
        return payload


_FORWARD = ["s1", "s2", *NODE, *PARENT, "conv_id", "n_convs", "chars", "n_children", "n_leaves", "below", "root"]
_DONE = "depth long, x1 long, x2 long, px1 long, px2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, root boolean"


def time_forward(nodes: DataFrame, items: int = QUEUE_ITEMS) -> DataFrame:
    """Subtree totals of `nodes`, whose partitions hold whole shards in reverse level order.

    `n_children`, `n_leaves` and `below` are what a node has received already. A root's row leaves without its parent.
    """
    names = _DONE.replace(" long", "").replace(" boolean", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard, out = SpillingQueue(items), None, []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            made = [pa.array(c, pa.bool_() if n == "root" else pa.int64()) for c, n in zip(columns, names, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            for s1, s2, depth, x1, x2, px1, px2, conv, n_convs, chars, children, leaves, below, root in zip(*(batch.column(c).to_pylist() for c in _FORWARD), strict=True):
                if (s1, s2) != shard:
                    if queue:
                        raise ValueError("messages without a receiver: the shard is not whole")
                    shard = (s1, s2)
                key = (-depth, x1, x2)
                saved = (n_convs - 1) * chars + below
                while queue.next_key() == key:
                    child = queue.pop()
                    children += 1
                    leaves += child[9]
                    saved += child[10]
                    out.append((*child[:6], conv, *child[7:]))
                    if len(out) >= 10_000:
                        yield flushed()
                row = (depth, x1, x2, px1, px2, conv, None, n_convs, children, leaves if children else 1, saved, root)
                if root:
                    out.append(row)
                else:
                    queue.push((1 - depth, px1, px2), row)
            yield flushed()
        if queue:
            raise ValueError("messages without a receiver: the shard is not whole")

    return nodes.select(*_FORWARD).mapInArrow(run, _DONE)


def rebuilt_turns(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each rebuilt conversation's turns with their place, and its number of turns.

    Texts are read once and go on as two hashes and a length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = convs.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.char_length(text).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "t1", "t2")
    turns = stored(turns.withColumn("k", F.row_number().over(order).cast("long")).drop("turn", "role"), "turns")
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    family = F.col("conv_id") % FAMILY
    first = sizes.where(family == 0).select(F.col("conv_id").alias("first_conv"), F.col("n").alias("first_n"))
    named = sizes.select("conv_id", "n", opening.alias("h"), (F.col("conv_id") - family).alias("first_conv")).join(first, "first_conv", "left")
    named = named.withColumn("taken", F.least("h", F.coalesce("first_n", F.lit(0))))
    named = freeze(named.select("conv_id", "first_conv", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    own = turns.join(named.drop("first_conv"), "conv_id").where("k > h").withColumn("depth", F.col("taken") + F.col("k") - F.col("h"))
    openings = turns.where((family == 0) & (F.col("k") < OPENINGS)).withColumnRenamed("conv_id", "first_conv")
    borrowed = named.join(openings, "first_conv").where("k <= h").withColumn("depth", F.col("k"))
    kept = ["conv_id", "depth", "t1", "t2", "chars", "total"]
    return own.select(kept).unionAll(borrowed.select(kept)), named.select("conv_id", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """The turns with the name of the node they lead to and of its parent."""
    salted = turns.withColumn("m1", F.xxhash64("t1", "t2", "depth")).withColumn("m2", F.xxhash64("depth", "t2", "t1", F.lit(2)))
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = salted.withColumn("x1", F.bit_xor("m1").over(along)).withColumn("x2", F.bit_xor("m2").over(along))
    return named.select("conv_id", *NODE, F.col("x1").bitwiseXOR(F.col("m1")).alias("px1"), F.col("x2").bitwiseXOR(F.col("m2")).alias("px2"), "chars", "total")


def digests_of_ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) for nodes where conversations end.

    Neighbouring ids are sorted and joined first; the digest of a node then reads few strings, one after the other.
    """
    ends = rows.where("depth = total").select(*NODE, "conv_id").unionAll(convs.where("total = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = ends.groupBy(*NODE, F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(ids.alias("ids"))
    dealt = ranges.repartition(*NODE).sortWithinPartitions(*NODE, "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def made(found: list[tuple]) -> pa.RecordBatch:
            keys = [pa.array([n[i] for n, _ in found], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([d for _, d in found], pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            found = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != node:
                    if node:
                        found.append((node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield made(found)
        if node:
            yield made([(node, digest.hexdigest())])

    return dealt.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(convs: DataFrame, *, shard_members: int = SHARD_MEMBERS, top_nodes: int = TOP_NODES, queue_items: int = QUEUE_ITEMS) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Null roles and texts are empty, null turns come first; turns with one number are ordered
    by role and then by the text's hash, repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation. Without any conversation there is no root and no row. Columns beside conv_id, turn, role and text are
    not read. A conversation is a path, whose totals pass through one task in bounded memory, however long it is.
    """
    turns, named = rebuilt_turns(convs)
    rows = stored(prefixes(turns), "prefixes")
    limit = max(shard_members, rows.count() // top_nodes)
    nodes = stored(
        rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("px1").alias("px1"), F.max("px2").alias("px2")),
        "nodes",
    )
    zero = F.lit(0).cast("long")
    is_top = F.col("n_convs") > limit
    root = named.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NODE], "n_convs", "conv_id", *[zero.alias(c) for c in ("chars", *PARENT)])
    top = freeze(nodes.where(is_top).unionByName(root))
    top_names = F.broadcast(top.select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("conv_id").alias("top_conv")))

    def on_top(depth, x1, x2):
        return (F.col("_depth") == depth) & (F.col("_x1") == x1) & (F.col("_x2") == x2)

    # The shard of a conversation is its first node outside the top; a node's shard is that of its smallest member.
    outside = rows.select("conv_id", *NODE).join(top_names, on_top(F.col("depth"), F.col("x1"), F.col("x2")), "left_anti")
    shards = outside.groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("s")).select("conv_id", F.col("s.depth").alias("s0"), F.col("s.x1").alias("s1"), F.col("s.x2").alias("s2"))
    below = nodes.where(~is_top).join(shards, "conv_id").withColumn("root", F.col("depth") == F.col("s0"))
    below = below.withColumns({c: zero for c in ("n_children", "n_leaves", "below")})
    dealt = below.repartition("s1", "s2").sortWithinPartitions("s1", "s2", F.desc("depth"), "x1", "x2")
    done = stored(time_forward(dealt, queue_items), "shards")
    roots = done.where("root")
    messages = roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("px1").alias("x1"), F.col("px2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")
    )
    above = top.join(messages, NODE, "left").na.fill(0, ["n_children", "n_leaves", "below"])
    above = above.withColumns({"s1": zero, "s2": zero, "root": F.col("depth") == 0})
    finished = time_forward(above.repartition(1).sortWithinPartitions(F.desc("depth"), "x1", "x2"), queue_items)
    named_roots = roots.join(top_names, on_top(F.col("depth") - 1, F.col("px1"), F.col("px2")))
    kept = [*NODE, *RESULT[:1], *RESULT[2:-1]]
    tree = done.where(~F.col("root")).select(kept).unionAll(finished.select(kept))
    tree = tree.unionAll(named_roots.withColumn("parent_conv_id", F.col("top_conv")).select(kept))
    full = tree.join(digests_of_ends(rows, named), NODE, "left")
    return full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).select(*RESULT)
