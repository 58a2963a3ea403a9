"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors of a label by a key of its own: the signs of random projections, one bit after the other,
read from the left. Near vectors agree in long prefixes and come to lie near each other. A vector is compared with the
next `WINDOW` in the order; pairs that reach the cosine are links. There are as many passes as the label needs.
Vectors that links of any pass connect are one component. In a component all pairs are then checked, in tiles, so that
no link between its members is lost to the window; a tile passes on one count for each vector, not its pairs.

Equal vectors are one vector with a count. A label of up to `BLOCK_ROWS` vectors meets in one task, which makes all of
its passes there: the vectors are shuffled once, however many passes there are. A larger label is dealt into blocks of
about that many neighbours in the order of an outer pass; each block makes its passes, and there are as many outer
passes as it takes for two near vectors to meet in a block. Only the rows of such labels travel more than once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polderlake.llm.components import connected_components
from polderlake.llm.frames import stored, whole_groups
from polderlake.session import freeze

COSINE = 0.93
#: The fewest passes; large labels get more, so that the expected recall of links at the cosine itself is `RECALL`.
PASSES = 12
RECALL = 0.95
WINDOW = 24
BITS = 62
#: Vectors of a label that a task orders at a time: 67 MB of single-precision numbers for vectors of 64.
BLOCK_ROWS = 1 << 18
#: Recall of the passes inside a block of a label that has several blocks; the outer passes make up for the rest.
BLOCK_RECALL = 0.97
#: What rounding to single precision may take from a cosine; pairs that pass are checked in double precision.
ROUNDING = 1e-5
_SLICE = 16_384
#: Members of a component that meet in one tile; larger ones are split into chunks of half as many.
TILE_ROWS = 1024
_SEED = 8
#: Numbers of outer passes' projections begin here, in steps that leave room for a block's own.
_OUTER = 10_000


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows of length one, in double precision."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors.to_numpy(zero_copy_only=False)])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _directions(number: int, size: int) -> np.ndarray:
    return np.random.default_rng([_SEED, number, size]).standard_normal((BITS, size))


def sort_keys(unit: np.ndarray, number: int) -> np.ndarray:
    """The concatenated sign bits of one pass, first bit highest."""
    bits = unit @ _directions(number, unit.shape[1]).T > 0
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _single(vectors: pa.Array) -> np.ndarray:
    """Unit rows in single precision, made a part at a time."""
    return np.concatenate([unit_rows(vectors.slice(start, _SLICE)).astype(np.float32) for start in range(0, len(vectors), _SLICE)])


class Forest:
    """Which rows links connect already; the first row of each group names it."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(onward := self.label[self.label], self.label):
            self.label = onward
        return self.label

    def top(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = self.label[self.label[i]]
            i = self.label[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        self.label[max(a, b)] = min(a, b)


def pass_links(run: np.ndarray, vectors: pa.Array, numbers: list[int], window: int, cosine: float) -> np.ndarray:
    """For each row the first row that it is connected with by the links that passes `numbers` find among rows of one `run`."""
    unit, forest = _single(vectors), Forest(len(run))
    for number in numbers:
        order = np.lexsort((sort_keys(unit, number), run))
        ordered, runs = unit[order], run[order]
        for step in range(1, min(window, len(run) - 1) + 1):
            roots = forest.roots()[order]
            for start in range(0, len(run) - step, _SLICE):
                left, right = slice(start, min(start + _SLICE, len(run) - step)), slice(start + step, min(start + _SLICE, len(run) - step) + step)
                near = (np.einsum("ij,ij->i", ordered[left], ordered[right]) >= cosine - ROUNDING) & (runs[left] == runs[right])
                near &= roots[left] != roots[right]
                found = list(zip(order[left][near].tolist(), order[right][near].tolist(), strict=True))
                if found:
                    one, other = (unit_rows(vectors.take(pa.array(side))) for side in zip(*found, strict=True))
                    exact = np.einsum("ij,ij->i", one, other) >= cosine
                    for (i, j), linked in zip(found, exact.tolist(), strict=True):
                        if linked:
                            forest.join(i, j)
    return forest.roots()


def recall_of_pass(rows: int, size: int, window: int, cosine: float) -> float:
    """Chance that one pass brings two vectors at `cosine` into one window of `rows` vectors in even directions.

    Two keys that first differ in some bit lie on both sides of the middle of those that share the bits before: apart by
    the sum of two even draws from its halves. How many share them depends on the angles, which few dimensions spread.
    Where the vectors have more links than a window by chance alone, links are chains, and half are taken to share a bit.
    """
    widest = math.acos(min(max(cosine, -1.0), 1.0))
    agree = 1 - widest / math.pi
    angles = (np.arange(4000) + 0.5) * math.pi / 4000
    share = np.sin(angles) ** max(size - 2, 0)
    share /= share.sum()
    spread = rows * share[angles <= widest].sum() <= window
    recall, same = 0.0, 1.0
    for bit in range(BITS):
        half = rows / 2 * (float(share @ (1 - angles / math.pi) ** bit) if spread else 0.5**bit)
        reach = min(window / half, 2.0) if half else 2.0
        recall += same * (1 - agree) * (reach * reach / 2 if reach < 1 else 1 - (2 - reach) ** 2 / 2)
        same *= agree
    return recall + same


def passes_for(once: float, recall: float) -> int:
    """Independent passes of recall `once` that together reach `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-once))) if 0 < once < 1 else 1


def passes_needed(rows: int, size: int, window: int, cosine: float, recall: float = RECALL) -> int:
    """Passes that find links at `cosine` among `rows` vectors of `size` numbers with `recall`; `PASSES` at least."""
    return max(PASSES, passes_for(recall_of_pass(rows, size, window, cosine), recall))


def outer_passes(rows: int, size: int, cosine: float, block_rows: int) -> int:
    """How often a label of `rows` vectors is dealt into blocks: once if it is a block itself.

    Two vectors that lie some places apart are cut apart with a chance that grows with the places. As the recall grows with
    the logarithm of the window, that comes to a window of about a third of a block.
    """
    if rows <= block_rows:
        return 1
    return passes_for(recall_of_pass(rows, size, block_rows // 3, cosine) * BLOCK_RECALL, RECALL)


def distinct_vectors(table: DataFrame) -> DataFrame:
    """(label, embedding, rep, n): equal vectors of a label once, with their smallest id and their number.

    Vectors that can't link are left out: null, empty or zero, or with components that are null or not finite.
    """
    fit = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    fit &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return table.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def _outer_keys(vectors: DataFrame, with_vectors: bool) -> DataFrame:
    """(pass, label, size, key, rep and, if asked for, embedding): a row for each outer pass of the vector's label."""
    schema = T.StructType().add("pass", "integer").add("label", "long").add("size", "integer").add("key", "long").add("rep", "long")
    if with_vectors:
        schema = schema.add("embedding", vectors.schema["embedding"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                outer, size = part.column("outer").to_numpy(), part.column("size").to_numpy()
                for width, times in {*zip(size.tolist(), outer.tolist(), strict=True)}:
                    chosen = part.take(pa.array(np.flatnonzero((size == width) & (outer == times))))
                    unit = unit_rows(chosen.column("embedding")) if times > 1 else None
                    for number in range(times):
                        n = chosen.num_rows
                        # A label that is one block needs no order.
                        key = sort_keys(unit, _OUTER + number) if unit is not None else np.zeros(n, np.int64)
                        columns = [pa.array(np.full(n, number, np.int32)), chosen.column("label"), chosen.column("size"), pa.array(key), chosen.column("rep")]
                        yield pa.RecordBatch.from_arrays(columns + [chosen.column("embedding")] * with_vectors, schema.names)

    return vectors.select("label", "size", "outer", "rep", "embedding").mapInArrow(run, schema)


def blocked(vectors: DataFrame, crowds: DataFrame, block_rows: int) -> DataFrame:
    """The vectors by outer pass, label, length and block; blocks have even numbers of rows, wherever the vectors are dense."""
    sized = vectors.withColumn("size", F.size("embedding"))
    named = sized.join(crowds.select("label", "size", "outer"), ["label", "size"])
    large = crowds.where("outer > 1")
    blocks = int(large.agg(F.max(F.ceil(F.col("rows") / block_rows))).first()[0] or 1)
    dealt = _outer_keys(named, True)
    if blocks == 1:
        return dealt.withColumn("block", F.lit(0))
    shares = F.array(*[F.lit((i + 1) / blocks) for i in range(blocks - 1)])
    keys = _outer_keys(named.where("outer > 1"), False)
    cuts = keys.groupBy("pass", "label", "size").agg(F.percentile_approx("key", shares, F.lit(max(10_000, 20 * blocks))).alias("cuts"))
    # A smaller label takes only every so many-th of the cuts.
    every = F.greatest(F.lit(1), F.floor(F.lit(blocks) / F.ceil(F.col("rows") / block_rows))).cast("int")
    own = cuts.join(large.select("label", "size", every.alias("every")), ["label", "size"])
    own = freeze(own.select("pass", "label", "size", F.filter("cuts", lambda x, i: (i + 1) % F.col("every") == 0).alias("cuts")))
    placed = dealt.join(own, ["pass", "label", "size"], "left")
    block = F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("key"))), F.lit(0))
    return placed.withColumn("block", F.when(F.col("cuts").isNull(), 0).otherwise(block)).drop("cuts")


def window_pass_links(vectors: DataFrame, passes: int | None, window: int, cosine: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(low, high) for representatives that links of the passes of one block connect: the smallest with each other one."""
    counted = freeze(vectors.groupBy("label", F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("rows")))
    # Labels of one block, however many there are, need no more than to be left as they are.
    several = [(row["label"], row["size"], outer_passes(row["rows"], row["size"], cosine, block_rows)) for row in counted.where(F.col("rows") > block_rows).toLocalIterator()]
    outer = vectors.sparkSession.createDataFrame(several, "label long, size int, outer int")
    crowds = freeze(counted.join(outer, ["label", "size"], "left").withColumn("outer", F.coalesce("outer", F.lit(1))))
    groups = ["pass", "label", "size", "block"]
    dealt = blocked(vectors, crowds, block_rows).repartition(*groups).sortWithinPartitions(*groups, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, starts in whole_groups(batches, groups, 8192):
            number, size, rep = (data.column(name).to_numpy() for name in ("pass", "size", "rep"))
            embedding = data.column("embedding").combine_chunks()
            embedding = embedding.chunk(0) if isinstance(embedding, pa.ChunkedArray) else embedding
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            for width, outer in {*zip(size.tolist(), number.tolist(), strict=True)}:
                at = np.flatnonzero((size == width) & (number == outer))
                # Equal keys can make a block larger than it should be: it is then cut where it stands.
                for low in range(0, len(at), 2 * block_rows):
                    rows = at[low : low + 2 * block_rows]
                    largest = int(np.bincount(owner[rows] - owner[rows[0]]).max())
                    several_blocks = largest > block_rows // 2
                    wanted = passes or passes_needed(largest, width, window, cosine, BLOCK_RECALL if several_blocks else RECALL)
                    root = pass_links(owner[rows], embedding.take(pa.array(rows)), [outer * _OUTER + k for k in range(wanted)], window, cosine)
                    # A star around the smallest of each group: what links connect is one step from it.
                    smallest = np.full(len(rows), np.iinfo(np.int64).max)
                    np.minimum.at(smallest, root, rep[rows])
                    center = smallest[root]
                    tied = center != rep[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(center[tied]), pa.array(rep[rows][tied])], ["low", "high"])

    return dealt.select(*groups, "rep", "embedding").mapInArrow(run, "low long, high long")


def links_in_components(members: DataFrame, cosine: float) -> DataFrame:
    """(rep, n_links): vectors linked directly to each representative, counted over all pairs of its component."""
    crowded = members.groupBy("component").count()
    chunks = F.ceil(F.col("count") / (TILE_ROWS // 2)).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, F.col("chunk")).alias("a"), F.greatest(j, F.col("chunk")).alias("b")))
    tiled = (
        members.join(freeze(crowded), "component")
        .withColumn("chunks", F.when(F.col("count") <= TILE_ROWS, 1).otherwise(chunks))
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        .select("component", "rep", "n", "embedding", "chunk", F.explode(pair).alias("tile"))
        .select("component", F.col("tile.a").alias("a"), F.col("tile.b").alias("b"), "rep", "n", "embedding", "chunk")
    )
    groups = ["component", "a", "b"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, starts in whole_groups(batches, groups, TILE_ROWS):
            reps, n, chunk, a, b = (data.column(name).to_numpy() for name in ("rep", "n", "chunk", "a", "b"))
            embedding = data.column("embedding").combine_chunks()
            linked = np.zeros(data.num_rows, np.int64)
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                unit = unit_rows(embedding.slice(start, end - start))
                near = unit @ unit.T >= cosine
                np.fill_diagonal(near, False)
                if a[start] != b[start]:  # pairs inside a chunk are counted in its own tile
                    near &= chunk[start:end, None] != chunk[None, start:end]
                linked[start:end] = near @ n[start:end]
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(linked)], ["rep", "linked"])

    dealt = tiled.repartition(*groups).sortWithinPartitions(*groups)
    return dealt.mapInArrow(count, "rep long, linked long").groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_duplicates(table: DataFrame, *, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `table` (vec_id, embedding, label).

    Only vectors with equal labels that are not null are compared. A vector that is null, empty or zero or holds a null or
    a number that isn't finite links with nothing, nor does a row without a vec_id (its component_id is null, it is not
    kept). Vectors of different lengths are never linked. Equal vectors of a label are linked. Rows are kept one by
    one: a repeated row is one vector more. Without `passes` their number grows with the label (`passes_needed`).
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    vectors = stored(distinct_vectors(rows), "vectors")
    joined = connected_components(window_pass_links(vectors, passes, window, cosine, block_rows), "low", "high")
    members = stored(vectors.join(joined, F.col("rep") == F.col("node")).select("component", "rep", "n", "embedding"), "members")
    counted = links_in_components(members, cosine)
    component = joined.join(counted, F.col("node") == F.col("rep"), "left").select(F.col("node"), "component", F.coalesce("linked", F.lit(0)).alias("linked"))
    named = vectors.join(freeze(component), F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), F.coalesce("component", "rep").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    same = (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("vec_id").isNotNull()
    out = rows.join(named, same, "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))
