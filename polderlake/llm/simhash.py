"""SimHash near-duplicates, compared by bit slices.

Fingerprints that differ in at most `radius` of 64 bits agree in at least two of `radius + 2` equal parts. Each pair of
parts is a key under which distinct fingerprints meet. The fingerprints of a block are stored as 64 bit planes, one
machine word for 64 fingerprints. A query adds plane after plane to carry-save counters that start so that they overflow
at radius + 1. It is compared with the fingerprints behind it, a group of machine words at a time; a group is abandoned
once all of its counters have overflowed.

A key with more than `KEY_ROWS` fingerprints is split into chunks, and each pair of chunks is a block of its own.
A block passes on a star for each group it finds, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polderlake.llm.components import connected_components
from polderlake.llm.frames import chunks, starts_of_groups, stored, without
from polderlake.llm.words import byte_class, words_of
from polderlake.session import freeze

IN_WORD = byte_class([(0x09, 0x0D), (0x20, 0x20)])
SHINGLE = 3
RADIUS = 2
#: Rows of a key that meet in one block; larger keys are split into chunks of half as many.
KEY_ROWS = 2048
BLOCK_ROWS = 4096
#: Machine words that are compared, and abandoned, together.
GROUP_WORDS = 16
_SEED = 42
_COUNT_ROWS = 32_768
CHUNK_BYTES = 400_000


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """A row of 8 bytes, high byte first, for each text: bit by bit the majority of its shingles' XXH64."""
    words = words_of(texts, IN_WORD, hashed=False)
    ends = np.cumsum(words.end - words.start + 1)
    begins = ends - (words.end - words.start + 1)
    # The words with one space after each, so that a shingle is a slice.
    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, np.minimum(words.end + 1, len(words.data)), -1)
    taken = np.cumsum(inside[:-1]) > 0
    spaced = words.data.copy()
    spaced[np.minimum(words.end, len(spaced) - 1)] = 0x20
    buffer = spaced[taken].tobytes()
    counts = words.counts
    n_shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    owner_first = np.cumsum(n_shingles) - n_shingles
    first = np.arange(n_shingles.sum()) - np.repeat(owner_first, n_shingles) + np.repeat(words.first[:-1], n_shingles)
    last = np.minimum(first + shingle, np.repeat(words.first[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(buffer[a:b], _SEED) for a, b in zip(begins[first].tolist(), (ends[last] - 1).tolist(), strict=True)),
        dtype=">u8",
        count=len(first),
    )
    set_bits = np.zeros((len(texts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), n_shingles)
    for start in range(0, len(hashes), _COUNT_ROWS):
        part = owner[start : start + _COUNT_ROWS]
        bits = np.unpackbits(hashes[start : start + _COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        set_bits[part[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > n_shingles[:, None], axis=1)


class BitPlanes:
    """Fingerprints stored bit by bit: plane p holds bit p of all of them, 64 to a word."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        width = -(-self.n // 64) * 64
        padded = np.zeros((64, width), dtype=np.uint8)
        padded[:, : self.n] = self.bits.T
        self.planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
        unused = np.zeros(width, dtype=np.uint8)
        unused[self.n :] = 1
        self.unused = np.packbits(unused, bitorder="little").view("<u8")
        #: Groups of machine words compared with a set of queries, those abandoned, and planes read for all of them.
        self.groups = self.abandoned = self.planes_read = 0

    def within(self, start: int, stop: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, later fingerprint) for all pairs within `radius` bits, the queries being numbers `start` to `stop`.

        A query is compared with later fingerprints only, `GROUP_WORDS` machine words at a time. A group is abandoned
        once the counters of all its pairs have overflowed.
        """
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        size = max(1, radius.bit_length())
        first = (1 << size) - (radius + 1)
        asked = np.where(self.bits[start:stop] > 0, every, np.uint64(0))
        queries, partners = [], []
        for low in range(start // 64, self.planes.shape[1], GROUP_WORDS):
            high = min(low + GROUP_WORDS, self.planes.shape[1])
            shape = (stop - start, high - low)
            counters = [np.full(shape, every if first >> i & 1 else 0, dtype=np.uint64) for i in range(size)]
            over = np.broadcast_to(self.unused[low:high], shape).copy()
            if low * 64 < stop:
                # Fingerprints up to the query itself need no comparison.
                earlier = np.arange(low * 64, high * 64) <= np.arange(start, stop)[:, None]
                over |= np.packbits(earlier, axis=1, bitorder="little").view("<u8")
            self.groups += 1
            for plane in range(64):
                carry = self.planes[plane, low:high] ^ asked[:, plane, None]
                for i, counter in enumerate(counters):
                    onward = counter & carry
                    counters[i] = counter ^ carry
                    carry = onward
                over |= carry
                if plane % 4 == 3 and (over == every).all():
                    self.abandoned += 1
                    self.planes_read += plane + 1
                    break
            else:
                self.planes_read += 64
                query, partner = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
                queries.append(query + start)
                partners.append(partner + low * 64)
        return np.concatenate([*queries, np.zeros(0, int)]), np.concatenate([*partners, np.zeros(0, int)])


def stars(values: np.ndarray, radius: int, queries: int = 64) -> list[tuple[int, int]]:
    """(smallest value, other value) for each group of distinct `values` that links within `radius` connect."""
    planes = BitPlanes(values.view(np.uint64))
    label = np.arange(len(values))
    for start in range(0, len(values), queries):
        asked, partners = planes.within(start, min(start + queries, len(values)), radius)
        for query in np.unique(asked):
            joined = np.unique(label[[query, *partners[asked == query]]])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    out = []
    order = np.argsort(label, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(group) > 1:
            low = int(values[group].min())
            out += [(low, int(v)) for v in values[group] if v != low]
    return out


def fingerprint_column(docs: DataFrame, column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs` with `simhash` (long, the bits of the fingerprint) instead of the text. Null and empty texts have 0."""
    kept = without(docs.drop(column), "simhash").columns
    source = docs.select(*kept, column)
    schema = source.drop(column).schema.add("simhash", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, column, CHUNK_BYTES):
            made = fingerprints(piece.column(column).to_pylist(), shingle)
            signed = np.ascontiguousarray(made).view(">i8").ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(piece.column(name) for name in kept), pa.array(signed)], schema.names)

    return source.mapInArrow(run, schema)


def links(prints: DataFrame, radius: int = RADIUS, column: str = "simhash") -> DataFrame:
    """(low, high) star links that connect all distinct values of `column` within `radius` bits of each other."""
    parts = radius + 2
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    value = F.col(column)

    def part(i: int):
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned(value, edges[i]).bitwiseAND(F.lit((1 << width) - 1))

    keys = [
        F.shiftleft(part(i), edges[j + 1] - edges[j]).bitwiseOR(part(j)).alias("key")
        for i, j in combinations(range(parts), 2)
    ]
    keyed = prints.select(value, F.posexplode(F.array(*keys)).alias("set", "key"))
    crowded = keyed.groupBy("set", "key").count().where(F.col("count") > KEY_ROWS)
    chunks = F.coalesce(F.ceil(F.col("count") / (KEY_ROWS // 2)), F.lit(1)).cast("int")
    tile = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda j: F.struct(F.least(j, F.col("chunk")).alias("a"), F.greatest(j, F.col("chunk")).alias("b")),
        )
    )
    tiled = (
        keyed.join(crowded, ["set", "key"], "left")
        .withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64(value), F.col("chunks")).cast("int"))
        .select("set", "key", column, tile.alias("tile"))
        .select("set", "key", "tile.a", "tile.b", column)
    )
    groups = ["set", "key", "a", "b"]
    dealt = tiled.repartition(*groups).sortWithinPartitions(*groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if values:
                found = stars(np.unique(np.concatenate(values)), radius)
                low, high = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["low", "high"])

        block: list[np.ndarray] = []
        size = 0
        rest: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                data = pa.Table.from_batches([batch])
                rest = data if rest is None else pa.concat_tables([rest, data]).combine_chunks()
            if rest is None or not rest.num_rows:
                continue
            starts = starts_of_groups(rest, groups)
            values = rest.column(column).to_numpy()
            done = len(starts) - 1 if batch is None else len(starts) - 2
            for group in np.flatnonzero(np.diff(starts[: done + 1]) > 1):
                members = values[starts[group] : starts[group + 1]]
                if size and size + len(members) > BLOCK_ROWS:
                    yield from compared(block)
                    block, size = [], 0
                block.append(members)
                size += len(members)
            rest = rest.slice(starts[done])
        yield from compared(block)

    return dealt.mapInArrow(run, "low long, high long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


RESULT = ("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", column: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) for each row of `docs`.

    `fingerprint` is 16 lower-case hex digits. Fingerprints that differ in at most `radius` bits are linked;
    `component_id` is the smallest id that links reach. Null and empty texts have fingerprint 0 and are linked like any
    other. Equal fingerprints are compared once, however many rows have them. Rows are kept one by one, repeated ones too.
    A null id names no component: if no row of a component has an id, its component_id is null.
    """
    out = _grouped(docs, id_column, column, shingle, radius)
    return out.select(id_column, F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def _text_hash(column: str):
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null")))


def _grouped(docs: DataFrame, id_column: str, column: str, shingle: int, radius: int) -> DataFrame:
    """(id, _text, simhash, component_id) for each row; `_text` is a hash of the text."""
    source = docs.select(F.col(id_column), _text_hash(column).alias("_text"), F.col(column))
    prints = stored(fingerprint_column(source, column, shingle), "simhash")
    smallest = freeze(prints.groupBy("simhash").agg(F.min(id_column).alias("smallest")))
    joined = connected_components(links(smallest.select("simhash"), radius), "low", "high")
    member = smallest.join(joined, F.col("simhash") == F.col("node"), "left").select("simhash", "smallest", F.coalesce("component", "simhash").alias("root"))
    member = freeze(member)
    least = freeze(member.groupBy("root").agg(F.min("smallest").alias("component_id")))
    named = freeze(member.join(least, "root").select(F.col("simhash").alias("_print"), "component_id"))
    return prints.join(named, F.col("simhash") == F.col("_print"))


def one_of_each_group(docs: DataFrame, *, id_column: str = "doc_id", column: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`docs` without the documents that are not the first of their group, row by row.

    Rows that share an id and a text are one document and stay or go together. A row without an id goes if its group has
    a document with one; groups without any id have no first document and stay.
    """
    found = _grouped(docs, id_column, column, shingle, radius)
    later = found.where(F.col("component_id").isNotNull() & ~F.col(id_column).eqNullSafe(F.col("component_id")))
    later = later.select(F.col(id_column).alias("_id"), F.col("_text").alias("_later")).distinct()
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (_text_hash(column) == F.col("_later"))
    return docs.join(later, same, "left_anti").select(docs.columns)
