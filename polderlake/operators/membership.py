"""Membership of many keys in a Bloom filter of fixed size, in plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter, 1 MB; beyond some half a million keys it lets more rows through than it should, but loses none.
FILTER_BITS = 1 << 23
HASHES = 4


def _places(keys: Sequence[Column], bits: int, hashes: int) -> list[Column]:
    """The bits of one key. Two hashes give all of them."""
    one, two = F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)
    step = two.bitwiseAND(F.lit((1 << 31) - 1))
    return [F.pmod(one.bitwiseAND(F.lit((1 << 62) - 1)) + step * i, F.lit(bits)) for i in range(hashes)]


@dataclass(frozen=True)
class KeyFilter:
    """The words of a filter (one row with an array of longs), read by every row that asks."""

    words: DataFrame
    bits: int
    hashes: int

    def may_hold(self, df: DataFrame, *keys: str) -> DataFrame:
        """`df` with a boolean column `_held`: false for keys that are surely not in the filter. Null keys count as keys."""
        asked = [F.coalesce(F.col(key).cast("string"), F.lit("\0")) for key in keys]
        # The words stay outside the rows: each test reads one of them.
        words = self.words.select("words").scalar()
        tests = F.lit(True)
        for place in _places(asked, self.bits, self.hashes):
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            tests = tests & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return df.withColumn("_held", tests)


def filter_bits(keys: int) -> int:
    """16 bits for each key, rounded up to a power of two, between 4,096 bits and `FILTER_BITS`."""
    return min(FILTER_BITS, max(1 << 12, 1 << (16 * max(keys, 1) - 1).bit_length()))


def key_filter(df: DataFrame, *keys: str, bits: int = FILTER_BITS, hashes: int = HASHES) -> KeyFilter:
    """A Bloom filter of the keys in `df`; its size depends on `bits` alone.

    Bits are gathered by word, words are put in order into one array: `bits` / 64 numbers, whatever the number of keys.
    """
    asked = [F.coalesce(F.col(key).cast("string"), F.lit("\0")) for key in keys]
    places = df.select(F.explode(F.array(*_places(asked, bits, hashes))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    # Every word has its place in the array, those without a bit too.
    numbered = df.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    listed = numbered.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
    array = listed.select(F.transform("w", lambda x: x["bits"]).alias("words"))
    return KeyFilter(array, bits, hashes)
