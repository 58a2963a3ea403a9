"""Phrase collocations counted in quotient filters.

The texts are cut into shards of `SHARD_BYTES` by the tasks that read them; a shard numbers its own words. Word counts
of all shards are summed; words that are frequent enough for a phrase get a number of their own, and each shard learns
the numbers of its words by a join, so that no table of words is sent to all tasks. All other words end a run, as the
marks between pieces do: no phrase can hold them.

A phrase of up to four word numbers is packed, permuted and counted in a quotient filter. Tasks cut their filters into
slices by the first bits of the quotient; equal slices of all shards meet and are merged in sorted order. Pairs are
counted first. Longer phrases are counted where all of their pairs are frequent, which a Bloom filter of fixed size tells:
what it lets through by mistake is counted as well and drops out for its count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polderlake.llm.frames import Sent, chunks, stored
from polderlake.llm.quotient_filter import Keys, QuotientFilter, counted, merged, mixed, restored, slices, unpacked
from polderlake.llm.words import LOWER

LEAST = 30
LONGEST = 4
FIRST = 2000
SHARE = (80, 100)
SCALE = 2_000_000
SHARD_BYTES = 4_000_000
#: Text of all languages that a task holds before it lets its shards go.
HELD_BYTES = 8_000_000
#: Phrases that a task holds before its filters go on, and occurrences that meet in a slice on average.
HELD_PHRASES = 500_000
SLICE_PHRASES = 500_000
#: Frequent words that are numbered in one task.
NUMBERED = 100_000
BLOOM_BITS = 27
_BLOCK_BITS = 19
_SALTS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
_SPACE, _MARK, _WORD = 0, 1, 2
_CLASS = np.full(256, _WORD, dtype=np.uint8)
_CLASS[[0x09, 0x20]] = _SPACE
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _MARK


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, numbers): the words of all texts by their place in the first array plus 1, and 0 where a piece ends."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.fill_null("").cast(pa.binary())), b"\n")[0].as_buffer()
    data = LOWER[np.frombuffer(whole, dtype=np.uint8)]
    kind = _CLASS[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = kind == _WORD
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    letters = pa.py_buffer(data[inside[1:-1] > 0])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), letters]).dictionary_encode()
    piece = np.cumsum(kind == _MARK)[start]
    ends_piece = np.concatenate([piece[1:] != piece[:-1], [True]])
    numbers = np.zeros(len(start) + int(ends_piece.sum()), dtype=np.int32)
    numbers[np.arange(len(start)) + np.cumsum(ends_piece) - ends_piece] = words.indices.to_numpy() + 1
    return words.dictionary.cast(pa.binary()).cast(pa.string()), numbers


def shards_of(docs: DataFrame, shard_bytes: int, held_bytes: int) -> DataFrame:
    """(shard, lang, tokens, words, counts): pieces of the corpus in one language, encoded by their own words."""
    source = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}

        def shard(lang: str) -> pa.RecordBatch:
            words, numbers = numbered_words(pa.concat_arrays(held.pop(lang)))
            del size[lang]
            count = np.bincount(numbers, minlength=len(words) + 1)[1:]
            columns = [pa.array([uuid.uuid4().hex]), pa.array([lang]), pa.array([numbers.astype("<i4").tobytes()], pa.binary())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), a) for a in (words, pa.array(count, pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "tokens", "words", "counts"])

        for batch in chunks(batches, "text", shard_bytes // 4):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.column("text").filter(pc.equal(batch.column("lang"), lang)).cast(pa.binary())
                held.setdefault(lang, []).append(own)
                size[lang] = size.get(lang, 0) + pc.sum(pc.binary_length(own)).as_py()
                if size[lang] >= shard_bytes:
                    yield shard(lang)
            while sum(size.values()) > held_bytes:
                yield shard(max(size, key=size.get))
        for lang in list(held):
            yield shard(lang)

    return source.mapInArrow(run, "shard string, lang string, tokens binary, words array<string>, counts array<long>")


def word_numbers(words: DataFrame) -> DataFrame:
    """(lang, word, f, id): ids without gaps from 1, given within even parts of the words and shifted by the parts before."""
    n = words.count()
    parts = 1 + n // NUMBERED
    dealt = words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)))
    before = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    shifted = dealt.withColumn("at", within).join(before.select("part", F.coalesce("before", F.lit(0)).alias("before")), "part")
    return stored(shifted.select("lang", "word", "f", (F.col("before") + F.col("at")).cast("long").alias("id")), "numbers")


def runs_of(shards: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, ids): each shard's runs of frequent words by their numbers, 0 between runs; runs of one word are left out."""
    local = shards.select("shard", "lang", F.posexplode("words").alias("at", "word")).join(known, ["lang", "word"])
    tables = stored(local.groupBy("shard").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id")), "shard-numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), "<i4")
                at, ids = (batch.column(c)[i].values.to_numpy() for c in ("at", "id"))
                table = np.zeros(int(tokens.max(initial=0)) + 1, dtype=np.uint32)
                table[at + 1] = ids
                made = table[tokens]
                word = np.concatenate([[False], made > 0, [False]])
                beside = word[:-2] | word[2:]
                # A word beside another stays, and so does one break after each run.
                stays = (made > 0) & beside
                after = np.concatenate([[False], stays[:-1]]) & ~stays
                made = np.where(stays, made, 0)[stays | after]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, 1), pa.array([made.astype("<u4").tobytes()], pa.binary())], ["lang", "ids"])

    return stored(shards.select("shard", "lang", "tokens").join(tables, "shard").select("lang", "tokens", "at", "id").mapInArrow(run, "lang string, ids binary"), "runs")


def phrases_of(ids: np.ndarray, words: int, pair_ok: np.ndarray | None) -> np.ndarray:
    """All phrases of `words` words as rows of four numbers; with `pair_ok` only those whose pairs are all allowed."""
    n = len(ids) - words + 1
    if n <= 0:
        return np.zeros((0, LONGEST), np.uint32)
    good = np.ones(n, dtype=bool)
    for k in range(words - 1 if pair_ok is not None else words):
        good &= pair_ok[k : k + n] if pair_ok is not None else ids[k : k + n] > 0
    at = np.flatnonzero(good)
    out = np.zeros((len(at), LONGEST), np.uint32)
    for k in range(words):
        out[:, k] = ids[at + k]
    return out


def _places(first: np.ndarray, second: np.ndarray, size: int) -> list[np.ndarray]:
    """Two bits of a Bloom filter for each pair."""
    joint = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
    return [(mixed(joint, salt) >> np.uint64(64 - size)).astype(np.int64) for salt in _SALTS]


def pairs_filter(pairs: DataFrame, size: int = BLOOM_BITS) -> np.ndarray:
    """The bytes of a Bloom filter of `pairs`, 2**size bits whatever their number; its blocks are made where their bits meet."""
    block = min(_BLOCK_BITS, size)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy().reshape(-1, 2)
            place = np.unique(np.concatenate(_places(ids[:, 0], ids[:, 1], size)))
            yield pa.RecordBatch.from_arrays([pa.array(place >> block), pa.array(place & ((1 << block) - 1))], ["block", "place"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            number, place = batch.column("block").to_numpy(), batch.column("place").to_numpy()
            for b in np.unique(number).tolist():
                own.setdefault(b, np.zeros(1 << block, np.uint8))[place[number == b]] = 1
        packed = [np.packbits(x).tobytes() for x in own.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(packed, pa.binary())], ["block", "bits"])

    dealt = pairs.select("ids").mapInArrow(bits, "block long, place long").distinct().repartition(F.col("block"))
    out = np.zeros((1 << size) // 8, np.uint8)
    width = (1 << block) // 8
    for row in dealt.mapInArrow(blocks, "block long, bits binary").collect():
        out[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def frequent_phrases(runs: DataFrame, lengths: list[int], bits: int, slice_bits: int, least: int, allowed: np.ndarray | None = None) -> DataFrame:
    """(lang, ids, f) of the phrases of `lengths` words that occur at least `least` times in their language."""
    sent = Sent(runs.sparkSession, allowed) if allowed is not None else None
    bloom_size = (len(allowed) * 8).bit_length() - 1 if allowed is not None else 0

    def shard_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Keys]] = {}

        def emitted(lang: str) -> pa.RecordBatch:
            made = [(s, QuotientFilter.of(k, s, slice_bits).stored) for s, k in slices(merged(held.pop(lang)), slice_bits)]
            columns = [pa.array([lang] * len(made), pa.string()), pa.array([s for s, _ in made], pa.int64()), pa.array([f for _, f in made], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "slice", "filter"])

        for batch in batches:
            for i in range(batch.num_rows):
                lang, ids = batch.column("lang")[i].as_py(), np.frombuffer(batch.column("ids")[i].as_buffer(), "<u4")
                ok = None
                if sent is not None and len(ids):
                    table, pairs = sent.get(), (ids[:-1] > 0) & (ids[1:] > 0)
                    ok = pairs
                    for place in _places(ids[:-1], ids[1:], bloom_size):
                        ok = ok & ((table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1) > 0)
                found = [counted(p, bits) for m in lengths if len(p := phrases_of(ids, m, ok))]
                if not found:
                    continue
                held[lang] = [merged([*held.get(lang, []), *found])]
                while sum(len(k[0]) for k in held.values()) > HELD_PHRASES:
                    yield emitted(max(held, key=lambda x: len(held[x][0])))
        for lang in list(held):
            yield emitted(lang)

    def merged_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        levels: list[Keys] = []

        def add(keys: Keys) -> None:
            # Filters of about one size are merged with each other, so every key is moved a logarithmic number of times.
            levels.append(keys)
            while len(levels) > 1 and len(levels[-2]) <= 2 * len(levels[-1]):
                levels[-2:] = [merged(levels[-2:])]

        def result() -> Iterator[pa.RecordBatch]:
            if levels:
                keys = merged(levels)
                keys = keys.part(keys.count >= least)
                ids = unpacked(*restored(keys.high, keys.low, keys.half), bits)
                size = (ids > 0).sum(axis=1)
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids[ids > 0], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(keys), pa.string()), lists, pa.array(keys.count, pa.int64())], ["lang", "ids", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("lang")[i].as_py(), batch.column("slice")[i].as_py())
                if key != now:
                    yield from result()
                    now, levels[:] = key, []
                add(QuotientFilter(batch.column("filter")[i].as_buffer().to_pybytes()).keys())
        yield from result()

    filters = runs.mapInArrow(shard_filters, "lang string, slice long, filter binary")
    dealt = filters.repartition("lang", "slice").sortWithinPartitions("lang", "slice")
    return stored(dealt.mapInArrow(merged_filters, "lang string, ids array<long>, f long"), "phrases")


def scored(phrases: DataFrame, words: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, ids, a, l, r, score) of each phrase: the cut with the lowest score, the first of equal ones. Exact."""
    known = phrases.select("ids", "f").unionAll(words.select(F.array("id").alias("ids"), "f"))
    cut = phrases.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.withColumn("head", F.expr("slice(ids, 1, k)")).withColumn("tail", F.expr("slice(ids, k + 1, size(ids) - k)"))
    cut = cut.join(known.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(known.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr(f"cast({scale} as decimal(10, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cut.groupBy("lang", "ids").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def independent(phrases: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The phrases without those that stand in a longer one with at least `share` of their occurrences."""
    m = F.size("ids")
    longer = phrases.where(m > 2).select("ids", "a")
    parts = longer.select("a", "ids", F.explode(F.sequence(F.lit(2), m - 1)).alias("w")).select("a", "ids", "w", F.explode(F.expr("sequence(1, size(ids) - w + 1)")).alias("i"))
    held = parts.select(F.expr("slice(ids, i, w)").alias("ids"), F.col("a").alias("outer")).groupBy("ids").agg(F.max("outer").alias("outer"))
    part, whole = share
    covers = F.expr(f"cast({whole} as decimal(10, 0)) * cast(outer as decimal(19, 0)) >= cast({part} as decimal(10, 0)) * cast(a as decimal(19, 0))")
    return phrases.join(held, "ids", "left").where(F.col("outer").isNull() | ~covers).drop("outer")


def collocations(
    docs: DataFrame, *, least: int = LEAST, first: int = FIRST, shard_bytes: int = SHARD_BYTES, held_bytes: int = HELD_BYTES, slice_phrases: int = SLICE_PHRASES, bloom_bits: int = BLOOM_BITS
) -> DataFrame:
    """The `first` best phrases of two to four words of each language, from columns `lang` and `text`.

    Columns: lang, rank (from 1), phrase, a, l, r, n, score. A null language is `und` like that name itself, an empty
    name is a language of its own; null and empty texts have no words. Repeated rows count as often as they stand.
    Ties go to the larger count, then to the phrase in the order of its bytes. Without a phrase that is frequent enough
    the result is empty. Memory: a task holds `held_bytes` of text or one text if longer, filters of `HELD_PHRASES`
    distinct phrases, or one slice of the merged filters, which the permutation makes about equal.
    """
    shards = stored(shards_of(docs, shard_bytes, held_bytes), "phrase-shards")
    entries = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    counts = stored(entries.groupBy("lang", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("f")), "word-counts")
    totals = stored(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = word_numbers(counts.where(F.col("f") >= least))
    bits = max(1, words.count().bit_length())
    if bits > 32:
        raise ValueError("more frequent words than numbers of 32 bits")
    occurrences = totals.agg(F.sum("n")).first()[0] or 0
    slice_bits = min((occurrences // slice_phrases).bit_length(), 2 * bits)
    runs = runs_of(shards, words.select("lang", "word", "id"))
    pairs = frequent_phrases(runs, [2], bits, slice_bits, least)
    allowed = pairs_filter(pairs, bloom_bits)
    longer = frequent_phrases(runs, list(range(3, LONGEST + 1)), bits, slice_bits, least, allowed)
    phrases = stored(scored(pairs.unionAll(longer), words.select("id", "f")), "scored")
    kept = independent(phrases)
    # Ties with the last place stay until the words are there to settle them.
    near = stored(kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= first).drop("place"), "best")
    spelled = near.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = near.join(spelled, "ids").withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
