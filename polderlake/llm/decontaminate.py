"""Benchmark decontamination with an FM-index per training shard.

A task cuts its documents into shards of a few megabytes. The words of a shard become numbers: those of the benchmark's
phrases their own, all others 0. Runs without 0 that are long enough for a phrase are indexed: suffix array, the
preceding symbols (the transform) in a wavelet tree with ranks, and sampled suffix positions. All phrases are searched
backwards at once; the places of those that occur are found by walking to the next sampled position. The places merge
into spans of words to remove.

The phrases are the 13-word windows of the benchmark items. They are the query set: they go to the tasks in blocks of
bounded size, and all documents are searched for every block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polderlake.llm.frames import Sent, chunks, stored, without
from polderlake.llm.words import byte_class, words_of

IN_WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
WINDOW = 13
SHARD_BYTES = 6_000_000
BLOCK_WORDS = 500_000
SAMPLE = 8


class WaveletTree:
    """Ranks in a sequence of numbers below 2**bits: one bit row per level, stably partitioned by the bits above."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        values = values.copy()
        for level in reversed(range(bits)):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each `symbol` occurs before each `end`."""
        low, high = np.zeros_like(end), end.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            one_low, one_high = ones[low], ones[high]
            low = np.where(bit, zeros + one_low, low - one_low)
            high = np.where(bit, zeros + one_high, high - one_high)
        return high - low


def suffix_order(values: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling; only suffixes that are still tied are sorted again."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.searchsorted(values[order], values, "left").astype(np.int64)
    width = 1
    tied = np.arange(n)
    while True:
        sizes = np.bincount(rank, minlength=n)
        tied = tied[sizes[rank[tied]] > 1]
        if not len(tied):
            break
        following = np.where(tied + width < n, rank[np.minimum(tied + width, n - 1)] + 1, 0)
        own = rank[tied]
        by = np.lexsort((following, own))
        own, following, tied = own[by], following[by], tied[by]
        new_group = np.concatenate([[True], own[1:] != own[:-1]])
        changed = new_group | np.concatenate([[True], following[1:] != following[:-1]])
        at = np.arange(len(tied))
        base = np.maximum.accumulate(np.where(new_group, at, 0))
        first = np.maximum.accumulate(np.where(changed, at, 0))
        rank[tied] = own + (first - base)
        width *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Counts and places of phrases in a sequence of positive numbers; 0 ends the sequence."""

    def __init__(self, values: np.ndarray):
        values = np.concatenate([values, [0]]).astype(np.int64)
        order = suffix_order(values)
        self.n = len(values)
        before = values[order - 1]
        self.tree = WaveletTree(before, max(1, int(values.max()).bit_length()))
        self.before = before
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=int(values.max()) + 1))])
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.tree.rank(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [low, high) of each phrase; phrases are right-aligned rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > back) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - back]
            known = symbol < len(self.smaller) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of the suffix in each row: steps back to the next sampled position, plus the steps."""
        out = np.zeros(len(rows), np.int64)
        rows, open_rows = rows.copy(), np.arange(len(rows))
        for steps in range(SAMPLE):
            here = self.sampled[rows]
            out[open_rows[here]] = self.samples[self.sample_rank[rows[here]]] + steps
            rows, open_rows = rows[~here], open_rows[~here]
            if not len(rows):
                break
            rows = self._step(self.before[rows], rows)
        return out


@dataclass
class Phrases:
    """One block of the query set: word hashes in order, phrases as numbers of words, and the items of each phrase."""

    words: np.ndarray
    spelled: list[bytes]
    phrases: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int) -> Phrases:
        found: dict[tuple[bytes, ...], set[str]] = {}
        hashes: dict[bytes, int] = {}
        for item, text in items:
            words = words_of([text], IN_WORD)
            spelled = [words.word(i) for i in range(len(words.start))]
            hashes.update(zip(spelled, words.hash.tolist(), strict=True))
            for start in range(max(1, len(spelled) - window + 1) if spelled else 0):
                found.setdefault(tuple(spelled[start : start + window]), set()).add(item)
        order = sorted(hashes, key=hashes.__getitem__)
        number = {word: i + 2 for i, word in enumerate(order)}  # 1 parts the runs, 0 ends them
        phrases = np.zeros((len(found), window), np.int64)
        for row, phrase in enumerate(found):
            phrases[row, window - len(phrase) :] = [number[word] for word in phrase]
        return cls(
            np.array([hashes[word] for word in order], np.uint64),
            order,
            phrases,
            np.array([len(phrase) for phrase in found], np.int64),
            [sorted(owners) for owners in found.values()],
        )


def search_shard(texts: list[str | None], block: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Words of each text, its merged spans of hit words [start, end), and the items that occur in it."""
    words = words_of(texts, IN_WORD)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not len(block.phrases) or not len(words.start):
        return words.counts, spans, items
    at = np.minimum(np.searchsorted(block.words, words.hash), len(block.words) - 1)
    known = block.words[at] == words.hash
    # Runs of known words inside one text; those shorter than every phrase hold none.
    new_text = np.zeros(len(known), dtype=bool)
    new_text[words.first[:-1][words.first[:-1] < len(known)]] = True
    opens = known & (new_text | ~np.concatenate([[False], known[:-1]]))
    run = np.cumsum(opens) - 1
    run[~known] = -1
    keep = known.copy()
    if opens.any():
        keep[known] = np.bincount(run[known])[run[known]] >= block.lengths.min()
    place = np.flatnonzero(keep)
    if not len(place):
        return words.counts, spans, items
    parted = np.concatenate([[0], (np.diff(run[place]) != 0).cumsum()])
    values = np.ones(len(place) + parted[-1], np.int64)
    spot = np.arange(len(place)) + parted
    values[spot] = at[place] + 2
    origin = np.full(len(values), -1, np.int64)
    origin[spot] = place
    index = FMIndex(values)
    low, high = index.search(block.phrases, block.lengths)
    hits = np.flatnonzero(high > low)
    if not len(hits):
        return words.counts, spans, items
    counts = (high - low)[hits]
    which = np.repeat(hits, counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[hits], counts)
    begin = origin[index.locate(rows)]
    text_of = np.searchsorted(words.first, begin, "right") - 1
    covered = np.zeros(len(known) + 1, np.int64)
    for phrase, first, text in zip(which.tolist(), begin.tolist(), text_of.tolist(), strict=True):
        size = int(block.lengths[phrase])
        numbers = block.phrases[phrase, -size:]
        if all(words.word(first + i) == block.spelled[numbers[i] - 2] for i in range(size)):  # no hash in common by chance
            covered[first] += 1
            covered[first + size] -= 1
            items[text].update(block.items[phrase])
    hit = (np.cumsum(covered) > 0).astype(np.int8)
    edges = np.diff(np.concatenate([[0], hit, [0]]))
    for start, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        while start < end:  # a span never reaches over the end of a text
            text = int(np.searchsorted(words.first, start, "right")) - 1
            stop = min(end, int(words.first[text + 1]))
            spans[text].append((start - int(words.first[text]), stop - int(words.first[text])))
            start = stop
    return words.counts, spans, items


def blocks_of(benchmark: DataFrame, item: str, column: str, window: int, words: int) -> Iterator[Phrases]:
    """The benchmark in blocks of about `words` words; only one block is on the driver at a time."""
    held: list[tuple[str, str | None]] = []
    size = 0
    for name, text in benchmark.select(F.col(item).cast("string"), F.col(column)).toLocalIterator():
        held.append((name if name is not None else "", text))
        size += len((text or "").split()) + 1
        if size >= words:
            yield Phrases.of(held, window)
            held, size = [], 0
    yield Phrases.of(held, window)


RESULT = ("n_words", "spans", "items", "n_hit", "n_items", "items_sha256", "contaminated")
_SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, column: str = "text", item: str = "item_id", benchmark_column: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with what of the benchmark occurs in each text.

    Adds `n_words`, `spans` (merged runs of hit words, as word numbers from 0, end excluded), `n_hit`, `items` (the items
    that occur, sorted as strings), `n_items`, `items_sha256` and `contaminated` (at least one word in twenty is hit);
    they replace columns of those names. A null or empty text has no words and is clean. A null item id counts as
    the empty string. An empty benchmark marks nothing. Rows are kept one by one, repeated ones too.

    One pass over the documents for each block of the benchmark, without a shuffle; with several blocks the rows are
    stored between passes.
    """
    current = without(docs, *RESULT)
    plain = current.schema
    schema = T.StructType(plain.fields[:]).add("n_words", "long").add("spans", _SPANS).add("items", T.ArrayType(T.StringType()))
    blocks = blocks_of(benchmark, item, benchmark_column, window, block_words)
    block, first = next(blocks), True
    while block is not None:
        following = next(blocks, None)
        current = current.mapInArrow(_searcher(Sent(docs.sparkSession, block), column, schema.names, first), schema)
        if following is not None:
            current = stored(current, "decontaminate")
        block, first = following, False
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return (
        current.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )


def _merge(old: Iterable[dict], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted([(s["start"], s["end"]) for s in old] + new):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _searcher(sent, column: str, names: list[str], first: bool):
    """A task's work for one block: gather a shard, index it, search it."""

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        n_words, spans, items = search_shard(batch.column(column).to_pylist(), sent.get())
        if not first:
            spans = [_merge(old, new) for old, new in zip(batch.column("spans").to_pylist(), spans, strict=True)]
            items = [new | set(old) for old, new in zip(batch.column("items").to_pylist(), items, strict=True)]
        kept = [batch.column(name) for name in names[:-3]]
        found = [[{"start": s, "end": e} for s, e in _merge([], row)] for row in spans]
        yield pa.RecordBatch.from_arrays(
            [
                *kept,
                pa.array(n_words, pa.int64()),
                pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(row) for row in items], pa.list_(pa.string())),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for piece in chunks(batches, column, SHARD_BYTES // 8):
            held.append(piece)
            size += piece.column(column).nbytes
            if size >= SHARD_BYTES:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    return run
