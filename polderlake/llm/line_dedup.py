"""Line dedup by pairwise alignment.

Documents are lists of line hashes. Every run of adjacent lines that just reaches the words of a block links its holders
to its first holder: one link for each holder, however many there are. So every block that two documents have in common
has an earlier document to be compared with, also if its lines are short and begin in different documents. Linked
documents overlap, however many hold the run; a caller may ask for rare runs or enough words in common ones. The two
lists of line hashes of an overlapping pair are aligned with patience diff: lines that occur once in each and keep their
order are fixed points, and between them the same is done again; where there is none, equal lines at both ends are
matched. Aligned blocks of enough words are deleted from the later document. What is left is compared with a suffix
automaton of the earlier lines: all common runs of enough words go, the heaviest first, so that a block that repeats, or
stands elsewhere in the earlier document, goes too. The work for a pair grows with its lines, in whatever order they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polderlake.llm.frames import pieces, stored, without
from polderlake.session import freeze

#: If a caller limits rare runs: words in common runs that make a pair overlap without a rare run.
COMMON_WORDS = 30
#: Words of an aligned block that is deleted.
BLOCK_WORDS = 8
_FACTOR = 0x9E3779B97F4A7C15


def patience(earlier: list[int], later: list[int]) -> list[tuple[int, int]]:
    """Matching positions (earlier, later) of two lists, ascending in both."""
    matches: list[tuple[int, int]] = []
    todo = [(0, len(earlier), 0, len(later))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and earlier[a] == later[b]:
            matches.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and earlier[a_end - 1] == later[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            matches.append((a_end, b_end))
        if a >= a_end or b >= b_end:
            continue
        fixed = _fixed_points(earlier, a, a_end, later, b, b_end)
        for x, y in fixed:
            todo.append((a, x, b, y))
            matches.append((x, y))
            a, b = x + 1, y + 1
        if fixed:
            todo.append((a, a_end, b, b_end))
    return sorted(matches)


class SuffixAutomaton:
    """All runs of adjacent lines of one list, in space and time that grow with its lines."""

    def __init__(self, lines: list[int]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        step, link, length = self.step, self.link, self.length
        last = 0
        for line in lines:
            new, at = len(step), last
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            while at >= 0 and line not in step[at]:
                step[at][line] = new
                at = link[at]
            if at >= 0:
                following = step[at][line]
                if length[following] != length[at] + 1:
                    copy = len(step)
                    step.append(dict(step[following]))
                    link.append(link[following])
                    length.append(length[at] + 1)
                    link[following] = copy
                    while at >= 0 and step[at].get(line) == following:
                        step[at][line] = copy
                        at = link[at]
                    following = copy
                link[new] = following
            last = new

    def longest_runs(self, other: list[int | None]) -> list[tuple[int, int]]:
        """(start, end) of the runs of `other` that the list has and that can be made longer on neither side.

        Both their starts and their ends ascend. None is in no run.
        """
        step, link, length = self.step, self.link, self.length
        runs: list[tuple[int, int]] = []
        at = size = 0
        for j, line in enumerate(other):
            before = size
            while at and line not in step[at]:
                at = link[at]
                size = length[at]
            if line in step[at]:
                at, size = step[at][line], size + 1
            else:
                size = 0
            if before and size != before + 1:
                runs.append((j - before, j))
        if size:
            runs.append((len(other) - size, len(other)))
        return runs


def common_runs(earlier: list[int], later: list[int | None], words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of common runs of adjacent lines with `least` words or more: the heaviest, then the heaviest of what it leaves.

    Ties go to the first. A run that loses lines to a heavier one stays a common run without them; it can lose some at
    each end only, so the work is that of sorting the runs.
    """
    known = set(earlier)
    if sum(n for line, n in zip(later, words, strict=True) if line in known) < least:
        return []
    upto = [0, *accumulate(words)]
    runs = [(a, b) for a, b in SuffixAutomaton(earlier).longest_runs(later) if upto[b] - upto[a] >= least]
    heap = [(upto[a] - upto[b], a, i) for i, (a, b) in enumerate(runs)]
    heapify(heap)
    taken: list[tuple[int, int]] = []
    alive = [True] * len(runs)
    while heap:
        weight, a, i = heappop(heap)
        low, high = runs[i]
        if not alive[i] or a != low or weight != upto[low] - upto[high]:
            continue
        taken.append((low, high))
        alive[i] = False
        for side in (range(i - 1, -1, -1), range(i + 1, len(runs))):
            for k in side:
                x, y = runs[k]
                if (y <= low) if k < i else (x >= high):
                    break
                if not alive[k]:
                    continue
                x, y = (x, min(y, low)) if k < i else (max(x, high), y)
                runs[k] = (x, y)
                if upto[y] - upto[x] >= max(least, 1):
                    heappush(heap, (upto[x] - upto[y], x, k))
                else:
                    alive[k] = False
    return taken


def _fixed_points(earlier: list[int], a: int, a_end: int, later: list[int], b: int, b_end: int) -> list[tuple[int, int]]:
    """The longest ascending run of lines that occur once on each side."""
    once_a, once_b = Counter(earlier[a:a_end]), Counter(later[b:b_end])
    where = {line: i for i, line in enumerate(earlier[a:a_end], a) if once_a[line] == 1}
    pairs = [(where[line], j) for j, line in enumerate(later[b:b_end], b) if once_b[line] == 1 and line in where]
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for n, (x, _) in enumerate(pairs):
        pile = bisect_left(tops, x)
        before.append(piles[pile - 1] if pile else -1)
        tops[pile:] = [x, *tops[pile + 1 :]] if pile < len(tops) else [x]
        piles[pile:] = [n, *piles[pile + 1 :]] if pile < len(piles) else [n]
    chain = []
    n = piles[-1] if piles else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def blocks_to_delete(matches: list[tuple[int, int]], words: list[int], block_words: int) -> list[int]:
    """Positions in the later document of the aligned blocks that have enough words."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for pair in [*matches, (-2, -2)]:
        if pair != (last[0] + 1, last[1] + 1):
            if sum(words[i] for i in block) >= block_words:
                out += block
            block = []
        if pair[1] >= 0:
            block.append(pair[1])
        last = pair
    return out


def repeated_positions(earlier: list[int], later: list[int], words: list[int], block_words: int) -> list[int]:
    """Positions of the later document's lines that the earlier one has in blocks of enough words.

    The blocks that the alignment finds go first; then the common runs of what is left, wherever they stand.
    """
    gone = blocks_to_delete(patience(earlier, later), words, block_words)
    left: list[int | None] = list(later)
    for i in gone:
        left[i] = None
    for low, high in common_runs(earlier, left, words, block_words):
        gone += range(low, high)
    return sorted(gone)


def lists_of_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, text_hash, lines, words): line hashes and word counts, without space around lines. No text: no row."""
    lines = F.transform(F.split(F.col(column), "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    count = F.transform("spelled", lambda line: F.when(line == "", 0).otherwise(F.length(F.regexp_replace(line, r"\S+\s*", "x"))).cast("int"))
    return (
        docs.where(F.col("doc_id").isNotNull() & (F.col(column) != ""))
        .select("doc_id", F.xxhash64(column).alias("text_hash"), lines.alias("spelled"))
        .select("doc_id", "text_hash", F.transform("spelled", lambda line: F.xxhash64(line)).alias("lines"), count.alias("words"))
    )


def run_keys(lines: np.ndarray, words: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of adjacent lines that just reach `block_words` words, and the words each adds.

    One run begins at every line that isn't blank and one ends there, as far as the text goes. They cover every block that
    is long enough to be deleted. A run adds the words of its first line if it is the one that begins there.
    """
    block_words = max(block_words, 1)
    factor = np.full(len(lines), _FACTOR, np.uint64)
    # Sums of lines times powers of an odd number; the power of the first line is divided out, modulo 2 ** 64.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * np.multiply.accumulate(factor))])
    back = np.multiply.accumulate(np.full(len(lines), pow(_FACTOR, -1, 1 << 64), np.uint64))
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    filled = np.flatnonzero(words)
    ends = np.searchsorted(upto, upto[filled] + block_words)
    begins = np.searchsorted(upto, upto[filled + 1] - block_words, "right") - 1
    ahead, behind = ends <= len(lines), begins >= 0
    start = np.concatenate([filled[ahead], begins[behind]])
    end = np.concatenate([ends[ahead], filled[behind] + 1])
    adds = np.concatenate([words[filled[ahead]], np.zeros(behind.sum(), words.dtype)])
    keys, first = np.unique(((sums[end] - sums[start]) * back[start]).view(np.int64), return_index=True)
    return keys, adds[first]


def overlapping(lists: DataFrame, rare_documents: int | None, common_words: int, block_words: int) -> DataFrame:
    """(doc_id, earlier): documents and the first holders of their runs of `block_words` words.

    With `rare_documents` only pairs that share a run of at most so many holders, or enough words in common runs.
    """
    schema = lists.select("doc_id").schema.add("line", "long").add("n_words", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 128):
                lists_of = zip(part.column("lines"), part.column("words"), strict=True)
                found = [run_keys(a.values.to_numpy(), b.values.to_numpy(), block_words) for a, b in lists_of]
                owner = np.repeat(np.arange(len(found)), [len(keys) for keys, _ in found])
                if len(owner):
                    keys, adds = (np.concatenate(column) for column in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(keys, pa.int64()), pa.array(adds, pa.int32())], schema.names)

    held = lists.select("doc_id", "lines", "words").mapInArrow(run, schema)
    shared = held.groupBy("line").agg(F.min("doc_id").alias("earlier"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    # Stored, so that both sides of the join are dealt anew and Spark can split a line that very many documents hold.
    linked = held.join(freeze(shared).hint("merge"), "line").where("doc_id > earlier")
    if rare_documents is None:
        return linked.select("doc_id", "earlier").distinct()
    evidence = linked.groupBy("doc_id", "earlier").agg(
        F.max((F.col("holders") <= rare_documents).cast("int")).alias("rare"), F.sum("n_words").alias("shared_words")
    )
    return evidence.where((F.col("rare") == 1) | (F.col("shared_words") >= common_words)).select("doc_id", "earlier")


def repeated_lines(docs: DataFrame, column: str, rare_documents: int | None, common_words: int, block_words: int) -> DataFrame:
    """(doc_id, text_hash, gone): positions of the lines that an earlier document has in an aligned block."""
    lists = stored(lists_of_lines(docs, column).distinct(), "lines")
    pairs = overlapping(lists, rare_documents, common_words, block_words)
    earlier = lists.select(F.col("doc_id").alias("earlier"), F.col("lines").alias("earlier_lines"))
    both = pairs.join(lists, "doc_id").join(earlier, "earlier").select("doc_id", "text_hash", "lines", "words", "earlier_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 128):
                gone = [
                    repeated_positions(a, b, words, block_words)
                    for a, b, words in zip(*(part.column(name).to_pylist() for name in ("earlier_lines", "lines", "words")), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "text_hash", "gone"])

    schema = both.select("doc_id", "text_hash").schema.add("gone", T.ArrayType(T.IntegerType()))
    aligned = both.mapInArrow(run, schema).where(F.size("gone") > 0)
    return aligned.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


RESULT = ("n_lines", "n_removed")


def remove_repeated_lines(
    docs: DataFrame, column: str = "text", *, rare_documents: int | None = None, common_words: int = COMMON_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """`docs` without the line blocks that an earlier document (one with a smaller doc_id) has as well.

    Adds `n_lines` (lines before) and `n_removed`, which replace columns of those names. Lines end at a line feed and are
    compared without the white space around them. A text that loses all lines becomes empty. Null and empty texts have
    no lines and stay as they are, as do rows without a doc_id. What happens to a line doesn't depend on how many documents
    hold it, unless `rare_documents` is given: runs with more holders then need `common_words` words in common. Rows that share a doc_id are never compared with each
    other; rows that repeat an id and a text get the same result.

    What is joined and shuffled for the comparison are hashes. The texts are shuffled once, to bring the deletions to them.
    """
    rest = without(docs, *RESULT)
    gone = repeated_lines(docs.select("doc_id", column), column, rare_documents, common_words, block_words)
    gone = stored(gone, "repeated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone")
    joined = rest.join(gone.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64(column) == F.col("_hash")), "left")
    lines = F.split(F.col(column), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *[F.when(F.col("gone").isNull(), F.col(column)).otherwise(left).alias(column) if name == column else F.col(f"`{name}`") for name in rest.columns],
        F.when(F.coalesce(F.col(column), F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
