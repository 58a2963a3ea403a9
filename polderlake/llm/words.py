"""Words of many texts at once, as positions and 64-bit hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words that are hashed at a time.
_PART = 50_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes of words: all but the `excluded` ranges. Bytes of non-ASCII characters are never excluded."""
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = out[done - 1 : done] * base
        more = min(done, n - done)
        np.multiply(out[:more], step, out=out[done : done + more])
        done += more
    return out[:n]


@dataclass
class Words:
    """The words of some texts: where each lies in `data`, its hash, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words_of(texts: list[str | None], in_word: np.ndarray, *, hashed: bool = True) -> Words:
    """Lower-case A-Z and cut the texts into runs of `in_word` bytes. Null has no words."""
    packed = [text.encode("utf-8", "surrogatepass") if text else b"" for text in texts]
    data = LOWER[np.frombuffer(b"\n".join([*packed, b""]), dtype=np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in packed])]).astype(np.int64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = in_word[data]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = _hashes(data, start, end) if hashed else np.zeros(0, dtype=np.uint64)
    return Words(data, start, end, hashes, np.searchsorted(start, begins).astype(np.int64))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from a part of the words at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    longest = int((end - start).max(initial=0))
    power = powers(BASE, longest + 1)
    for low in range(0, len(start), _PART):
        first, last = start[low : low + _PART], end[low : low + _PART]
        part = data[first[0] : last[-1] + 1]  # a byte follows every word: the texts end with a line feed
        # Each byte's place in its word; what follows a word is weighed as well, but dropped.
        place = np.arange(len(part)) - np.repeat(first - first[0], np.diff(np.append(first, last[-1] + 1)))
        weighted = _MIX[part] * power[np.minimum(place, longest)]
        # reduceat needs a cut after each word as well; what lies between words goes.
        cuts = np.stack([first, last], axis=1).ravel() - first[0]
        out[low : low + _PART] = np.add.reduceat(weighted, cuts)[::2]
    out ^= out >> np.uint64(29)
    return out
