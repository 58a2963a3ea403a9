"""Counting quotient filters over packed word numbers, in numpy.

A key is a phrase of up to four word numbers of `bits` bits each, packed into two halves of two words. An invertible
permutation (a Feistel network on the halves) spreads the keys evenly. The upper bits of the permuted key are its
quotient, all others its remainder, so nothing is lost: from a filter's slot the phrase itself comes back.

A filter keeps its remainders in the order of the permuted keys. A bit for each quotient says whether any key has it, a
bit for each remainder whether it is the last of its quotient. Counts of one take a bit, larger ones a number.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_HEADER = "<QIIBBB"


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of each value."""
    x = (values ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


@dataclass
class Keys:
    """Permuted keys (two halves of `half` bits) in ascending order, each once, with their counts."""

    half: int
    high: np.ndarray
    low: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.high)

    def part(self, rows: slice | np.ndarray) -> Keys:
        return Keys(self.half, self.high[rows], self.low[rows], self.count[rows])


def permuted(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << half) - 1)
    for salt in _ROUNDS:
        high, low = low, high ^ (mixed(low, salt) & mask)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of `permuted`."""
    mask = np.uint64((1 << half) - 1)
    for salt in reversed(_ROUNDS):
        high, low = low ^ (mixed(high, salt) & mask), high
    return high, low


def packed(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of four word numbers as two halves; number 0 stands for no word."""
    w, shift = words.astype(np.uint64), np.uint64(bits)
    return w[:, 0] << shift | w[:, 1], w[:, 2] << shift | w[:, 3]


def unpacked(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    return np.stack([high >> shift, high & mask, low >> shift, low & mask], axis=1).astype(np.int64)


def summed(half: int, high: np.ndarray, low: np.ndarray, count: np.ndarray) -> Keys:
    """Keys in any order, repeated or not, as sorted distinct ones; runs that are sorted already are merged."""
    if not len(high):
        return Keys(half, high, low, count)
    if 2 * half <= 64:
        joint = high << np.uint64(half) | low
        order = np.argsort(joint, kind="stable")
        joint = joint[order]
        new = np.concatenate([[True], joint[1:] != joint[:-1]])
    else:
        order = np.lexsort((low, high))
        new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
    first = np.flatnonzero(new)
    return Keys(half, high[order][first], low[order][first], np.add.reduceat(count[order], first))


def counted(words: np.ndarray, bits: int) -> Keys:
    """The distinct phrases among rows of four word numbers, permuted."""
    high, low = permuted(*packed(words, bits), 2 * bits)
    return summed(2 * bits, high, low, np.ones(len(words), dtype=np.int64))


def merged(parts: list[Keys]) -> Keys:
    """One filter's keys from several filters'."""
    if len(parts) == 1:
        return parts[0]
    return summed(parts[0].half, *(np.concatenate([getattr(p, name) for p in parts]) for name in ("high", "low", "count")))


def slices(keys: Keys, slice_bits: int) -> list[tuple[int, Keys]]:
    """The keys by the first `slice_bits` bits of their quotient; slices without keys are left out."""
    which = (keys.high >> np.uint64(keys.half - slice_bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(which)]]) if len(which) else np.array([0])
    return [(int(which[a]), keys.part(slice(a, b))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class QuotientFilter:
    """The stored form of one slice of keys."""

    def __init__(self, stored: bytes):
        self.stored = stored
        self.n, self.prefix, multiple, self.half, self.slice_bits, self.q = struct.unpack_from(_HEADER, stored)
        at = struct.calcsize(_HEADER)
        sizes = [((1 << self.q) + 7) // 8, (self.n + 7) // 8, self.n * self.remainder_bytes, (self.n + 7) // 8, 8 * multiple]
        ends = np.cumsum([at, *sizes]).tolist()
        self.occupied, self.run_ends, self.remainders, self.many, self.counts = (memoryview(stored)[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))

    @property
    def remainder_bytes(self) -> int:
        return (2 * self.half - self.slice_bits - self.q + 7) // 8

    @classmethod
    def of(cls, keys: Keys, prefix: int, slice_bits: int) -> QuotientFilter:
        """A filter of sorted keys that share the slice `prefix`, with about as many quotients as keys."""
        half, n = keys.half, len(keys)
        q = min(max(n.bit_length() - 1, 0), half - slice_bits)
        quotient = (keys.high >> np.uint64(half - slice_bits - q)) & np.uint64((1 << q) - 1)
        occupied = np.zeros(1 << q, dtype=np.uint8)
        occupied[quotient.astype(np.int64)] = 1
        run_ends = np.concatenate([quotient[1:] != quotient[:-1], [True]])
        high = keys.high & np.uint64((1 << (half - slice_bits - q)) - 1)
        # The whole remainder as bytes, lowest first: the lower half, and the upper one shifted to follow it.
        limbs = np.zeros((n, 2), dtype="<u8")
        limbs[:, 0] = keys.low | (high << np.uint64(half) if half < 64 else 0)
        limbs[:, 1] = high >> np.uint64(64 - half) if half > 0 else 0
        width = (2 * half - slice_bits - q + 7) // 8
        many = keys.count > 1
        large = keys.count[many].astype("<i8")
        head = struct.pack(_HEADER, n, prefix, len(large), half, slice_bits, q)
        parts = [np.packbits(occupied), np.packbits(run_ends), np.ascontiguousarray(limbs.view(np.uint8).reshape(n, 16)[:, :width]), np.packbits(many), large]
        return cls(head + b"".join(p.tobytes() for p in parts))

    def keys(self) -> Keys:
        """All keys and counts, in order."""
        n, half = self.n, self.half
        ends = np.unpackbits(np.frombuffer(self.run_ends, np.uint8), count=n)
        run = np.cumsum(ends) - ends
        quotient = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8), count=1 << self.q))[run].astype(np.uint64)
        limbs = np.zeros((n, 16), dtype=np.uint8)
        limbs[:, : self.remainder_bytes] = np.frombuffer(self.remainders, np.uint8).reshape(n, self.remainder_bytes)
        first, second = limbs.view("<u8").T
        low = first & np.uint64((1 << half) - 1)
        high = second << np.uint64(64 - half)
        if half < 64:
            high = high | first >> np.uint64(half)
        rest = half - self.slice_bits - self.q
        high = high | (np.uint64(self.prefix) << np.uint64(self.q) | quotient) << np.uint64(rest)
        count = np.ones(n, dtype=np.int64)
        count[np.unpackbits(np.frombuffer(self.many, np.uint8), count=n).astype(bool)] = np.frombuffer(self.counts, "<i8")
        return Keys(half, high, low, count)

    def count(self, high: int, low: int) -> int:
        """The count of one permuted key, found by rank and select: its quotient's run, then its remainder."""
        if high >> (self.half - self.slice_bits) != self.prefix:
            return 0
        rest = self.half - self.slice_bits - self.q
        quotient = high >> rest & ((1 << self.q) - 1)
        occupied = np.unpackbits(np.frombuffer(self.occupied, np.uint8), count=1 << self.q)
        if not occupied[quotient]:
            return 0
        rank = int(occupied[:quotient].sum())
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(self.run_ends, np.uint8), count=self.n))
        remainder = ((high & ((1 << rest) - 1)) << self.half | low).to_bytes(16, "little")[: self.remainder_bytes]
        many = np.unpackbits(np.frombuffer(self.many, np.uint8), count=self.n)
        for slot in range(int(ends[rank - 1]) + 1 if rank else 0, int(ends[rank]) + 1):
            if bytes(self.remainders[slot * self.remainder_bytes : (slot + 1) * self.remainder_bytes]) == remainder:
                return int(np.frombuffer(self.counts, "<i8")[many[:slot].sum()]) if many[slot] else 1
        return 0
