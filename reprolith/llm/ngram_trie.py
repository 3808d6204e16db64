"""Compact n-gram tries: Elias-Fano levels with quantised values, in one memory-mappable block.

An n-gram's words are integers. Level k holds the last words of all k-grams, in order of their
parents and, below one parent, ascending. Written as parent x 2^bits + word these are monotone over
the whole level and stored by Elias-Fano; so is the sequence of pointers from a node to its first
child. To look up an n-gram, the walk goes down from its first word: below each node it searches
the next word as a successor search within the node's context, that is from parent x 2^bits on.
Each node has a value of 8 bits: the index of a codebook of quantiles of its level.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

_BLOCK = 8  # words of 64 bits between two samples of the counts


class EliasFano:
    """A monotone sequence of integers below 2^63 in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.high, self.low, self.samples = n, low_bits, high, low, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        top = (v >> np.uint64(low_bits)).astype(np.int64)
        at = top + np.arange(n)
        words = (int(at[-1]) // 64 if n else 0) + 2
        words += -words % _BLOCK
        high = np.zeros(words, "<u8")
        np.bitwise_or.at(high, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        low = np.zeros(n * low_bits // 64 + 2, "<u8")
        if low_bits and n:
            x = v & np.uint64((1 << low_bits) - 1)
            pos = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            np.bitwise_or.at(low, word, x << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
        ones = np.bitwise_count(high).reshape(-1, _BLOCK).sum(1, dtype=np.int64)
        return cls(n, low_bits, high, low, np.concatenate([[0], np.cumsum(ones)]).astype("<i8"))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.high), len(self.low), len(self.samples)], "<i8"), self.high, self.low, self.samples]

    @classmethod
    def read(cls, data, at: int) -> tuple[EliasFano, int]:
        n, low_bits, *sizes = np.frombuffer(data, "<i8", 5, at).tolist()
        at += 40
        got = []
        for size, kind in zip(sizes, ("<u8", "<u8", "<i8"), strict=True):
            got.append(np.frombuffer(data, kind, size, at))
            at += 8 * size
        return cls(n, low_bits, *got), at

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Positions of the k-th (from 0) zero or one in the high bits."""
        counts = np.arange(len(self.samples)) * (64 * _BLOCK) - self.samples if zeros else self.samples
        block = np.searchsorted(counts, k, side="right") - 1
        left = k - counts[block]
        word = block * _BLOCK
        for _ in range(_BLOCK - 1):
            c = np.bitwise_count(self.high[word]).astype(np.int64)
            c = 64 - c if zeros else c
            go = left >= c  # once a row stays, it stays: its word doesn't change
            left = np.where(go, left - c, left)
            word = np.where(go, word + 1, word)
            if not go.any():
                break
        w = ~self.high[word] if zeros else self.high[word]
        bit = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(w & np.uint64((1 << step) - 1)).astype(np.int64)
            go = left >= c
            left = np.where(go, left - c, left)
            w = np.where(go, w >> np.uint64(step), w)
            bit = np.where(go, bit + step, bit)
        return word * 64 + bit

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        pos = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
        x = self.low[word] >> shift
        x |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return x & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        top = (self._select(i, zeros=False) - i).astype(np.uint64)
        return top << np.uint64(self.low_bits) | self._low_at(i)

    def _bucket(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each x: whether its high bits occur in range, and the indices [lo, hi) that share them."""
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(len(self.high) * 64 - self.n - 1)  # zeros that there are, but one
        inside = top <= last
        t = np.where(inside, top, 0)
        at = np.where(t > 0, self._select(np.maximum(t - 1, 0), zeros=True) + 1, 0)  # the first bit of the bucket
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        w = self.high[word] >> shift
        w |= np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        run = np.bitwise_count(w ^ (w + np.uint64(1))).astype(np.int64) - 1  # ones in a row from there
        long = (run >= 63) | (w == np.uint64(0xFFFFFFFFFFFFFFFF))
        if long.any():
            run[long] = self._select(t[long], zeros=True) - at[long]
        return inside, at - t, at - t + run

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The least index whose value is >= x; n if there is none."""
        return self._search(x)[0]

    def index(self, x: np.ndarray) -> np.ndarray:
        """The least index whose value is x; -1 if it isn't there."""
        at, same = self._search(x)
        return np.where(same, at, -1)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successors, and whether they equal what was asked for."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        inside, lo, hi = self._bucket(x)
        low, end = x & np.uint64((1 << self.low_bits) - 1), hi
        while True:  # binary search of the low bits among those with the same high bits
            at = np.flatnonzero(lo < hi)
            if not len(at):
                break
            mid = (lo[at] + hi[at]) >> 1
            less = self._low_at(mid) < low[at]
            lo[at[less]] = mid[less] + 1
            hi = hi.copy() if hi is end else hi
            hi[at[~less]] = mid[~less]
        same = inside & (lo < end)
        same[same] = self._low_at(lo[same]) == low[same]
        return np.where(inside, lo, self.n), same


class Quantised:
    """Values as 8-bit indices of a codebook: means of equally filled bins of the level's values."""

    @staticmethod
    def build(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.asarray(values, np.float64)
        distinct = np.unique(v)
        if len(distinct) <= 256:
            book = distinct
        else:
            order = np.sort(v)
            cut = np.unique(order[np.linspace(0, len(order) - 1, 257).astype(np.int64)[1:-1]])
            bins = np.searchsorted(cut, v, side="left")
            n = np.bincount(bins, minlength=len(cut) + 1)
            book = (np.bincount(bins, v, minlength=len(cut) + 1) / np.maximum(n, 1))[n > 0]
        near = np.searchsorted((book[1:] + book[:-1]) / 2, v, side="left") if len(book) else np.zeros(len(v), np.int64)
        return np.resize(np.concatenate([book, np.zeros(256)])[:256], 256).astype("<f8"), near.astype(np.uint8)


class NGramTrie:
    """n-grams up to some order with a quantised value each; words are integers below 2^bits."""

    def __init__(self, bits: int, levels: list[tuple[EliasFano, EliasFano | None, np.ndarray, np.ndarray]]):
        self.bits, self.levels = bits, levels

    @classmethod
    def build(cls, orders: list[tuple[np.ndarray, np.ndarray]], bits: int = 32) -> NGramTrie:
        """From [(k-grams as a sorted n x k array, values), ...] for k = 1, 2, ...; all prefixes present."""
        levels = []
        parents = np.zeros((1, 0), np.uint64)
        for k, (grams, values) in enumerate(orders, 1):
            grams = np.asarray(grams, np.uint64).reshape(-1, k)
            of = _rows_in(parents, grams[:, :-1])
            if (of < 0).any():
                raise ValueError("an n-gram's prefix is missing")
            keys = EliasFano.build(of.astype(np.uint64) << np.uint64(bits) | grams[:, -1])
            pointers = EliasFano.build(np.searchsorted(of, np.arange(len(parents) + 1)))
            levels.append((keys, pointers, *Quantised.build(values)))
            parents = grams
        return cls(bits, levels)

    def child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index at `level` (from 0) of each parent's child with that word; -1 if it has none."""
        keys = self.levels[level][0]
        want = np.maximum(parent, 0).astype(np.uint64) << np.uint64(self.bits) | np.asarray(word, np.uint64)
        return np.where(np.asarray(parent) >= 0, keys.index(want), -1)

    def children(self, level: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The indices [from, to) at `level` (from 0) of each parent's children: two pointers."""
        pointers = self.levels[level][1]
        return pointers.get(parent).astype(np.int64), pointers.get(np.asarray(parent) + 1).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Index of each k-gram (rows of words) in level k, or -1."""
        at = np.zeros(len(grams), np.int64)
        for k in range(grams.shape[1]):
            at = self.child(k, at, grams[:, k])
        return at

    def values(self, level: int, index: np.ndarray, missing: float = np.nan) -> np.ndarray:
        _, _, book, codes = self.levels[level]
        got = book[codes[np.maximum(index, 0)]] if len(codes) else np.zeros(len(index))
        return np.where(index >= 0, got, missing)

    def to_bytes(self) -> bytes:
        out = [struct.pack("<qq", self.bits, len(self.levels))]
        for keys, pointers, book, codes in self.levels:
            for part in (*keys.parts(), *pointers.parts(), book):
                out.append(part.tobytes())
            out.append(struct.pack("<q", len(codes)) + codes.tobytes().ljust(-(-len(codes) // 8) * 8, b"\0"))
        return b"".join(out)

    @classmethod
    def from_buffer(cls, data) -> NGramTrie:
        bits, count = struct.unpack_from("<qq", data)
        at, levels = 16, []
        for _ in range(count):
            keys, at = EliasFano.read(data, at)
            pointers, at = EliasFano.read(data, at)
            book = np.frombuffer(data, "<f8", 256, at)
            n = struct.unpack_from("<q", data, at + 2048)[0]
            codes = np.frombuffer(data, np.uint8, n, at + 2056)
            at += 2056 + -(-n // 8) * 8
            levels.append((keys, pointers, book, codes))
        return cls(bits, levels)

    def mapped(self) -> NGramTrie:
        """The same trie over a memory-mapped file that is gone when the trie is."""
        with tempfile.TemporaryFile(prefix="trie-") as f:
            f.write(self.to_bytes())
            f.flush()
            return self.from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def _rows_in(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Index of each row in a table of distinct rows, both sorted; -1 if it isn't there."""
    if not rows.shape[1]:
        return np.zeros(len(rows), np.int64)
    if rows.shape[1] == 1:
        at = np.searchsorted(table[:, 0], rows[:, 0])
        near = np.minimum(at, max(len(table) - 1, 0))
        return np.where(table[near, 0] == rows[:, 0], near, -1) if len(table) else np.full(len(rows), -1, np.int64)
    both = np.concatenate([table, rows])
    _, inverse = np.unique(both, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    at = np.full(len(both), -1, np.int64)
    at[inverse[: len(table)]] = np.arange(len(table))
    return at[inverse[len(table) :]]
