"""Elias-Fano sequences and the n-gram trie whose levels are stored with them.

A level is a non-decreasing sequence: the low bits of each value are packed, the
high parts are unary in a bit vector.  The trie of one shard has

* level 1: the contexts (word ids, increasing) and, as a second monotone
  sequence, the pointers to their successors;
* level 2: the successors of each context.  They are stored relative to their
  context: value + sum of the largest successors of the contexts before, which
  makes the whole level monotone; next to them lie quantised probabilities.

The levels are written to one file, which is memory-mapped (and unlinked at
once, so nothing stays behind).  A query finds its context in level 1, follows
the pointer and searches the first successor not below the word inside the
context's range, decoding only the slices that queries touch.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: log10 probabilities are cut to LEVELS steps over [LOWEST, 0], rounded down; code 0 means "not seen".
LOWEST, LEVELS = -16.0, 4095
#: Every so many values the place of a value's high part is kept.
SAMPLE = 256


def quantise(probability: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        logs = np.maximum(np.log10(probability), LOWEST)
    return (1 + np.floor((logs - LOWEST) / -LOWEST * (LEVELS - 1) + 1e-9)).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    table = 10.0 ** (LOWEST - LOWEST * (np.arange(LEVELS + 1) - 1) / (LEVELS - 1))
    table[0] = 0.0
    return table[codes]


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, arrays: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, low: int):
        self.words, self.bits, self.samples = arrays
        self.n, self.low = n, low

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(1, n)).bit_length() - 1)
        packed = np.zeros((n * low + 63) // 64 + 2, np.uint64)
        v = values.astype(np.uint64)
        if low:
            part, at = v & np.uint64((1 << low) - 1), np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(packed, word, part << shift)
            over = shift + np.uint64(low) > 64
            np.bitwise_or.at(packed, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(ones[-1]) + 1 if n else 0) + 63) // 64 * 64, np.uint8)
        flags[ones] = 1
        bits = np.packbits(flags, bitorder="little")
        return cls((packed, bits, ones[::SAMPLE].astype(np.int64)), n, low)

    def slice(self, i: int, j: int) -> np.ndarray:
        """The values i .. j-1."""
        if i >= j:
            return np.zeros(0, np.int64)
        first, after = i // SAMPLE, (j - 1) // SAMPLE + 1
        begin = int(self.samples[first])  # where the one number first * SAMPLE is
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.bits)
        ones = np.flatnonzero(np.unpackbits(np.asarray(self.bits[begin // 8 : stop]), bitorder="little")) + begin // 8 * 8
        skip = int(np.searchsorted(ones, begin)) - first * SAMPLE
        high = ones[skip + i : skip + j] - np.arange(i, j)
        if not self.low:
            return high
        at = np.arange(i, j, dtype=np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = np.asarray(self.words[word]) >> shift
        spill = shift > 0
        part[spill] |= np.asarray(self.words[word[spill] + 1]) << (np.uint64(64) - shift[spill])
        return (high << self.low) | (part & np.uint64((1 << self.low) - 1)).astype(np.int64)


def _successor(level: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each query the first place in [low, high) whose value is not below ``value`` (high if none)."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = open_ & (level[np.minimum(middle, len(level) - 1)] < value)
        low[less] = middle[less] + 1
        keep = open_ & ~less
        high[keep] = middle[keep]
    return low


class Trie:
    """The contexts and successors of one shard, memory-mapped."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, codes: np.ndarray):
        """Rows sorted by (context, successor), each pair once."""
        begins = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        pointers = np.concatenate([begins, [len(context)]])
        top = successor[pointers[1:] - 1]
        base = np.concatenate([[0], np.cumsum(top)])  # of each context: the largest successors before it
        relative = successor + np.repeat(base[:-1], np.diff(pointers))
        levels = [EliasFano.encode(context[begins]), EliasFano.encode(pointers), EliasFano.encode(base), EliasFano.encode(relative)]
        arrays = [a for level in levels for a in (level.words, level.bits, level.samples)] + [codes]
        self.bytes = sum(a.nbytes for a in arrays)
        fd, path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(fd, "wb") as f:
            places = []
            for a in arrays:
                places.append(f.tell())
                f.write(a.tobytes())
                f.write(bytes(-f.tell() % 8))
        file = np.memmap(path, np.uint8, "r") if self.bytes else np.zeros(0, np.uint8)
        os.unlink(path)
        mapped = [file[p : p + a.nbytes].view(a.dtype) for p, a in zip(places, arrays, strict=True)]
        self.contexts, self.pointers, self.base, self.successors = (EliasFano(tuple(mapped[3 * k : 3 * k + 3]), level.n, level.low) for k, level in enumerate(levels))
        self.codes = mapped[12]

    def query(self, context: np.ndarray, successor: np.ndarray, slice_size: int = 1 << 16) -> np.ndarray:
        """The code of every pair (sorted by context), 0 where the trie has none.

        Every level is decoded ``slice_size`` values at a time, and only where queries fall.
        """
        out = np.zeros(len(context), np.uint16)
        at, first = 0, 0
        while first < self.contexts.n and at < len(context):
            after = min(self.contexts.n, first + slice_size)
            known = self.contexts.slice(first, after)
            stop = int(np.searchsorted(context, known[-1], "right"))
            if stop > at:
                node = np.searchsorted(known, context[at:stop])
                hit = np.flatnonzero(known[node] == context[at:stop])
                pointers, base = self.pointers.slice(first, after + 1), self.base.slice(first, after + 1)
                out[at + hit] = self._successors(pointers, base, node[hit], successor[at:stop][hit], slice_size)
            at, first = stop, after
        return out

    def _successors(self, pointers: np.ndarray, base: np.ndarray, node: np.ndarray, word: np.ndarray, slice_size: int) -> np.ndarray:
        """The codes of words below nodes (in order) whose pointers and bases are decoded."""
        out = np.zeros(len(node), np.uint16)
        at = 0
        while at < len(node):
            start = int(pointers[node[at]])
            end = max(int(np.searchsorted(pointers, start + slice_size, "right")) - 1, int(node[at]) + 1)  # contexts below it
            stop = int(np.searchsorted(node, end))
            level = self.successors.slice(start, int(pointers[end]))
            n, w = node[at:stop], word[at:stop] + base[node[at:stop]]
            found = _successor(level, pointers[n] - start, pointers[n + 1] - start, w)
            good = found < pointers[n + 1] - start
            good[good] = level[found[good]] == w[good]
            out[at:stop][good] = self.codes[start + found[good]]
            at = stop
        return out
