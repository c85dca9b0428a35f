"""Elias-Fano sequences and the levels of an n-gram trie, over memory maps, queried in numpy a batch at a time.

A sequence of n increasing numbers below u keeps the low bits of each (about log2(u / n)) packed, and the high bits
in unary: number i sets bit high + i. Bit counts at word borders give select, and with it both access and the
search for a successor among the few numbers of one high part.

The upper level of a trie holds the words, with 16-bit codes of a probability and a back-off each. The lower one holds
the followers of all words one after the other, each made relative to its context (the context's number above, the
follower below), which makes the whole level increasing. Pointers to where each context's followers begin are a third,
monotone sequence. A query finds the word, reads the two pointers, and searches the follower's successor between them.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

U = np.uint64


class EliasFano:
    """n increasing numbers. All parts are views of one buffer, which may be a memory map."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(high).astype(np.int64))])
        self.ones_before, self.zeros_before = ones, np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def parts(values: np.ndarray, universe: int, bits: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of low bits (the usual one, unless given), the packed low bits, the words of the high bits."""
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1) if bits is None else bits
        low = np.zeros(0, np.uint8)
        if bits == 32:
            low = values.astype(np.uint32).view(np.uint8)
        elif bits and n:
            field = (values[:, None] >> np.arange(bits, dtype=U)) & U(1)
            low = np.packbits(field.astype(np.uint8).reshape(-1), bitorder="little")
        high = (values >> U(bits)).astype(np.int64) + np.arange(n)
        words = np.zeros((int(high[-1]) if n else 0) // 64 + 2, U)
        np.bitwise_or.at(words, high >> 6, U(1) << (high & 63).astype(U))
        return bits, np.concatenate([low, np.zeros(8, np.uint8)]), words

    def select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the rank-th set (or unset) bit."""
        before = self.ones_before if ones else self.zeros_before
        word = np.searchsorted(before, rank, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        bits = self.high[word] if ones else ~self.high[word]
        left, place = rank - before[word], np.zeros(len(rank), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & U((1 << width) - 1)).astype(np.int64)
            over = left >= count
            left, place = left - count * over, place + width * over
            bits = np.where(over, bits >> U(width), bits)
        return 64 * word + place

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        if self.low_bits == 32:
            return self.low[: 4 * self.n].view("<u4")[i].astype(U)
        at = i * self.low_bits
        byte, out = at >> 3, np.zeros(len(i), U)
        for k in range((self.low_bits + 14) // 8):
            out |= self.low[np.minimum(byte + k, len(self.low) - 1)].astype(U) << U(8 * k) if k < 8 else U(0)
        return (out >> (at & 7).astype(U)) & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self.select(i, True) - i
        return (high.astype(U) << U(self.low_bits)) | self.lows(i)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each x the place of its successor, the end of the numbers of its high part, and its low part."""
        top = len(self.high) * 64 - self.n - 1  # the last high part that the unary bits know
        high, low = np.minimum(x >> U(self.low_bits), U(top)).astype(np.int64), x & U((1 << self.low_bits) - 1)
        a = np.where(high > 0, self.select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        stop = self.select(high, False) - high
        b, open_ = stop.copy(), np.flatnonzero(a < stop)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self.lows(middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        return a, stop, low

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first number that is not below x; n if there is none."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of x; -1 where it is not among the numbers."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        at, stop, low = self._search(x)
        inside = np.minimum(at, self.n - 1)
        return np.where((at < stop) & (self.lows(inside) == low), inside, -1)


class Trie:
    """Two levels: words, each with a code of its probability and one of its back-off, and the words that follow each."""

    HEAD = "<8sQQQQQQQQQ"

    def __init__(self, buffer):
        magic, bits, *sizes = struct.unpack_from(self.HEAD, buffer)
        assert magic == b"EFTRIE02"
        self.bits, at, seqs = bits, struct.calcsize(self.HEAD), []
        n_top, n_low, top_bits, low_bits, ptr_bits, top_low, low_low, ptr_low = sizes
        view = memoryview(buffer)
        for n, low_size, low in ((n_top, top_bits, top_low), (n_low, low_bits, low_low), (n_top + 1, ptr_bits, ptr_low)):
            (words,) = struct.unpack_from("<Q", view, at)
            high = np.frombuffer(view, U, words, at + 8)
            at += 8 + 8 * words
            seqs.append(EliasFano(n, low_size, np.frombuffer(view, np.uint8, low, at), high))
            at += low + (-low) % 8
        self.words, self.followers, self.pointers = seqs
        self.one, self.back, self.two = (np.frombuffer(view, np.uint16, n, at + 2 * k) for n, k in ((n_top, 0), (n_top, n_top), (n_low, 2 * n_top)))

    @classmethod
    def image(cls, words: np.ndarray, one: np.ndarray, back: np.ndarray, context: np.ndarray, follower: np.ndarray, two: np.ndarray, word_bits: int, follower_bits: int) -> bytes:
        """The bytes of a trie. words: sorted, with their codes; (context, follower): sorted, without repeats, context a place among the words."""
        pointers = np.searchsorted(context, np.arange(len(words) + 1)).astype(U)
        seqs = [
            EliasFano.parts(words.astype(U), 1 << word_bits),
            EliasFano.parts((context.astype(U) << U(follower_bits)) | follower.astype(U), max(len(words), 1) << follower_bits, 32 if follower_bits == 32 else None),
            EliasFano.parts(pointers, len(context) + 1),
        ]
        head = struct.pack(cls.HEAD, b"EFTRIE02", follower_bits, len(words), len(context), *[s[0] for s in seqs], *[len(s[1]) for s in seqs])
        body = b"".join(struct.pack("<Q", len(high)) + high.tobytes() + low.tobytes() + b"\0" * (-len(low) % 8) for _, low, high in seqs)
        return head + body + b"".join(x.astype("<u2").tobytes() for x in (one, back, two))

    @classmethod
    def mapped(cls, image: bytes) -> Trie:
        """A trie in a memory map without a file."""
        space = mmap.mmap(-1, len(image))
        space.write(image)
        return cls(space)

    @classmethod
    def open(cls, path: str) -> Trie:
        """A trie in a memory-mapped file."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: np.ndarray) -> np.ndarray:
        """The node of each word; -1 where the trie has it not."""
        return self.words.find(words.astype(U))

    def probabilities(self, node: np.ndarray, unknown: int) -> np.ndarray:
        """The codes of the nodes' own probabilities; `unknown` for no node."""
        return np.where(node >= 0, self.one[np.maximum(node, 0)] if len(self.one) else 0, unknown)

    def back_offs(self, node: np.ndarray) -> np.ndarray:
        """The codes of the nodes' back-offs; 0 for no node."""
        return np.where(node >= 0, self.back[np.maximum(node, 0)] if len(self.back) else 0, 0)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the followers of each node begin and end; nothing for no node."""
        if not self.words.n:
            return np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        inside = np.maximum(node, 0)
        start, stop = (self.pointers.get(inside + k).astype(np.int64) for k in (0, 1))
        return start, np.where(node >= 0, stop, start)

    def below(self, node: np.ndarray, which: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """The code of each follower under node[which]; 0 where it is not there. The pointers bound a search for the follower's successor among those of its context."""
        start, stop = self.children(node)
        at, end = start[which], stop[which]
        low, open_ = at.copy(), np.flatnonzero(at < end)
        high = end.copy()
        wanted = (np.maximum(node, 0)[which].astype(U) << U(self.bits)) | follower.astype(U)
        read = self.followers.lows if self.followers.low_bits == self.bits else self.followers.get
        if self.followers.low_bits == self.bits:  # then a context's numbers differ in their low bits alone
            wanted &= U((1 << self.bits) - 1)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = read(middle) < wanted[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        out = np.zeros(len(which), np.int64)
        inside = np.flatnonzero(low < end)
        hit = inside[read(low[inside]) == wanted[inside]]
        out[hit] = self.two[low[hit]]
        return out
