"""64-bit hashes of the words of whole Arrow columns, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Its hash starts from its length and takes
in eight bytes at a time, each time through a bijection of all 64 bits; what takes part in one step never meets another
word's at the same place by its form alone, as in a polynomial over a ring. Words of up to eight bytes and equal length
never collide. A word of more than LONG bytes goes through blake2b.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 5
#: Bytes of the longest word that is hashed in lockstep with others.
LONG = 256
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(1)
def lowered() -> np.ndarray:
    """What each byte counts as: capitals as their small letter, white space as a blank."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] = out[97:123]
    out[9:14] = 32
    return out


#: The first k bytes of eight.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, with zeros after the end."""
    text = np.concatenate([lowered()[data], np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", text, 0, (1,))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many each text has. data, offsets: as common.utf8 gives them."""
    n, texts = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros(0, U), np.zeros(texts, np.int64)
    inside = lowered()[data] != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]  # no word goes from one text into the next
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size, eight = stop - start, blocks(data)
    hashes = mix(size.astype(U) * U(BASE))
    hashes = mix(hashes ^ (eight[start] & FIRST[np.minimum(size, 8)]))
    open_, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(open_):
        left = size[open_] - done
        hashes[open_] = mix(hashes[open_] ^ (eight[start[open_] + done] & FIRST[np.minimum(left, 8)]))
        done += 8
        open_ = open_[left > 8]
    for k in np.flatnonzero(size > LONG).tolist():
        hashes[k] = np.frombuffer(hashlib.blake2b(lowered()[data[start[k] : stop[k]]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return hashes, np.diff(np.searchsorted(start, offsets))


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of `size` bytes (8 at most)."""
    many = max(0, len(data) - size + 1)
    return mix(mix(np.full(many, (size * BASE) % (1 << 64), U)) ^ (blocks(data)[:many] & FIRST[size]))


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mix(h ^ U((seed * BASE) % (1 << 64)))


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of `size` words in order, and how many each text has; a shorter text has one of all its words, an empty one none."""
    total = len(hashes)
    ends = np.cumsum(counts)
    if total == 0:
        return np.zeros(0, U), np.zeros(len(counts), np.int64)
    rolled = np.zeros(total, U)
    for k in range(min(size, total)):
        rolled[: total - k] = mix(rolled[: total - k]) + hashes[k:]
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    take = np.arange(many.sum()) + np.repeat(ends - counts - (np.cumsum(many) - many), many)
    out = mix(rolled[take])
    stops = np.cumsum(many)
    for k in np.flatnonzero((counts > 0) & (counts < size)):  # few: whole sequences
        h = np.zeros(1, U)
        for w in hashes[ends[k] - counts[k] : ends[k]]:
            h = mix(h) + w
        out[stops[k] - 1] = seeded(h, int(counts[k]))[0]
    return out, many
