"""Prefix-free parsing of byte strings: rolling-hash triggers cut a text into overlapping phrases."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Length of the strings whose repetition counts.
LENGTH = 100
#: Bytes of a trigger.  Each string of LENGTH bytes has exactly one: its k-mer of least hash, the leftmost of equals.
KMER = 32
_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
PHRASE = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("phrase2", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("count", "u1")])


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64."""
    size = 1 << max(10, (n - 1).bit_length())
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            powers[filled : 2 * filled] = powers[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        out.append(powers)
    return tuple(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of any parts of a byte string."""

    def __init__(self, data: np.ndarray):
        size = len(data) + 1
        powers, self.inverse = (p[:size] for p in _powers(size))
        self.sums = np.zeros(size, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.sums[1:])

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of all parts of one length."""
        return _mix((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """Keyed 128-bit digests of parts of a byte string, as two columns: with a key drawn for each run, equal ones mean equal bytes."""
    body, start = memoryview(np.ascontiguousarray(data)), hashlib.blake2b(digest_size=16, key=key)
    out = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        h = start.copy()
        h.update(body[a:b])
        out.append(h.digest())
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    before = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], before[width - 1 : width - 1 + n])


def parse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Phrases of the documents at [start, end) of `data`, and their places in it.

    A phrase spans all strings of LENGTH bytes that share one trigger occurrence: `count` of them begin at
    consecutive places from `start` on, and the phrase reaches to the end of the last.  Phrases so overlap
    by LENGTH - 1 bytes, each string lies in exactly one, and equal strings lie in phrases of equal triggers.  The rolling hash
    only chooses triggers, so that its collisions do no harm; phrases are told apart by their digests.
    """
    if len(data) < LENGTH or not len(starts):
        return np.zeros(0, PHRASE), np.zeros(0, np.int64)
    rolling = Rolling(data)
    grams = rolling.fixed(KMER)
    least = _sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), LENGTH - KMER + 1)
    own = np.repeat(np.arange(len(starts)), np.maximum(0, ends - starts - LENGTH + 1))
    if not len(own):
        return np.zeros(0, PHRASE), np.zeros(0, np.int64)
    room = np.maximum(0, ends - starts - LENGTH + 1)
    place = np.arange(len(own)) - np.repeat(np.cumsum(room) - room, room) + starts[own]
    at = (least[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
    count = np.diff(np.append(new, len(own)))
    begin = place[new]
    out = np.empty(len(new), PHRASE)
    out["trigger"] = grams[at[new]]
    out["phrase"], out["phrase2"] = digests(data, begin, begin + count + LENGTH - 1, key).T
    out["doc"] = docs[own[new]]
    out["start"] = begin - starts[own[new]]
    out["count"] = count
    return out, begin


def places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where the strings of LENGTH bytes begin that start at `count` consecutive places from each `begin`."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - begin, count)


def suffix_order(data: np.ndarray, place: np.ndarray, ties: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of `data` at the places, ordered by their first LENGTH bytes and then by `ties` (the last one first), and whether
    each shares all LENGTH bytes with the one before it.
    """
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[place]).view(f"S{LENGTH}").ravel()
    order = np.lexsort(ties)
    order = order[np.argsort(heads[order], kind="stable")]
    heads = heads[order]
    return order, np.concatenate([[False], heads[1:] == heads[:-1]])[: len(order)]
