"""Words of whole Arrow batches as 64-bit hashes, by numpy passes over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that belong to words: digits, letters, and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse among 64-bit numbers
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; kept by the worker."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """start and end (in bytes), row and hash of each word; first[r] is the number of the first word of row r."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        inside = WORD_BYTES[low]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(data):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cut = offsets[offsets < len(data)]
            before[cut] = False
            after[offsets[offsets > 0] - 1] = False
        self.data = low
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[low] * up[: len(data)], out=sums[1:])
        self.hash = (sums[self.end] - sums[self.start]) * down[self.start]
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of n words of one row."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(len(self.hash) - n + 1, dtype=np.uint64)
        for k in range(n):
            total += self.hash[k : k + len(total)] * _MIX[k]
        keep = np.flatnonzero(self.row[: len(total)] == self.row[n - 1 :])
        return keep, total[keep]


def of_texts(texts: list[str]) -> Words:
    raw = [(t or "").encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))


def pieces(data: np.ndarray, limit: int, share: int) -> Iterator[tuple[int, int, Words]]:
    """A long text as pieces that share some words: the number of the first word, that of the next piece (or of all words), the words."""
    at, base = 0, 0
    while True:
        end = at + limit
        if end < len(data):
            gaps = np.flatnonzero(~WORD_BYTES[LOWER[data[at:end]]])
            if not len(gaps):  # within one word
                limit *= 2
                continue
            end = at + int(gaps[-1]) + 1
        end = min(end, len(data))
        words = Words(data[at:end], np.array([0, end - at]))
        many = len(words.start)
        if end == len(data):
            yield base, base + many, words
            return
        back = min(share, many)
        onward = at + int(words.start[many - back]) if back else end
        if onward == at:
            limit *= 2
            continue
        yield base, base + many - back, words
        at, base = onward, base + many - back


def word_hash(word: str) -> np.uint64:
    return of_texts([word]).hash[0]


class HashSet:
    """Which of many hashes are in a set: a table of bits turns nearly all away before the exact search."""

    def __init__(self, members: np.ndarray):
        self.members = np.unique(members)
        self.bits = max(12, min(24, int(len(self.members)).bit_length() + 5))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self._slot(self.members)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of members, and which members."""
        maybe = np.flatnonzero(self.table[self._slot(h)])
        if not len(self.members) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.members, h[maybe]), len(self.members) - 1)
        hit = self.members[at] == h[maybe]
        return maybe[hit], at[hit]
