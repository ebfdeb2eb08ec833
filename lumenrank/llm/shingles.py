"""Word shingles of whole Arrow batches and their XXH64 hashes, by numpy passes over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import blocks

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Bytes of text that are looked at together.
BLOCK = 1 << 18
#: Longer inputs are hashed one by one.
_LONG = 512
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(x: np.ndarray) -> np.ndarray:
    return _turn(x * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of data[start:end] for many ranges."""
    n = end - start
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", raw, strides=(1,))
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(n), s + _P5, dtype=np.uint64)
        wide = np.flatnonzero((n >= 32) & (n <= _LONG))
        if len(wide):
            order = wide[np.argsort(-n[wide], kind="stable")]  # ranges that go on come first
            stripes = n[order] // 32
            v = [np.full(len(order), x, dtype=np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for k in range(int(stripes[0])):
                more = int(np.searchsorted(-stripes, -k, side="left"))
                at = start[order[:more]] + 32 * k
                for i in range(4):
                    v[i][:more] = _turn(v[i][:more] + eight[at + 8 * i] * _P2, 31) * _P1
            g = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                g = (g ^ _lane(x)) * _P1 + _P4
            h[order] = g
        h += n.astype(np.uint64)
        at, left = start + (n // 32) * 32, n % 32
        for _ in range(3):
            some = np.flatnonzero(left >= 8)
            if not len(some):
                break
            h[some] = _turn(h[some] ^ _lane(eight[at[some]]), 27) * _P1 + _P4
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        h[some] = _turn(h[some] ^ (four[at[some]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[some] += 4
        left[some] -= 4
        for _ in range(3):
            some = np.flatnonzero(left > 0)
            if not len(some):
                break
            h[some] = _turn(h[some] ^ (raw[at[some]].astype(np.uint64) * _P5), 11) * _P1
            at[some] += 1
            left[some] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(n > _LONG).tolist():
        import xxhash

        h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes(), seed)
    return h


def _block(data: np.ndarray, offsets: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts of a block how many shingles each has, and all their hashes in order."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(rows, np.int64), np.zeros(0, np.uint64)
    low, space = _LOWER[data], _SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)  # first bytes of texts
    first[offsets[:-1]] = True
    follows = np.empty(len(data), dtype=bool)  # after white space, or first
    follows[0], follows[1:] = True, space[:-1]
    follows |= first[:-1]
    begins = np.flatnonzero(~space & follows)
    if not len(begins):
        return np.zeros(rows, np.int64), np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, begins, side="right") - 1
    count = np.bincount(row, minlength=rows)
    # Words of a text are put side by side with one space between them.
    later = np.concatenate([[False], row[1:] == row[:-1]])
    keep = ~space
    keep[begins[later] - 1] = True
    low[space] = 0x20
    flat = low[keep]
    place = np.cumsum(keep) - 1
    start = place[begins]
    end = np.append(start[1:] - later[1:], len(flat))
    # A shingle for each word that has enough words from it on, or one for a short text.
    top = np.cumsum(count)
    many = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    head = np.repeat(top - count, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    last = head + np.repeat(np.minimum(count, words), many) - 1
    return many, xxh64(flat, start[head], end[last], seed)


def _pieces(data: np.ndarray, words: int, limit: int) -> Iterator[np.ndarray]:
    """A long text in pieces, each beginning with the last words of the one before: no shingle is lost or comes twice."""
    at, held = 0, b""
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + limit]])
            end = end + int(gap[0]) if len(gap) else min(end + limit, len(data))
        piece = held + b" " + data[at:end].tobytes()
        at = end
        parts = piece.split()
        if at < len(data) and len(parts) < words:
            held = b" ".join(parts)  # too few words yet
            continue
        yield np.frombuffer(piece, np.uint8)
        held = b" ".join(parts[len(parts) - (words - 1) :]) if words > 1 else b""
        if at < len(data) and _SPACE[data[at:]].all():
            return


def of_batch(data: np.ndarray, offsets: np.ndarray, words: int, seed: int, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: the first text's number, how many shingles each has, and all hashes in order, repeats included."""
    for lo, hi in blocks(offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        if hi - lo == 1 and len(part) > 2 * limit:
            found = [_block(p, np.array([0, len(p)]), words, seed)[1] for p in _pieces(part, words, limit)]
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield lo, np.array([len(hashes)]), hashes
        else:
            yield lo, *_block(part, offsets[lo : hi + 1] - offsets[lo], words, seed)


def of_text(text: bytes, words: int, seed: int) -> np.ndarray:
    """The hashes of one text's shingles."""
    data = np.frombuffer(text, np.uint8)
    found = [h for _, _, h in of_batch(data, np.array([0, len(data)]), words, seed)]
    return found[0] if found else np.zeros(0, np.uint64)
