"""Operator 12: byte-level BPE with the tiktoken library and a local rank file, whole texts to ids and ids back to bytes.

The library matches its pattern over the whole text and merges the bytes of each match separately. Its matcher goes back over long
runs of white space and gives up on very long ones, so long texts are cut first, where the pattern can't tell the difference:

* before white space that follows another character: no match holds both, and none looks behind itself;
* where none comes, between an ASCII letter and a digit, or between one of them and ASCII punctuation after it;
* a run of white space of more than RUN characters is one match but for its last character, which may start the next match;
* a match of more than RUN characters without a place to cut is found by its class of characters and merged by itself.

Defined results: a null text counts as empty and has no ids; bytes that are not UTF-8 are read as U+FFFD; each row is encoded by
itself, whatever its doc_id (null or repeated); special tokens' strings are ordinary text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Characters of a text that is encoded in one call, and of a run that is treated by itself.
PART, RUN = 1 << 14, 1 << 11
#: Bytes of ids in one Arrow batch.
OUT_BYTES = 8 << 20

#: Places to cut. Python's white space holds all of the pattern's, so what comes before is surely none.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \n])")
_BETWEEN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")
#: The pattern's white space.
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_LONG_SPACE = re.compile(f"{_SPACE}{{{RUN},}}")


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text as strings whose matches are the text's; True: the string is one match as a whole."""
    at = 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1  # the last one is left for what follows
        if run.start() > at:
            yield from _cut(text, at, run.start())
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield from _cut(text, at, len(text))


def _cut(text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
    while end - at > PART:
        found = _BEFORE_SPACE.search(text, at + PART // 2, min(end, at + PART)) or _BETWEEN.search(text, at + PART // 2, min(end, at + PART)) or _BEFORE_SPACE.search(text, at + PART // 2, end)
        if found is None:
            break
        yield text[at : found.start()], False
        at = found.start()
    yield text[at:end], False


class RankEncoder:
    """Ids of whole texts as the library gives them, as an array of unsigned 32-bit integers."""

    kept: ClassVar[dict[tuple, RankEncoder]] = {}

    def __init__(self, path: str | None, pattern: str | None):
        import regex
        import tiktoken

        if path is None or pattern is None:
            import public_tokenizers

            path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    @classmethod
    def of(cls, path: str | None = None, pattern: str | None = None) -> RankEncoder:
        """The worker's encoder for this file."""
        if (path, pattern) not in cls.kept:
            cls.kept[path, pattern] = cls(path, pattern)
        return cls.kept[path, pattern]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= RUN:
            return np.array(self.library.encode_ordinary(text), dtype="<u4")
        found: list[int] = []
        for part, one in parts(text):
            if one:
                found += self.merged(part.encode())
            elif len(part) <= PART:
                found += self.library.encode_ordinary(part)
            else:  # no place to cut within PART characters
                for m in self.pattern.finditer(part):
                    found += self.merged(m.group().encode()) if len(m.group()) > RUN else self.library.encode_ordinary(m.group())
        return np.array(found, dtype="<u4")

    def merged(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, the first of equals, until none is left: with a heap, as the library's own loop is quadratic."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != upto:
                continue  # one side was merged meanwhile
            end[i], end[j] = upto, 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(piece[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[j]]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : upto])) is not None:
                heapq.heappush(heap, (r, before[i], upto))
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids.tolist())


def _strings(column: pa.Array) -> Iterator[str]:
    for raw in column.cast(pa.large_binary()):
        yield (raw.as_py() or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and ids as little-endian unsigned 32-bit integers. ranks: a rank file that every executor has."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder.of(ranks, pattern)
        for b in batches:
            at, found, held = 0, [], 0
            for k, text in enumerate(_strings(b.column(1)), 1):
                found.append(encoder.encode(text).tobytes())
                held += len(found[-1])
                if held >= OUT_BYTES or k == len(b):
                    many = pa.array([len(x) // 4 for x in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k - at), many, pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids"])
                    at, found, held = k, [], 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of encode() and raw, the bytes that the ids stand for (they need not be UTF-8 if ids were cut)."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder.of(ranks, pattern)
        for b in batches:
            raw = [encoder.decode(np.frombuffer(x.as_py(), dtype="<u4")) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "raw"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, raw binary")
