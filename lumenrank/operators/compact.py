"""Search over packed codes: vectors are turned, coded with 2, 4 or 8 bits a component and stored as one binary column.

A query is prepared once: turned, or tabulated for each byte of a payload as what the codes in that byte add to the score. A
document's score is then its norm times the sum of one table entry for each of its bytes; for many queries at once, times the
product of its codes' levels with all turned queries. Nothing is turned back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import hadamard
from .blocks import BLOCK, PAIRS, in_blocks, matrix, together, top_k_by_blocks
from .ordering import spread

#: Queries of a block below which tables are cheaper than a product with decoded levels.
FEW = 8


@dataclass(frozen=True)
class Codec:
    """How vectors of one dimension are stored: codes, then the norm as a little-endian float of norm_bytes (4 or 8)."""

    dim: int
    bits: int
    seed: int = 1
    turn: str = "dense"
    norm_bytes: int = 4

    def __post_init__(self):
        if self.bits not in (2, 4, 8):
            raise ValueError("bits must be 2, 4 or 8")
        if self.turn not in ("dense", "hadamard"):
            raise ValueError("turn must be dense or hadamard")
        if self.norm_bytes not in (4, 8):
            raise ValueError("norm_bytes must be 4 or 8")

    @property
    def code_bytes(self) -> int:
        return -(-self.dim * self.bits // 8)

    @property
    def payload_bytes(self) -> int:
        return self.code_bytes + self.norm_bytes

    @property
    def levels(self) -> np.ndarray:
        from .ranking import codebook

        return codebook(self.bits)

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        if self.turn == "hadamard":
            return hadamard.turn(vectors, self.seed)
        from .ranking import rotation

        return vectors @ rotation(self.dim, self.seed).T

    def turned_back(self, vectors: np.ndarray) -> np.ndarray:
        if self.turn == "hadamard":
            return hadamard.turn_back(vectors, self.seed)
        from .ranking import rotation

        return vectors @ rotation(self.dim, self.seed)

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code for each component of the turned unit vectors, and norms; a zero vector has norm 0."""
        levels = self.levels
        norms = np.linalg.norm(vectors, axis=1)
        unit = vectors / np.where(norms == 0, 1, norms)[:, None]
        return np.searchsorted((levels[1:] + levels[:-1]) / 2, self.turned(unit) * np.sqrt(self.dim)).astype(np.uint8), norms

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Codes as bytes, the first of a byte in its lowest bits; what is left of the last byte is 0."""
        each = 8 // self.bits
        filled = np.zeros((len(codes), self.code_bytes * each), np.uint8)
        filled[:, : self.dim] = codes
        slots = filled.reshape(len(codes), self.code_bytes, each)
        return np.bitwise_or.reduce(slots << (np.arange(each, dtype=np.uint8) * self.bits), axis=2).astype(np.uint8)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        each = 8 // self.bits
        slots = packed[:, :, None] >> (np.arange(each, dtype=np.uint8) * self.bits) & ((1 << self.bits) - 1)
        return slots.reshape(len(packed), -1)[:, : self.dim]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """A row of payload_bytes for each vector."""
        codes, norms = self.codes(vectors)
        return np.concatenate([self.pack(codes), norms.astype(f"<f{self.norm_bytes}")[:, None].view(np.uint8)], axis=1)

    def split(self, payloads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes and norms of payloads."""
        norms = np.ascontiguousarray(payloads[:, self.code_bytes :]).view(f"<f{self.norm_bytes}")[:, 0]
        return payloads[:, : self.code_bytes], norms.astype(np.float64)

    def decode(self, payloads: np.ndarray) -> np.ndarray:
        packed, norms = self.split(payloads)
        return self.turned_back(self.levels[self.unpack(packed)] / np.sqrt(self.dim)) * norms[:, None]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, byte of a payload, value of that byte): what the byte adds to the score of a document of norm 1."""
        each = 8 // self.bits
        filled = np.zeros((len(queries), self.code_bytes * each))
        filled[:, : self.dim] = self.turned(queries) / np.sqrt(self.dim)
        values = self.levels[np.arange(256)[:, None] >> (np.arange(each) * self.bits) & ((1 << self.bits) - 1)]
        return filled.reshape(len(queries), self.code_bytes, each) @ values.T

    def scores(self, tables: np.ndarray, payloads: np.ndarray) -> np.ndarray:
        """Inner products (documents x queries) by tables()."""
        packed, norms = self.split(payloads)
        total = np.zeros((len(payloads), len(tables)))
        for p in range(self.code_bytes):
            total += tables[:, p].T[packed[:, p]]
        return total * norms[:, None]

    def products(self, turned: np.ndarray, payloads: np.ndarray) -> np.ndarray:
        """scores() of many queries, turned() before."""
        packed, norms = self.split(payloads)
        return (self.levels[self.unpack(packed)] / np.sqrt(self.dim)) @ turned.T * norms[:, None]


def _payloads(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of one width as a matrix of bytes."""
    if column.null_count:
        raise ValueError("a payload is missing")
    raw = column.cast(pa.binary())
    at = np.frombuffer(raw.buffers()[1], np.int32, raw.offset + len(raw) + 1)[raw.offset :]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if len(data) != width * len(raw):
        raise ValueError(f"payloads are not of {width} bytes")
    return data.reshape(len(raw), width)


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def store(docs: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, payload) of docs (doc_id, y): codec.payload_bytes each."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), _binary(codec.encode(matrix(b.column(1))))], ["doc_id", "payload"])

    return docs.select("doc_id", "y").mapInArrow(run, "doc_id long, payload binary")


def decoded(stored: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, y) that the payloads stand for."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                y = codec.decode(_payloads(b.column(1), codec.payload_bytes))
                offsets = pa.array((np.arange(len(y) + 1) * codec.dim).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], ["doc_id", "y"])

    return stored.select("doc_id", "payload").mapInArrow(run, "doc_id long, y array<double>")


def search(queries: DataFrame, stored: DataFrame, k: int, codec: Codec, digits: int | None = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k of store() for each of queries (query_id, x), by inner product."""

    def scorer(asked: np.ndarray):
        if len(asked) < FEW:
            tables = codec.tables(asked)
            return lambda b: codec.scores(tables, _payloads(b.column(1), codec.payload_bytes))
        turned = codec.turned(asked)
        return lambda b: codec.products(turned, _payloads(b.column(1), codec.payload_bytes))

    return top_k_by_blocks(queries, stored, ["payload"], k, scorer, digits)


def possible(queries: DataFrame, docs: DataFrame, codec: Codec, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score) of all pairs whose exact inner product may reach the query's floor, by what codes stand for.

    queries: (query_id, x, floor); docs: (doc_id, y). A vector's exact score is at most the size of the query times what its
    codes lose away from the score of its codes, so no pair that reaches the floor is left out.
    """
    spark, docs = ship(docs.sparkSession), spread(docs.select("doc_id", "y"))

    def one(ids: np.ndarray, asked: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, asked))  # at most `block` queries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, m = shared.value
            if not len(q):
                return
            x, floor, step = m[:, :-1], m[:, -1], max(1, PAIRS // len(q))
            size = np.linalg.norm(x, axis=1)
            for b in batches:
                for at in range(0, len(b), step):
                    part = b.slice(at, step)
                    y = matrix(part.column(1))
                    known = codec.decode(codec.encode(y))
                    s = known @ x.T
                    row, query = np.nonzero(~(s + np.linalg.norm(y - known, axis=1)[:, None] * size < floor))
                    yield pa.RecordBatch.from_arrays([pa.array(q[query]), pa.array(part.column(0).to_numpy()[row]), pa.array(s[row, query])], ["query_id", "doc_id", "score"])

        return docs.mapInArrow(run, "query_id long, doc_id long, score double")

    told = queries.select("query_id", F.concat(F.transform("x", lambda v: v.cast("double")), F.array("floor")).alias("x"))
    return together([one(*b) for b in in_blocks(told, block)])
