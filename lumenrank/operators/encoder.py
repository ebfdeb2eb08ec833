"""Model-level composites in numpy over Arrow batches: the attention encoder, token pooling, channel quantisers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .compact import Codec


@dataclass
class Weights:
    """Matrices of the encoder; one set serves all repeats."""

    embedding: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    o: np.ndarray
    up: np.ndarray
    down: np.ndarray

    @classmethod
    def seeded(cls, vocabulary: int, dim: int, hidden: int, seed: int = 1) -> Weights:
        g = np.random.default_rng(seed)
        m = lambda a, b: g.standard_normal((a, b)) / np.sqrt(a)
        return cls(g.standard_normal((vocabulary, dim)), m(dim, dim), m(dim, dim), m(dim, dim), m(dim, dim), m(dim, hidden), m(hidden, dim))


def _layernorm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3)))


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, top_k: int | None = None) -> np.ndarray:
    """Softmax attention without scaling, of one text or a batch; with top_k each query keeps its best keys only (0: ceil(sqrt(n)))."""
    s = q @ np.swapaxes(k, -1, -2)
    if top_k is not None:
        n = s.shape[-1]
        keep = min(n, top_k if top_k > 0 else int(np.ceil(np.sqrt(n))))
        np.put_along_axis(s, np.argsort(-s, axis=-1, kind="stable")[..., keep:], -np.inf, axis=-1)
    return _softmax(s) @ v


#: Queries and keys of a block of scores; texts that are longer go through attend_blocks().
SCORE_BLOCK = 1024


@dataclass
class Coded:
    """Rows of keys or values as payloads of a codec, decoded block by block."""

    codec: Codec
    payloads: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, bits: int, seed: int = 1) -> Coded:
        codec = Codec(rows.shape[-1], bits, seed, "hadamard")
        return cls(codec, codec.encode(rows))

    def __len__(self) -> int:
        return len(self.payloads)

    def __getitem__(self, rows: slice) -> np.ndarray:
        return self.codec.decode(self.payloads[rows])


def attend_blocks(q: np.ndarray, k: np.ndarray | Coded, v: np.ndarray | Coded, top_k: int | None = None, block: int = SCORE_BLOCK) -> np.ndarray:
    """attend() of one text without its n x n scores: for a block of queries, the keys come block by block, and the
    maximum, the sum of weights and the weighted values so far are turned to each new maximum.

    With top_k the best keys so far of each query (of equals, the earlier ones) are kept instead. Keys and values may be
    Coded, of different bits.
    """
    n, out = len(k), []
    keep = None if top_k is None else min(n, top_k if top_k > 0 else int(np.ceil(np.sqrt(n))))
    for at in range(0, len(q), block):
        own = q[at : at + block]
        if keep is None:
            most, weight, total = np.full((len(own), 1), -np.inf), np.zeros((len(own), 1)), 0.0
            for b in range(0, n, block):
                s = own @ k[b : b + block].T
                now = np.maximum(most, s.max(axis=1, keepdims=True))
                e, fade = np.exp(s - now), np.exp(most - now)
                weight, total, most = weight * fade + e.sum(axis=1, keepdims=True), total * fade + e @ v[b : b + block], now
            out.append(total / weight)
            continue
        best, place = np.zeros((len(own), 0)), np.zeros((len(own), 0), dtype=np.int64)
        for b in range(0, n, block):
            s = own @ k[b : b + block].T
            s, where = np.concatenate([best, s], axis=1), np.concatenate([place, np.broadcast_to(np.arange(b, b + s.shape[1]), s.shape)], axis=1)
            order = np.argsort(-s, axis=1, kind="stable")[:, :keep]
            best, place = np.take_along_axis(s, order, 1), np.take_along_axis(where, order, 1)
        weights, total = _softmax(best), 0.0
        for b in range(0, n, block):  # each value block once, for the places that lie in it
            held = v[b : b + block]
            part = np.zeros((len(own), len(held)))
            row, col = np.nonzero((place >= b) & (place < b + len(held)))
            part[row, place[row, col] - b] = weights[row, col]
            total = total + part @ held
        out.append(total)
    return np.concatenate(out)


def encode_tokens(tokens: np.ndarray, mask: np.ndarray, w: Weights, repeats: int = 2, top_k: int | None = None, coded_bits: tuple[int, int] | None = None, block: int = SCORE_BLOCK) -> np.ndarray:
    """The pooled vector of a text, or of each of a batch of one length; zeros if the mask leaves nothing.

    Scores are held for `block` queries and keys at once. coded_bits: keys and values go through codes of so many bits.
    """
    x = w.embedding[tokens]

    def mixed(x: np.ndarray) -> np.ndarray:
        q, k, v = x @ w.q, x @ w.k, x @ w.v
        if coded_bits is None and x.shape[-2] <= block:
            return attend(q, k, v, top_k)
        if x.ndim > 2:
            return np.stack([mixed(y) for y in x])
        if coded_bits is not None:
            k, v = Coded.of(k, coded_bits[0]), Coded.of(v, coded_bits[1])
        return attend_blocks(q, k, v, top_k, block)

    for _ in range(repeats):
        a = _layernorm(mixed(x) @ w.o + x)
        x = _layernorm(_gelu(a @ w.up) @ w.down + a)
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    unit = np.where(n == 0, x, x / np.where(n == 0, 1, n))
    kept = (np.asarray(mask) != 0).astype(float)[..., None]
    return (unit * kept).sum(axis=-2) / np.maximum(kept.sum(axis=-2), 1)


#: Scores (texts * length * length) that one batch holds.
BATCH_SCORES = 1 << 22


def embed(rows: DataFrame, weights: Weights, repeats: int = 2, top_k: int | None = None, coded_bits: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, vector) of rows (doc_id, ids), or (doc_id, ids, mask); the weights are broadcast, their size is the model's.

    Texts of one length go through the matrices together, so no padding is needed; ids that a mask marks with 0 take part
    in the attention and are left out of the mean.
    """
    shared = ship(rows.sparkSession).sparkContext.broadcast(weights)
    masked = "mask" in rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for f in frames:
            ids = [np.asarray(i, dtype=np.int64) for i in f["ids"]]
            masks = [np.asarray(m) for m in f["mask"]] if masked else [np.ones(len(i)) for i in ids]
            length = np.array([len(i) for i in ids])
            out = np.zeros((len(ids), w.embedding.shape[1]))
            for n in np.unique(length[length > 0]):
                at = np.flatnonzero(length == n)
                size = max(1, BATCH_SCORES // int(n * n))
                for k in range(0, len(at), size):
                    part = at[k : k + size]
                    out[part] = encode_tokens(np.stack([ids[i] for i in part]), np.stack([masks[i] for i in part]), w, repeats, top_k, coded_bits)
            yield pd.DataFrame({"doc_id": f["doc_id"], "vector": list(out)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids", *(["mask"] if masked else [])).mapInPandas(run, f"doc_id {kind}, vector array<double>")


def padded(rows: DataFrame, longest: int, pad: int = 0) -> DataFrame:
    """(doc_id, ids, mask): ids cut or filled up to one length, and which of them are the text's own."""
    n = F.least(F.size("ids"), F.lit(longest))
    fill = lambda value, times: F.transform(F.array_repeat(F.lit(0), times), lambda _: F.lit(value))
    ids = F.concat(F.slice("ids", F.lit(1), n), fill(pad, F.lit(longest) - n))
    return rows.select("doc_id", ids.alias("ids"), F.concat(fill(1, n), fill(0, F.lit(longest) - n)).alias("mask"))


def embed_texts(docs: DataFrame, tokenizer, weights: Weights, longest: int | None = None, repeats: int = 2, top_k: int | None = None, coded_bits: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, vector) of texts (doc_id, text), by the tokeniser's ids."""
    from .bpe import encode

    return embed(encode(docs, tokenizer, longest), weights, repeats, top_k, coded_bits)


#: Natural logarithms between which an 8-bit norm lies.
LOG_NORM = (-16.0, 16.0)


def coded_norm(norm: np.ndarray) -> np.ndarray:
    """Norms as codes of 8 bits on a logarithmic scale; what isn't positive is 0."""
    low, high = LOG_NORM
    share = (np.log(np.where(norm > 0, norm, 1)) - low) / (high - low)
    return np.where(norm > 0, np.floor(np.clip(share, 0, 1) * 255 + 0.5), 0).astype(np.uint8)


def decoded_norm(code: np.ndarray) -> np.ndarray:
    low, high = LOG_NORM
    return np.exp(low + code / 255 * (high - low))


def channel_codec(pixels: DataFrame, bits: int, seed: int = 1, turn: str = "dense", log_norm: bool = False) -> DataFrame:
    """pixels (n, y, x, channels) with `decoded`: each pixel's channel vector turned, coded and decoded.

    turn: by a dense rotation or by "hadamard" butterflies. log_norm: norms go through codes of 8 bits as well.
    """
    ship(pixels.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = np.stack(f["channels"].to_numpy()).astype(np.float64)
                codec = Codec(v.shape[1], bits, seed, turn, 8)
                payload = codec.encode(v)
                if log_norm:
                    packed, norms = codec.split(payload)
                    again = decoded_norm(coded_norm(norms))[:, None].view(np.uint8)
                    payload = np.concatenate([packed, again], axis=1)
                yield f.assign(decoded=list(codec.decode(payload)))

    return pixels.select("n", "y", "x", "channels").mapInPandas(run, "n long, y long, x long, channels array<double>, decoded array<double>")


def farthest_representatives(blocks: DataFrame, count: int) -> DataFrame:
    """(block, nth, k): farthest-first points of each block (block, k, vector), the smallest k first; blocks are small by design."""
    ship(blocks.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        v = np.stack(f["vector"].to_numpy()).astype(np.float64)
        chosen, far = [0], np.linalg.norm(v - v[0], axis=1)
        while len(chosen) < min(count, len(v)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(v - v[chosen[-1]], axis=1))
        return pd.DataFrame({"block": f["block"].iloc[0], "nth": range(len(chosen)), "k": f["k"].to_numpy()[chosen]})

    return blocks.select("block", "k", "vector").groupBy("block").applyInPandas(run, "block long, nth long, k long")
