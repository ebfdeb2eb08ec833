"""Byte-pair tokenisation of normalised words: training on word counts, and encoding by ranked merges."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bpe_normalize
from ..ship import ship
from ..tables import materialise
from .ordering import spread

#: Special tokens in the order of their ids.
SPECIAL = ("<pad>", "<unk>", "<bos>", "<eos>")
LEAST_COUNT = 2


@dataclass
class Model:
    tokens: list[str]
    merges: list[tuple[str, str]]
    ids: dict[str, int] = field(init=False)
    ranks: dict[tuple[str, str], int] = field(init=False)

    def __post_init__(self):
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.ranks = {m: i for i, m in enumerate(self.merges)}

    def word(self, word: str) -> list[int]:
        """Ids of one word: the merge of least rank is applied, leftmost first, until none applies."""
        parts = list(word)
        while len(parts) > 1:
            best = min(((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(len(self.ranks), 0))
            if best[0] == len(self.ranks):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ids.get(p, self.ids["<unk>"]) for p in parts]


#: Different words up to which the merges are found on the driver; pairs that a round looks at; merges until words are cut anew.
DRIVER_WORDS, LOOKED_AT, REWRITTEN = 200_000, 2048, 16
#: Words of a piece, and the number that ends a word.
PIECE, END = 50_000, -1


def train(texts: DataFrame, vocabulary: int, driver_words: int = DRIVER_WORDS) -> Model:
    """Merges of the most frequent pair (of equals, the smallest), over all words of all texts, until the vocabulary is full.

    The cluster counts the words. Up to driver_words different ones are a bounded table, and the driver finds the merges;
    more of them stay in the cluster, and every round of merges is a job that brings the counts of pairs of tokens to the driver. Both give the same model.
    """
    counted = texts.select(F.explode(F.split(bpe_normalize(F.col("text")), " +")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("often"))
    words = materialise(counted, "bpe-words")
    tokens = list(SPECIAL) + sorted(r[0] for r in words.select(F.explode(F.split("w", "")).alias("c")).where("c <> ''").distinct().collect())  # characters
    if words.count() <= driver_words:
        return _merges_here(tokens, [(tuple(w), n) for w, n in words.collect()], vocabulary)
    return _merges_by_rounds(tokens, words, vocabulary)


def _merges_here(tokens: list[str], words: list[tuple[tuple[str, ...], int]], vocabulary: int) -> Model:
    merges: list[tuple[str, str]] = []
    known = set(tokens)
    parts, often = [w for w, _ in words], [n for _, n in words]
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = {}

    def count(k: int, sign: int) -> None:
        for p in zip(parts[k], parts[k][1:], strict=False):
            pairs[p] += sign * often[k]
            if sign > 0:
                where.setdefault(p, set()).add(k)

    for k in range(len(parts)):
        count(k, 1)
    while len(tokens) < vocabulary:
        best = min(pairs.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
        if best[1] < LEAST_COUNT:
            break
        left, right = best[0]
        merges.append(best[0])
        if left + right not in known:
            known.add(left + right)
            tokens.append(left + right)
        for k in where.pop(best[0]):  # only words that may hold the pair are cut and counted anew
            count(k, -1)
            parts[k] = tuple(merged(list(parts[k]), [best[0]]))
            count(k, 1)
    return Model(tokens, merges)


def merged(parts: list[str], merges: list[tuple[str, str]]) -> list[str]:
    """A word's parts after these merges, one after the other."""
    for left, right in merges:
        if left not in parts:
            continue
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
                out.append(left + right)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def chosen(top: list[tuple[str, str, int]], known: set[str], whole: bool) -> list[tuple[str, str]]:
    """The merges that surely come next, in order, from the most frequent pairs (left, right, n), sorted by (-n, pair).

    The first always does. A later one does if it shares no token with those before it, so that its count stays, and if
    all pairs that do share one are rarer: a pair that a merge makes new occurs at most as often as one that had a part of
    the merge. A merge that makes a token that is there already ends the round, as counts may grow then. whole: the list
    holds all pairs there are; else nothing is known of others that are as frequent as its last.
    """
    found: list[tuple[str, str]] = []
    used: set[str] = set()
    for i, (left, right, n) in enumerate(top):
        if found:
            if not whole and n == top[-1][2]:
                break
            ties = [p for p in top[i:] if p[2] == n]
            if any(p[0] in used or p[1] in used for p in ties):
                break
        found.append((left, right))
        used |= {left, right}
        if left + right in known:
            break
        known.add(left + right)
    return found


def _cut(ids: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbered parts of many words, each ended by END, after these merges (left, right, new), one after the other."""
    for left, right, new in merges:
        at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
        if left == right and len(at):  # of a run every second pair, from its start
            run = np.cumsum(np.concatenate([[1], np.diff(at) != 1])) - 1
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
        if len(at):
            ids[at] = new
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
    return ids


def _counted(ids: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left * 2^32 + right) of numbered parts, and how often they occur."""
    word = np.cumsum(ids == END) - (ids == END)
    inner = (ids[:-1] != END) & (ids[1:] != END)
    pairs, of = np.unique((ids[:-1][inner].astype(np.int64) << 32) | ids[1:][inner], return_inverse=True)
    return pairs, np.bincount(of, often[word[:-1][inner]], len(pairs)).astype(np.int64)  # whole numbers up to 2^53


def _merges_by_rounds(tokens: list[str], words: DataFrame, vocabulary: int) -> Model:
    """Words are a table of pieces, up to PIECE words as numbers of their parts. A round counts the pairs of all pieces after the merges
    that came since these were last written, and takes the pairs on top; now and then the pieces are written anew."""
    ship(words.sparkSession)
    merges: list[tuple[str, str]] = []
    names, number = list(tokens), {t: i for i, t in enumerate(tokens)}
    known = set(tokens)
    shared = words.sparkSession.sparkContext.broadcast(dict(number))  # characters

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            for at in range(0, len(b), PIECE):
                part = b.slice(at, PIECE)
                ids = [i for w in part.column(0).to_pylist() for i in (*(of[c] for c in w), END)]
                yield pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int32).tobytes()]), pa.array([part.column(1).to_numpy().astype(np.int64).tobytes()])], ["ids", "often"])

    base = materialise(spread(words.select("w", "often")).mapInArrow(numbered, "ids binary, often binary"), "bpe-parts")

    def changed(of: list[tuple[int, int, int]], count: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, often in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    cut = _cut(np.frombuffer(ids, np.int32).copy(), of)
                    if count:
                        pairs, n = _counted(cut, np.frombuffer(often, np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array([cut.tobytes()]), pa.array([often])], ["ids", "often"])

        return run

    pending: list[tuple[int, int, int]] = []
    while len(names) < vocabulary:
        if len(pending) >= REWRITTEN:
            base, pending = materialise(base.mapInArrow(changed(list(pending), False), "ids binary, often binary"), "bpe-parts"), []
        now = base.mapInArrow(changed(list(pending), True), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        # Pairs of tokens: at most the square of the vocabulary, however many words there are; equals go by their texts.
        held = [(names[p >> 32], names[p & 0xFFFFFFFF], n) for p, n in now.where(F.col("n") >= LEAST_COUNT).collect()]
        top = heapq.nsmallest(LOOKED_AT, held, key=lambda x: (-x[2], x[0], x[1]))
        if not top:
            break
        for left, right in chosen(top, set(known), len(top) < LOOKED_AT):
            if len(names) >= vocabulary:
                break
            merges.append((left, right))
            if left + right not in known:
                known.add(left + right)
                number[left + right] = len(names)
                names.append(left + right)
            pending.append((number[left], number[right], number[left + right]))
    return Model(names, merges)


def encode(docs: DataFrame, model: Model, longest: int | None = None) -> DataFrame:
    """docs (doc_id, text) with ids: <bos>, the words' tokens, <eos>; cut to `longest`, keeping the end."""
    shared = ship(docs.sparkSession).sparkContext.broadcast((model.tokens, model.merges))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        memory: dict[str, list[int]] = {}
        bos, eos = m.ids["<bos>"], m.ids["<eos>"]
        for f in frames:
            out = []
            for text in f["n"]:
                ids = [bos]
                for w in (text or "").split(" "):
                    if w:
                        if w not in memory:
                            if len(memory) > 200_000:
                                memory.clear()
                            memory[w] = m.word(w)
                        ids.extend(memory[w])
                ids.append(eos)
                out.append([*ids[: longest - 1], eos] if longest and len(ids) > longest else ids)
            yield pd.DataFrame({"doc_id": f["doc_id"], "ids": out})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", bpe_normalize(F.coalesce("text", F.lit(""))).alias("n")).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def encode_distinct(docs: DataFrame, model: Model, longest: int | None = None) -> DataFrame:
    """encode() with every different text encoded once."""
    texts = docs.groupBy("text").agg(F.min("doc_id").alias("first"))
    coded = encode(texts.select(F.col("first").alias("doc_id"), "text"), model, longest).withColumnRenamed("doc_id", "first")
    return docs.join(texts, docs["text"].eqNullSafe(texts["text"])).select("doc_id", "first").join(coded, "first").select("doc_id", "ids")
