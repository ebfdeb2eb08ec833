"""Operator 9: SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints: text in lower case (A-Z only), words that white space parts, shingles of some words (three in the
query), XXH64 of each shingle; a bit is set if it is set in over half of the hashes. Only distinct fingerprints are
compared: a group of equal texts is one fingerprint, with its smallest doc_id, from the first aggregation on.

Index: two fingerprints that differ in three bits at most agree in one of four 16-bit blocks, so each fingerprint is
sent to four buckets. A bucket of more than TILE fingerprints is split in the same way by the bits that it leaves
open: what differs in three bits at most agrees in one of four parts of them, and so on until no bucket is larger (as
fingerprints are distinct, k open bits hold 2^k at most, so this ends). Nothing is capped, and no task compares more
than a bucket at a time. Within a bucket the codes are sorted by Gray rank, where neighbours share most bits; runs of
codes form a node that keeps the bits they all share (mask and pattern), runs of nodes form upper nodes. Pairs of
nodes are compared from the top: the shared bits that differ are a lower bound for all pairs below, and beyond three
the whole group of pairs is dropped. Tasks give back a spanning forest of what they found, never the pairs.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked like any other;
rows that repeat a doc_id keep a fingerprint each; a null doc_id never names a component: its row gets the smallest
doc_id that it reaches, and null if there is none; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import components, first_of_each, materialise, prepare, scratch, text_column, text_hash

SHINGLE = 3
SEED = 42
DIFFER = 3
#: Fingerprints of a bucket that is not split further.
TILE = 8192
#: Fingerprints that a task compares in one go: whole buckets, as many as fit.
GATHER = 1 << 16
_FAN = 16
_FULL = (1 << 64) - 1


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def majorities(many: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """majority() of each of several texts with so many hashes; 0 for one without."""
    out = np.zeros(len(many), dtype=np.uint64)
    if len(many) == 1:
        out[0] = majority(hashes)
        return out
    some = np.flatnonzero(many)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, (np.cumsum(many) - many)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(counts * 2 > many[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, from its UTF-8 bytes."""
    return majority(shingles.of_text(text, words, seed))


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.zeros(len(b), dtype=np.uint64)
            for lo, many, hashes in shingles.of_batch(*text_column(b, "text"), words, seed):
                fp[lo : lo + len(many)] = majorities(many, hashes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, text_hash long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """A tree over groups of codes: leaves are codes, a node covers up to 16 neighbours in the Gray order of a group.

    mask[l], pattern[l]: the bits that all codes below a node share, and their values. Level 0 are the codes.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.order, self.codes = order, codes[order]
        group = group[order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.mask, self.pattern, self.first, self.count = [np.full(len(codes), full)], [self.codes], [None], [None]
        owner = group
        while len(owner) and (owner[1:] == owner[:-1]).any():
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
            start = np.flatnonzero(rank % _FAN == 0)
            ones = np.bitwise_and.reduceat(self.mask[-1] & self.pattern[-1], start)
            zeros = np.bitwise_and.reduceat(self.mask[-1] & ~self.pattern[-1], start)
            self.mask.append(ones | zeros)
            self.pattern.append(ones)
            self.first.append(start)
            self.count.append(np.diff(np.append(start, len(owner))))
            owner = owner[start]

    def pairs(self, differ: int, chunk: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (into the codes as given) of all pairs of a group that differ in at most so many bits, in batches."""
        top = len(self.mask) - 1
        if top < 1:
            return
        every = np.arange(len(self.mask[top]))
        work = [(top, every[i : i + chunk], every[i : i + chunk]) for i in range(0, len(every), chunk)]
        while work:
            level, a, b = work.pop()
            na, nb = self.count[level][a], self.count[level][b]
            total = na * nb
            at = np.repeat(np.arange(len(a)), total)
            k = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
            i, j = self.first[level][a][at] + k // nb[at], self.first[level][b][at] + k % nb[at]
            level -= 1
            keep = i < j if level == 0 else i <= j
            i, j = i[keep], j[keep]
            mask, pattern = self.mask[level], self.pattern[level]
            near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= differ
            i, j = i[near], j[near]
            if level == 0:
                if len(i):
                    yield self.order[i], self.order[j]
            else:
                work.extend((level, i[s : s + chunk], j[s : s + chunk]) for s in range(0, len(i), chunk))


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the parts of a and b in the forest root, in place."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _compare(differ: int):
    """Buckets are neighbours; whole buckets are gathered up to GATHER codes, and a forest of their links goes out."""

    def settle(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        code = fp.view(np.uint64)
        group = np.cumsum(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
        ids, node = np.unique(code, return_inverse=True)
        root = np.arange(len(ids))
        for i, j in GrayIndex(code, group).pairs(differ):
            _hook(root, node[i], node[j])
        out = np.flatnonzero(root != np.arange(len(ids)))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(ids[out].view(np.int64)), pa.array(ids[root[out]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for b in batches:
            if not len(b):
                continue
            held.append([b.column(c).to_numpy() for c in ("mask", "value", "fp")])
            n += len(b)
            if n >= GATHER:
                mask, value, fp = (np.concatenate(c) for c in zip(*held, strict=True))
                edge = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
                cut = int(edge[-1]) + 1 if len(edge) else 0
                if cut:
                    yield from settle(mask[:cut], value[:cut], fp[:cut])
                held, n = [[mask[cut:], value[cut:], fp[cut:]]], len(fp) - cut
        if n:
            yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _parts_of(mask: int, parts: int) -> list[int]:
    """The bits of mask in so many runs of about equal length."""
    bits = [b for b in range(64) if mask >> b & 1]
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(distinct: DataFrame, differ: int, tile: int) -> DataFrame:
    """(mask, value, fp): every bucket that a fingerprint is in; near ones share a bucket, and none has more than tile."""
    spark = distinct.sparkSession
    masks, n = _parts_of(_FULL, differ + 1), distinct.count()
    deeper = lambda found: list(dict.fromkeys(m | p for m in found for p in _parts_of(_FULL & ~m, differ + 1)))
    # Where even an equal spread overfills the buckets, the next finer split is taken at once.
    while n >> masks[0].bit_count() > tile // 4 and masks[0].bit_count() < 48:
        masks = deeper(masks)
    keyed = F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")
    now = distinct.select("fp", keyed).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    done = None
    while True:
        large = materialise(now.groupBy("mask", "value").count().where(F.col("count") > tile).select("mask", "value"), "large")
        if not large.take(1):
            return now if done is None else done.unionByName(now)
        small = now.join(large, ["mask", "value"], "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = [r[0] & _FULL for r in large.select("mask").distinct().collect()]  # at most 4^level masks
        finer = [(_signed(m), _signed(f)) for m in open_ for f in deeper([m])]
        split = F.broadcast(spark.createDataFrame(finer, "mask long, finer long"))
        wide = now.join(large, ["mask", "value"], "left_semi").join(split, "mask")
        now = materialise(wide.select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("value"), "fp").distinct(), "finer")


def links(distinct: DataFrame, differ: int = DIFFER, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between fingerprints of `distinct` (fp) that span exactly what differs in `differ` bits or fewer."""
    dealt = _buckets(distinct, differ, tile).repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(_compare(differ), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, differ: int = DIFFER, tile: int = TILE) -> DataFrame:
    """doc_id, text_hash, fp, component_id (the smallest doc_id that links of fingerprints reach) and class (its least fp)."""
    with scratch(prepare(docs.sparkSession)) as kept:
        fps = materialise(fingerprints(docs, words), "fingerprints")
        classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
        joined = components(links(classes, differ, tile))
        rooted = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("class"))
        rooted = materialise(rooted, "rooted")
        least = materialise(rooted.groupBy("class").agg(F.min("rep").alias("component_id")), "least")
        table = materialise(rooted.join(least, "class").select("fp", "component_id", "class"), "members")
        kept += [fps, table]
    return fps.join(table, "fp").select("doc_id", "text_hash", "fp", "component_id", "class")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, words: int = SHINGLE, differ: int = DIFFER) -> DataFrame:
    """The first row of docs of each group; columns stay as they are."""
    return first_of_each(docs, near_duplicates(docs, words, differ))
