"""Operator 5: benchmark decontamination by greedy string tiling.

Items are joined to documents by shared seeds (SEED words in a row). For each such pair, tiles are taken greedily:
the longest run of words that both share and no tile covers yet, again and again down to SEED words; the length is
found by running Karp-Rabin, hashing all free windows of one length at a time. Tiles may lie in any order, so
passages whose parts were moved are found. A document leaks an item if its tiles cover COVERAGE of the item's words.

The join never shuffles documents: each task scans its texts against a block of items whose seeds are at most
BLOCK_SEEDS (a checked bound); more items are further passes. Pairs are looked into one by one, so a passage in very
many documents costs each document the same.

Long texts are scanned in pieces that share SEED - 1 words, and of a text only the words of shared seeds are held.

Defined results: null and empty texts and items match nothing, nor do items of fewer than SEED words; words are runs
of digits, ASCII letters (in lower case) and characters beyond ASCII; rows that repeat an id, and rows or items without
one, are compared each (a null id is given back as null); an empty table on either side gives an empty result; extra
columns are ignored by contaminated() and kept by decontaminated(), which judges each row by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import BLOCK_BYTES, blocks, prepare, text_column

SEED = 5
COVERAGE = 0.5
#: Seeds of the items of one pass; they and their words are broadcast (about 40 bytes a seed).
BLOCK_SEEDS = 500_000


def _windows(codes: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows of n words that no tile touches."""
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = scan.powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[n:] == taken[:-n])
    return at, (sums[at + n] - sums[at]) * down[at]


def greedy_tiles(item: np.ndarray, text: np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, words), longest first, none shorter than `shortest`, none overlapping."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        a, ha = _windows(item, free_i, n)
        b, hb = _windows(text, free_t, n)
        keep_a, keep_b = np.isin(ha, hb), np.isin(hb, ha)
        return (a[keep_a], ha[keep_a], b[keep_b], hb[keep_b]) if keep_a.any() else None

    longest = min(len(item), len(text))
    while longest >= shortest:
        lo, hi, got = shortest, longest, common(shortest)
        if got is None:
            break
        best = got
        while lo < hi:  # a shared free run of n words holds one of n - 1, so the greatest n can be bisected
            mid = (lo + hi + 1) // 2
            got = common(mid)
            if got is None:
                hi = mid - 1
            else:
                lo, best = mid, got
        a, ha, b, hb = best
        places: dict[int, list[int]] = {}
        for j, h in zip(b.tolist(), hb.tolist(), strict=True):
            places.setdefault(h, []).append(j)
        done = False
        for i, h in zip(a.tolist(), ha.tolist(), strict=True):
            if not free_i[i : i + lo].all():
                continue
            for j in places.get(h, ()):
                if free_t[j : j + lo].all() and np.array_equal(item[i : i + lo], text[j : j + lo]):
                    free_i[i : i + lo] = free_t[j : j + lo] = False
                    tiles.append((i, j, lo))
                    done = True
                    break
        longest = lo if done else lo - 1
    return tiles


class Items:
    """A block of items: their words' hashes and which item and place each seed stands at."""

    def __init__(self, ids: list[int | None], texts: list[str], seed: int):
        words = scan.of_texts(texts)
        self.ids = ids
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        at, h = words.grams(seed)
        order = np.argsort(h, kind="stable")
        self.row, self.place, h = words.row[at][order], (at - words.first[words.row[at]])[order], h[order]
        self.seeds = scan.HashSet(h)
        self.begin = np.searchsorted(h, self.seeds.members, side="left")
        self.many = np.searchsorted(h, self.seeds.members, side="right") - self.begin


def _seeds(items: Items, data: np.ndarray, offsets: np.ndarray, seed: int, limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, number of the first word, hashes of the words, and which seed, of each place with a seed of an item."""
    for lo, hi in blocks(offsets, limit):
        own = data[offsets[lo] : offsets[hi]]
        if len(own) > 2 * limit:
            parts = scan.pieces(own, limit, seed - 1)
        else:
            parts = [(0, None, scan.Words(own, offsets[lo : hi + 1] - offsets[lo]))]
        for base, _, words in parts:
            at, h = words.grams(seed)
            hit, member = items.seeds.find(h)
            if len(hit):
                at = at[hit]
                row = words.row[at]
                yield row + lo, at - words.first[row] + base, words.hash[at[:, None] + np.arange(seed)], member


def _leaks(items: Items, data: np.ndarray, offsets: np.ndarray, seed: int, coverage: float, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, words of the item, words in tiles, tiles) for each pair of a text and an item that leaks."""
    found = list(_seeds(items, data, offsets, seed, limit))
    if not found:
        return
    row, first, hashes, member = (np.concatenate(c) for c in zip(*found, strict=True))
    many = items.many[member]
    which = np.repeat(np.arange(len(row)), many)
    k = items.begin[member][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    order = np.lexsort((first[which], items.row[k], row[which]))
    which, k = which[order], k[order]
    text, item, start = row[which], items.row[k], items.place[k]
    cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(cut, np.append(cut[1:], len(text)), strict=True):
        r, i = int(text[a]), int(item[a])
        own = items.words[i]
        touched = np.zeros(len(own) + 1, dtype=np.int64)
        np.add.at(touched, start[a:b], 1)
        np.add.at(touched, np.minimum(start[a:b] + seed, len(own)), -1)
        if np.count_nonzero(np.cumsum(touched)[:-1]) < coverage * len(own):
            continue  # tiles lie within what the seeds cover
        # Only words within a shared seed can be in a tile: the rest of the text is cut down to separators.
        w = which[a:b]
        spots, one = np.unique((first[w][:, None] + np.arange(seed)).ravel(), return_index=True)
        gaps = np.flatnonzero(np.diff(spots) > 1) + 1
        words = np.insert(hashes[w].ravel()[one], gaps, np.arange(len(gaps), dtype=np.uint64) * np.uint64(2))
        tiles = greedy_tiles(own, words, seed)
        covered = sum(n for _, _, n in tiles)
        if covered >= coverage * len(own):
            yield r, i, len(own), covered, len(tiles)


def _passes(benchmark: DataFrame, block_seeds: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """The items in blocks of at most about block_seeds words; one partition of items comes to the driver at a time."""
    ids, texts, held = [], [], 0
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for r in items.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        held += len(r[1]) // 2 + 1
        if held >= block_seeds:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """doc_id, item_id, item_words, tile_words, tiles, coverage: one row for each pair that leaks."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, item_words int, tile_words int, tiles int"

    def one_pass(block: tuple[list[int | None], list[str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, seed)
            for b in batches:
                found = list(_leaks(items, *text_column(b, "text"), seed, coverage))
                if found:
                    row, item, *numbers = zip(*found, strict=True)
                    ids = pa.array([items.ids[i] for i in item], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), ids, *(pa.array(x, pa.int32()) for x in numbers)], ["doc_id", "item_id", "item_words", "tile_words", "tiles"])

        return rows.mapInArrow(run, schema)

    found = [one_pass(block) for block in _passes(benchmark, block_seeds)]
    result = found[0] if found else rows.limit(0).mapInArrow(lambda batches: iter(()), schema)
    for more in found[1:]:
        result = result.unionByName(more)
    return result.withColumn("coverage", F.col("tile_words") / F.col("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """The rows of docs that leak no item; columns stay as they are. Each row is judged by its own text, and none is moved."""
    spark = prepare(docs.sparkSession)

    def one_pass(rows: DataFrame, block: tuple[list[int | None], list[str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, seed)
            for b in batches:
                clean = np.ones(len(b), dtype=bool)
                clean[[r for r, *_ in _leaks(items, *text_column(b, text), seed, coverage)]] = False
                yield b.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    text = "_lr_text"
    kept = docs.withColumn(text, F.col("text").cast("string"))
    for block in _passes(benchmark, block_seeds):
        kept = one_pass(kept, block)  # passes are pipelined: documents are read once
    return kept.drop(text)
