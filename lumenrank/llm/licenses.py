"""Operator 4: licence scans by an exact set-similarity join of text blocks with licence templates.

Blocks are windows of BLOCK words that start every BLOCK / 2 words, so every passage of up to half a block lies in
one. A template is found in a block if the block holds at least THRESHOLD of the template's distinct words. The join
is exact: template words are ordered by their frequency in the whole corpus, rarest first; a block that reaches the
threshold must hold one of the first |T| - ceil(THRESHOLD |T|) + 1 of them. An index from these prefix words to their
templates gives the candidates, so a block meets only templates that it shares a rare word with. A candidate block must
have enough words, distinct ones too (length filter), and from a first shared word at place i at most |T| - i words can
still be shared (positional filter). What passes is counted out.

A block gives the label of each template found in it. Where a template's words are a part of those of other templates
found there as well, it counts only if the block holds its words once more than these need them. Beside this, base
labels are given where a phrase's words stand consecutively.

Frequencies are counted over all documents, for the words of templates only (a few hundred, fixed by the templates),
so what is broadcast does not grow with the corpus. Nothing is shuffled but these counts. Long texts are taken in
pieces that share a block.

Defined results: null and empty texts have no words, labels or places; rows that repeat a doc_id, and rows without one,
are scanned each; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import BLOCK_BYTES, blocks, prepare, text_column

BLOCK = 160
THRESHOLD = 0.9

# Phrases that give base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known licence notices, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
    ("all-rights-reserved", "Copyright all rights reserved"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("gpl", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details"),
]


@dataclass
class Join:
    """The templates as sets of word numbers in frequency order, ready to be joined."""

    hashes: np.ndarray  # of the templates' words
    labels: list[str]
    order: list[list[int]]  # word numbers of each template, rarest first
    need: list[int]  # how many of them a block must hold
    within: list[set[int]]  # templates whose words have all of this one's, and others
    prefix: dict[int, list[int]]  # templates by the words of their prefixes

    @classmethod
    def of(cls, templates: list[tuple[str, str]], threshold: float, frequency: dict[int, int]) -> Join:
        hashes = np.unique(scan.of_texts([t for _, t in templates]).hash)
        order, need = [], []
        for _, text in templates:
            own = np.unique(np.searchsorted(hashes, scan.of_texts([text]).hash))
            order.append(sorted(own.tolist(), key=lambda w: (frequency.get(int(hashes[w].view(np.int64)), 0), w)))
            need.append(math.ceil(threshold * len(own) - 1e-9))
        prefix: dict[int, list[int]] = {}
        holders: dict[int, set[int]] = {}
        for t, (own, n) in enumerate(zip(order, need, strict=True)):
            for w in own[: len(own) - n + 1]:
                prefix.setdefault(w, []).append(t)
            for w in own:
                holders.setdefault(w, set()).add(t)
        within = [{u for u in set.intersection(*(holders[w] for w in own)) if len(order[u]) > len(own)} if own else set() for own in order]
        return cls(hashes, [label for label, _ in templates], order, need, within, prefix)


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """How often each word of the templates stands in the corpus, by its hash: a few hundred numbers at most."""
    wanted = scan.HashSet(scan.of_texts([t for _, t in templates]).hash)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.members), dtype=np.int64)
        for b in batches:
            data, offsets = text_column(b, "text")
            for lo, hi in blocks(offsets):
                words = scan.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total += np.bincount(wanted.find(words.hash)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(wanted.members.view(np.int64)), pa.array(total)], ["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, n long")
    return {r[0]: r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()}


def _found(join: Join, known: scan.HashSet, words: scan.Words, block: int, base: int = 0, upto: int | None = None) -> list[tuple[int, int, int, float]]:
    """(row, first word of the block, template, containment) of each block and template that meet the threshold.

    Of a piece of a long text, whose first word has the number base, the blocks that begin before upto.
    """
    at, member = known.find(words.hash)
    if not len(at):
        return []
    step = block // 2
    key = words.row[at].astype(np.int64)
    within = at - words.first[key] + base
    rare = np.zeros(len(join.hashes), dtype=bool)
    rare[list(join.prefix)] = True
    candidates: dict[tuple[int, int], set[int]] = {}
    for i in np.flatnonzero(rare[member]).tolist():
        r, last = int(key[i]), int(within[i]) // step
        for k in (last, last - 1) if last else (last,):
            if k * step < base or (upto is not None and k * step >= upto):
                continue
            candidates.setdefault((r, k), set()).update(join.prefix[int(member[i])])
    out = []
    for (r, k), asked in sorted(candidates.items()):
        a, b = np.searchsorted(key, [r, r + 1])
        lo, hi = k * step, k * step + block
        a, b = a + np.searchsorted(within[a:b], lo), a + np.searchsorted(within[a:b], hi)
        held, times = np.unique(member[a:b], return_counts=True)
        often = dict(zip(held.tolist(), times.tolist(), strict=True))
        length = min(hi, int(words.first[r + 1] - words.first[r]) + base) - lo
        here: dict[int, float] = {}
        for t in sorted(asked):
            order, need = join.order[t], join.need[t]
            if length < need or len(often) < need:
                continue  # length filter
            first = next((i for i, w in enumerate(order[: len(order) - need + 1]) if w in often), None)
            if first is None or len(order) - first < need:
                continue  # prefix and positional filter
            shared, left = 0, len(order) - first
            for w in order[first:]:
                shared += w in often
                left -= 1
                if shared + left < need:
                    break
            if shared >= need:
                here[t] = shared / len(order)
        for t, share in here.items():
            larger = len(join.within[t] & here.keys())
            if not larger or min(often[w] for w in join.order[t] if w in often) > larger:
                out.append((r, lo, t, share))
    return out


def _places(words: scan.Words, phrases: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase of each place where a phrase's words stand in a row, in order."""
    at, which = [], []
    for p, phrase in enumerate(phrases):
        own = scan.of_texts([phrase])
        n = len(own.hash)
        ends = np.flatnonzero(words.hash == own.hash[-1])
        ends = ends[ends >= n - 1]
        for k in range(n - 1):
            ends = ends[words.hash[ends - (n - 1) + k] == own.hash[k]]
        start = ends - (n - 1)
        start = start[words.row[start] == words.row[ends[: len(start)]]] if len(start) else start
        # An equal hash is looked into: the bytes of the words have to be equal as well.
        text = [own.data[a:b].tobytes() for a, b in zip(own.start, own.end, strict=True)]
        start = np.array([s for s in start.tolist() if all(words.data[words.start[s + k] : words.end[s + k]].tobytes() == text[k] for k in range(n))], dtype=np.int64)
        at.append(start)
        which.append(np.full(len(start), p))
    at, which = np.concatenate(at), np.concatenate(which)
    order = np.argsort(at, kind="stable")
    return at[order], which[order]


def _scanned(data: np.ndarray, offsets: np.ndarray, share: int, limit: int) -> Iterator[tuple[int, scan.Words, int, int | None]]:
    """The first row, the words, the number of the first one, and where the next piece of a long text begins (else null)."""
    for lo, hi in blocks(offsets, limit):
        own = data[offsets[lo] : offsets[hi]]
        if len(own) > 2 * limit:
            for base, upto, words in scan.pieces(own, limit, share):
                yield lo, words, base, upto
        else:
            yield lo, scan.Words(own, offsets[lo : hi + 1] - offsets[lo]), 0, None


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, block: int = BLOCK, limit: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks (found), first_block (its first word)."""
    prepare(docs.sparkSession)
    join = Join.of(templates, threshold, word_frequencies(docs, templates))
    names = list(phrases.values())
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64()), ("first_block", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scan.HashSet(join.hashes)
        for b in batches:
            data, offsets = text_column(b, "text")
            n = len(b)
            n_words, n_base, n_blocks, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last, block_at = [None] * n, [None] * n, [None] * n
            base: list[set[str]] = [set() for _ in range(n)]
            more: list[set[str]] = [set() for _ in range(n)]
            for lo, words, start_at, upto in _scanned(data, offsets, block, limit):
                hi = lo + len(words.first) - 1
                n_words[lo:hi] = np.diff(words.first) + start_at
                at, which = _places(words, phrases)
                for p, w in zip(at.tolist(), which.tolist(), strict=True):
                    r = int(words.row[p])
                    place = p - int(words.first[r]) + start_at
                    if upto is not None and place >= upto:
                        continue
                    n_base[lo + r] += 1
                    first[lo + r] = place if first[lo + r] is None else first[lo + r]
                    last[lo + r] = place
                    base[lo + r].add(names[w])
                    score[lo + r] = 1.0
                for r, start, t, share in _found(join, known, words, block, start_at, upto):
                    n_blocks[lo + r] += 1
                    block_at[lo + r] = start if block_at[lo + r] is None else min(start, block_at[lo + r])
                    more[lo + r].add(join.labels[t])
                    score[lo + r] = max(score[lo + r], share)
            listed = lambda sets: [",".join(sorted(s)) for s in sets]
            cols = [b.column(0), n_words, n_base, first, last, listed(base), listed(x | y for x, y in zip(base, more, strict=True)), score, n_blocks, block_at]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], [f for f, _ in fields])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{f} {kinds[k]}" for f, k in fields))
