"""Operator 2: repeated passages by longest-previous-factor arrays, keeping the first copy.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. That is: the
longest previous factor at the string's start, counted over smaller documents, reaches LENGTH. In the order of suffixes
it is read off the previous and the next suffix of a smaller document, of which the common prefix is the longest: it
reaches LENGTH for every suffix of a run of neighbours that share LENGTH bytes, but for those of the smallest document.

Most suffixes repeat nothing, or stand in a repeat of many bytes. So they are sorted sparsely:

1. Equal texts are one: of each group only the smallest doc_id goes on.
2. A string's anchor is the GRAM of least hash in it (the leftmost): equal strings have equal anchors at equal places.
   So strings fall into runs that share an anchor. A run has two names of 64 bits: its anchor's (h), and that of all
   bytes it spans (f). Sorted by (h, f, doc), a run that follows one of a smaller document with both names is repeated
   as a whole. A run whose anchor occurs with other spans may be repeated in part, and is looked into; all others, by
   far the most, are unique.
3. The runs to be looked into send the bytes that they span. Those of one anchor meet, and all their suffixes are put
   in the order of their bytes, then of their documents; neighbours that agree in LENGTH bytes are compared by
   document as above. Nothing rests on hashes here.

Tasks resolve what they can before they send anything: each sends a span, an anchor with several spans, and a run that
has a string not met before once, with its smallest document, so a passage in a third of all documents is one entry
for each task. Entries travel as packed arrays, a row for each task and bucket; a task that receives them holds one
bucket at a time.

Defined results: a null text is empty; texts under LENGTH bytes keep all; rows that repeat a doc_id never remove each
other's bytes, as neither is smaller; a null doc_id is larger than all others, nulls among themselves go by a hash of
their text (so equal texts without an id are rows that repeat one); an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import place
from . import scan
from .common import blocks, drop_shared, materialise, prepare, scratch, text_column

LENGTH = 50
GRAM = 28
#: Bytes of text that a task gathers before it resolves and sends.
CHUNK = 8 << 20
#: Bytes of text for each bucket of entries.
BUCKET = 4 << 20
_SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
#: The most buckets that get a partition each; beyond that a partition has several, one after the other.
PARTITIONS = 1 << 16


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _names(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which the name of any run of bytes is found."""
    up, _ = scan.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return sums


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: row, first start (in data), number of strings, name of anchor and of span."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    _, down = scan.powers(len(data) + 1)
    sums = _names(data, scan._VALUES)
    n = len(data) - gram + 1
    grams = _mixed((sums[gram:] - sums[:n]) * down[:n])
    least = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least & _PLACE).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1
    start = np.flatnonzero(np.arange(len(place)) + length <= offsets[row + 1])
    if not len(start):
        return none
    fresh = np.flatnonzero(np.concatenate([[True], (place[start[1:]] != place[start[:-1]]) | (np.diff(start) != 1)]))
    first = start[fresh]
    count = np.diff(np.append(fresh, len(start)))
    anchor = place[first]
    end = first + count - 1 + length
    span = _mixed((sums[end] - sums[first]) * down[first] + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    return row[first], first, count, grams[anchor], span


def earlier(names: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """With the names of each suffix, first to last, in suffix order and by document within equal ones: has a suffix a
    previous (or next) one of the same names whose document is smaller?

    By document the previous smaller one exists unless the document is the first of its names; no next one is smaller.
    """
    order = np.lexsort((doc, *names[::-1]))
    d = doc[order]
    fresh = np.zeros(len(d), dtype=bool)
    fresh[:1] = True
    for n in names:
        n = n[order]
        fresh[1:] |= n[1:] != n[:-1]
    head = np.flatnonzero(fresh)
    out = np.empty(len(d), dtype=bool)
    out[order] = d > np.repeat(d[head], np.diff(np.append(head, len(d))))
    return out


def _repeated_anchor(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Which entries have an anchor that occurs with several spans."""
    order = np.lexsort((f, h))
    hs, fs = h[order], f[order]
    head = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.zeros(0, np.int64)
    many = np.repeat(np.diff(np.append(head, len(hs))), np.diff(np.append(head, len(hs))))
    out = np.zeros(len(h), dtype=bool)
    if len(hs):
        last = np.append(head[1:], len(hs)) - 1
        several = fs[head] != fs[last]
        out[order] = np.repeat(several, np.diff(np.append(head, len(hs)))) & (many > 1)
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length as bytes: fingerprints (unsigned) raw, all others as compressed differences."""
    raw = b"".join(c.tobytes() for c in columns if c.dtype.kind == "u")
    rest = b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in columns if c.dtype.kind != "u")
    return len(columns[0]).to_bytes(4, "little") + raw + zstandard.ZstdCompressor(level=1).compress(rest)


def _unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    at, out, later = 4, [], []
    for k in kinds:
        if np.dtype(k).kind == "u":
            out.append(np.frombuffer(blob, dtype=k, count=n, offset=at))
            at += np.dtype(k).itemsize * n
        else:
            out.append(None)
            later.append(len(out) - 1)
    rest, at = zstandard.ZstdDecompressor().decompress(blob[at:]), 0
    for i in later:
        out[i] = np.cumsum(np.frombuffer(rest, dtype=kinds[i], count=n, offset=at), dtype=kinds[i])
        at += n * np.dtype(kinds[i]).itemsize
    return out


#: Entries that are packed: of step 2, of step 3 (besides its bytes), results (doc, first start, strings), and those to be looked into.
_RUN = [np.uint64, np.uint64, np.int64, np.int64, np.int32]
_CONTEXT = [np.int64, np.int64, np.int32]
_HIT = [np.int64, np.int64, np.int32]
_OPEN = [np.uint64, np.int64, np.int64, np.int32]
#: Rows that share a doc_id but not the text have a tag from this bit on in their starts; all others have tag 0.
TAG = 38
#: Rows without a doc_id take ids from three times this on.
_NULLS = 1 << 61
_LAST = (1 << 63) - 1
#: Kinds of rows: entries, repeated strings, strings to be looked into.
ENTRY, REPEATED, OPEN = 0, 1, 2


def _by_bucket(kind: int, key: np.ndarray, buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    if not len(key):
        return
    bucket = (_mixed(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    columns = [c[order] for c in columns]
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), kind, _pack(*(c[a:b] for c in columns))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["bucket", "kind", "body"])


PACKED = "bucket int, kind int, body binary"


def _segments(data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Blocks of rows (first, last, bytes, offsets, 0), and of a long row pieces that overlap, with their first byte."""
    for lo, hi in blocks(offsets, _SEGMENT):
        if offsets[hi] - offsets[lo] <= 2 * _SEGMENT:
            yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 0
        else:
            for at in range(0, int(offsets[hi] - offsets[lo]), _SEGMENT):
                piece = data[offsets[lo] + at : min(offsets[lo] + at + _SEGMENT + overlap, offsets[hi])]
                yield lo, hi, piece, np.array([0, len(piece)]), at


def _find_runs(buckets: int, length: int, gram: int):
    def resolve(got: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
        doc, start, count, h, f = (np.concatenate(c) for c in zip(*got, strict=True))
        # Only anchors that occur twice here need a closer look.
        order = np.argsort(h, kind="stable")
        same = np.concatenate([[False], h[order][1:] == h[order][:-1], [False]])
        again = np.zeros(len(h), dtype=bool)
        again[order] = same[:-1] | same[1:]
        w = np.flatnonzero(again)
        gone = earlier([h[w], f[w]], doc[w])
        r, w = w[gone], w[~gone]
        yield from _by_bucket(REPEATED, doc[r], buckets, [doc[r], start[r], count[r].astype(np.int32)])
        several = _repeated_anchor(h[w], f[w])
        o = w[several]
        yield from _by_bucket(OPEN, doc[o], buckets, [h[o], doc[o], start[o], count[o].astype(np.int32)])
        marks = np.unique(h[w[several]])
        send = np.ones(len(h), dtype=bool)
        send[np.flatnonzero(again)] = False
        send[w[~several]] = True
        s = np.flatnonzero(send)
        columns = [np.concatenate([h[s], marks]), np.concatenate([f[s], np.zeros(len(marks), np.uint64)])]
        # A mark has no place (start -1) and comes after all documents, so that nothing is removed for it.
        columns += [np.concatenate([doc[s], np.full(len(marks), _LAST)]), np.concatenate([start[s], np.full(len(marks), -1)])]
        columns += [np.concatenate([count[s], np.zeros(len(marks), np.int64)]).astype(np.int32)]
        yield from _by_bucket(ENTRY, columns[0], buckets, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for b in batches:
            data, offsets = text_column(b, "text")
            docs = b.column(0).to_numpy(zero_copy_only=False)
            tags = b.column("tag").to_numpy(zero_copy_only=False) << TAG
            for lo, hi, part, own, base in _segments(data, offsets, length - 1):
                row, first, count, h, f = runs(part, own, length, gram)
                got.append((docs[lo:hi][row], first - own[row] + base + tags[lo:hi][row], count, h, f))
                held += len(part)
                if held >= CHUNK:
                    yield _batch(list(resolve(got)) or [(0, ENTRY, _pack(*(np.zeros(0, k) for k in _RUN)))])
                    got, held = [], 0
        if got:
            rows = list(resolve(got))
            if rows:
                yield _batch(rows)

    return run


def _spread(kind: int, doc: np.ndarray, start: np.ndarray, count: np.ndarray, h: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    h = np.zeros(len(doc), np.int64) if h is None else h.view(np.int64)
    for at in range(0, len(doc), 50_000):
        s = slice(at, at + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc[s]), kind, np.int32)), pa.array(doc[s]), pa.array(start[s]), pa.array(count[s].astype(np.int32)), pa.array(h[s])], ["kind", "doc", "start", "n", "h"])


HITS = "kind int, doc long, start long, n int, h long"


def _by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """The rows (kind, body) of one bucket after the other; rows of a bucket are neighbours."""
    held, now = [], None
    for b in batches:
        for bucket, kind, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append((kind, body))
    if held:
        yield held


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, bucket by bucket."""
    for rows in _by_one(batches):
        entries: list[list[np.ndarray]] = []
        for kind, body in rows:
            if kind == ENTRY:
                entries.append(_unpack(body, _RUN))
            elif kind == REPEATED:
                yield from _spread(REPEATED, *_unpack(body, _HIT))
            else:
                h, doc, start, count = _unpack(body, _OPEN)
                yield from _spread(OPEN, doc, start, count, h)
        if not entries:
            continue
        h = np.concatenate([e[0] for e in entries])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        w = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(h) else order
        h = h[w]
        f, doc, start, count = (np.concatenate([e[k] for e in entries])[w] for k in range(1, 5))
        gone = earlier([h, f], doc) & (start >= 0)
        yield from _spread(REPEATED, doc[gone], start[gone], count[gone])
        keep = ~gone
        several = np.zeros(len(h), dtype=bool)
        several[keep] = _repeated_anchor(h[keep], f[keep])
        several &= start >= 0
        yield from _spread(OPEN, doc[several], start[several], count[several], h[several])


def _own(runs_: pa.ListScalar, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and counts of the runs of the text with this tag, and their places in the list."""
    start, count = runs_.values.field("start").to_numpy(), runs_.values.field("n").to_numpy().astype(np.int64)
    keep = np.flatnonzero(start >> TAG == tag)
    return start[keep] - (tag << TAG), count[keep], keep


def repeated_suffixes(context: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which suffixes have a previous factor of this length in a smaller document: the context's row, the suffix's start, the answer.

    context: rows of bytes, of which the first count suffixes are asked; they are sorted by their bytes, then by doc.
    """
    width = context.shape[1]
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    raw = np.concatenate([context.ravel(), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    at = row * width + start
    parts = [eight[at + k].astype(np.uint64) for k in range(0, length - 7, 8)]
    if length % 8:
        parts.append(eight[at + length - length % 8].astype(np.uint64) >> np.uint64(64 - 8 * (length % 8)))
    return row, start, earlier(parts, doc[row])


def _merged(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of documents as runs of strings that follow each other."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(doc))[: len(head)] - 1
    return doc[head], start[head], (start[last] - start[head] + 1).astype(np.int32)


def _send_contexts(buckets: int, length: int, gram: int):
    """Step 3, sender: the bytes of all runs to be looked into."""
    width = 2 * length - gram

    def resolve(got: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
        context, doc, start, count, h = (np.concatenate(c) for c in zip(*got, strict=True))
        row, at, gone = repeated_suffixes(context, count, doc, length)
        d, s, n = _merged(doc[row[gone]], start[row[gone]] + at[gone])
        yield from _by_bucket(REPEATED, d, buckets, [d, s, n])
        fresh = np.zeros(len(doc), dtype=bool)
        fresh[row[~gone]] = True
        w = np.flatnonzero(fresh)
        bucket = (_mixed(h[w]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        w, bucket = w[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0])) if len(w) else np.zeros(0, np.int64)
        pack = zstandard.ZstdCompressor(level=1)
        for a, b in zip(cut, np.append(cut[1:], len(w)), strict=True):
            x = w[a:b]
            body = _pack(doc[x], start[x], count[x].astype(np.int32))
            yield int(bucket[a]), ENTRY, len(body).to_bytes(4, "little") + body + pack.compress(context[x].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            data, offsets = text_column(batch, "text")
            docs, tags, opens = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("open")
            for r, doc in enumerate(docs):
                text = data[offsets[r] : offsets[r + 1]]
                first, count, place = _own(opens[r], tags[r])
                first, one = np.unique(first, return_index=True)
                count, h = count[one], opens[r].values.field("h").to_numpy()[place[one]].view(np.uint64)
                at = first[:, None] + np.arange(width)
                inside = at < (first + count - 1 + length)[:, None]
                context = np.where(inside, text[np.minimum(at, len(text) - 1)], np.uint8(0))
                got.append((context, np.full(len(first), doc), first + (tags[r] << TAG), count, h))
                held += int(count.sum())
                if held >= 500_000:
                    rows = list(resolve(got))
                    if rows:
                        yield _batch(rows)
                    got, held = [], 0
        if held:
            rows = list(resolve(got))
            if rows:
                yield _batch(rows)

    return run


def _join_contexts(length: int, gram: int):
    """Step 3, receiver, bucket by bucket: suffixes that share their first bytes with one of a smaller document."""
    width = 2 * length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for rows in _by_one(batches):
            entries: list[tuple[np.ndarray, ...]] = []
            for kind, body in rows:
                if kind == ENTRY:
                    n = int.from_bytes(body[:4], "little")
                    doc, start, count = _unpack(body[4 : 4 + n], _CONTEXT)
                    entries.append((doc, start, count.astype(np.int64), np.frombuffer(plain.decompress(body[4 + n :]), np.uint8).reshape(-1, width)))
                else:
                    yield from _spread(REPEATED, *_unpack(body, _HIT))
            if not entries:
                continue
            doc, start, count, context = (np.concatenate(c) for c in zip(*entries, strict=True))
            row, at, gone = repeated_suffixes(context, count, doc, length)
            yield from _spread(REPEATED, *_merged(doc[row[gone]], start[row[gone]] + at[gone]))

    return run


_CUT = "doc long, key2 string, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: bigint, end: bigint>>, kept binary"


def _cut(length: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch, "text")
            hits, tags, out = batch.column("hits"), batch.column("tag").to_pylist(), []
            for r in range(len(batch)):
                text = data[offsets[r] : offsets[r + 1]]
                if not hits[r].is_valid:
                    out.append((0, 0, hashlib.sha256(text.tobytes()).hexdigest(), [], text.tobytes() if whole else None))
                    continue
                first, count, _ = _own(hits[r], tags[r])
                edge = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + count - 1 + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = text[~gone].tobytes()
                spans = [{"first": a, "end": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)] if whole else []
                out.append((int(gone.sum()), len(turns) // 2, hashlib.sha256(kept).hexdigest(), spans, kept if whole else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *arrays], ["doc", "key2", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; whole: spans (first and end byte of what goes) and kept (the bytes that stay) as well."""
    with scratch(prepare(docs.sparkSession)) as kept:
        return _removed(docs, length, gram, whole, kept)


def _removed(docs: DataFrame, length: int, gram: int, whole: bool, kept: list[DataFrame]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # A null doc_id would turn a batch's ids into floats and match nothing: it has a place above all others instead. Where
    # there are ids up there, all ids give way to their ranks.
    own = F.col("doc_id")
    if rows.where(F.col("doc_id") >= 3 * _NULLS).take(1):
        ranks = materialise(place(rows.where("doc_id is not null").select("doc_id").distinct(), F.col("doc_id"), [], "rank"), "ranks")
        rows = rows.join(ranks.select(F.col("doc_id").alias("_id"), F.col("rank").cast("long").alias("rank")), F.col("doc_id") == F.col("_id"), "left").drop("_id")
        own = F.col("rank")
    rows = rows.withColumn("id", F.coalesce(own, F.xxhash64("text").bitwiseAND(F.lit(_NULLS - 1)).bitwiseOR(F.lit(3 * _NULLS))))
    # What a copy that is too short to hold a string keeps.
    short = [F.when(F.octet_length("text") < length, F.col("text").cast("binary")).alias("short")] if whole else []
    meta = materialise(rows.select("doc_id", "id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), *short), "meta")
    total = meta.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = int(max(8, -(-total // BUCKET)))
    partitions = min(buckets, PARTITIONS)
    dealt = lambda packed: packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    first = rows.groupBy("text").agg(F.min("id").alias("doc_id"))
    first = first.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    # Normally empty: doc_ids that several texts share, whose places are told apart by a part of the text's key.
    shared = materialise(meta.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select(F.col("id").alias("d")), "shared")
    tag = F.when(F.col("d").isNotNull(), F.conv(F.substring("key", 1, 6), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    first = materialise(first.join(shared, F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "key", tag.alias("tag")), "first")
    packed = first.where(F.octet_length("text") >= length).select("doc_id", "text", "tag").mapInArrow(_find_runs(buckets, length, gram), PACKED)
    found = materialise(dealt(packed).mapInArrow(_join_runs, HITS), "runs")
    several = F.struct("start", "n")
    opened = found.where(F.col("kind") == OPEN).groupBy(F.col("doc").alias("o")).agg(F.collect_list(F.struct("start", "n", "h")).alias("open"))
    sent = first.join(opened, F.col("doc_id") == F.col("o")).select("doc_id", "text", "tag", "open").mapInArrow(_send_contexts(buckets, length, gram), PACKED)
    more = materialise(dealt(sent).mapInArrow(_join_contexts(length, gram), HITS), "strings")
    hits = found.where(F.col("kind") == REPEATED).unionByName(more)
    hits = hits.groupBy(F.col("doc").alias("o")).agg(F.collect_list(several).alias("hits"))
    cut = first.join(hits, F.col("doc_id") == F.col("o"), "left").select("doc_id", "text", "key", "tag", "hits")
    cut = materialise(cut.mapInArrow(_cut(length, whole), _CUT), "cut")
    for old in (first, found, more):
        drop_shared(docs.sparkSession, old)
    kept += [meta, cut]
    out = meta.join(cut, (F.col("id") == F.col("doc")) & (F.col("key") == F.col("key2")), "left")
    # A copy of a text in a smaller document: all of it goes, unless it is too short to hold a string.
    long_ = F.col("n_bytes") >= length
    is_first = F.col("doc").isNotNull()
    empty = F.sha2(F.lit("").cast("binary"), 256)
    spans = F.when(is_first, F.col("spans")).when(long_, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))).otherwise(F.array())
    real = [spans.alias("spans"), F.when(is_first, F.col("kept")).when(long_, F.lit(b"")).otherwise(F.col("short")).alias("kept")] if whole else []
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(is_first, F.col("n_removed")).when(long_, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(is_first, F.col("n_spans")).when(long_, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(is_first, F.col("kept_sha256")).when(long_, empty).otherwise(F.col("key")).alias("kept_sha256"),
        *real,
    )
