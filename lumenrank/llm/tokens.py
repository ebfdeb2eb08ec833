"""Operators 8 and 10: token counts, and token ids in a binary format with seekable compressed frames.

Texts are encoded by the tokenizers library. A worker remembers the ids of the pieces it has met: the byte-level
pre-tokenizer never joins a character that isn't white space with a following space, so a text may be cut before every space
that a character other than white space follows, and the ids of the parts are the ids of the whole. A text with a
special token's string or other runs of white space is encoded in one piece. A line break that stands alone between
other characters is cut before in the same way.

Defined results: a null text counts as empty; an empty text has no ids but the end id; equal doc_ids are documents of
their own, in the order of their text's hash; documents without a doc_id come last and are read back without one; an
empty table gives an empty result and no files; extra columns are ignored.
"""

from __future__ import annotations

import gc
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BLOCK_BYTES, materialise, prepare, shared_path

#: Appended to each document by the writer.
END_ID = 2
#: Parts of texts whose ids a worker remembers; beyond that, what was not used since as many were learned is forgotten.
REMEMBERED = 1_200_000
#: Stored bytes of the input for each file.
FILE_BYTES = 16 << 20
#: A text whose parts are longer than this on average is encoded in one piece.
LONGEST_PIECE = 64
#: ASCII punctuation, as it may end a part.
PUNCTUATION = string.punctuation


class Encoder:
    """Ids of whole texts, equal to the library's own, as little-endian unsigned integers of 2 bytes if all fit, else 4."""

    kept: ClassVar[dict[str, Encoder]] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.endings: dict[str, bytes] = {}
        # Ids whose bytes begin with a space or a line break, as the byte-level alphabet writes them.
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.spaces, self.breaks = (np.zeros(max(vocabulary.values()) + 1, dtype=bool) for _ in range(2))
        for lead, table in (("\u0120", self.spaces), ("\u010a", self.breaks)):
            table[[i for t, i in vocabulary.items() if t.startswith(lead)]] = True

    @classmethod
    def of(cls, path: str | None) -> Encoder:
        """The worker's encoder for this vocabulary: its memory outlives a task."""
        path = _local_tokenizer(path)
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _learn(self, wanted: set[str]) -> None:
        """Make the parts known: from the older half of the memory, else by encoding the unknown ones in one text."""
        if len(self.ids) > REMEMBERED:
            self.older, self.ids = self.ids, {}
        known, older = self.ids, self.older
        lined: list[str] = []
        spaced: set[str] = set()
        ended: list[tuple[str, str]] = []
        for m in wanted.difference(known):
            if m in older:
                known[m] = older[m]
            elif m[:1] == "\n":
                if len(m) < 2 or m[1].isspace():
                    known[m] = None
                else:
                    lined.append(m)
            elif not m or m[0].isspace():
                known[m] = None  # white space after the space that cuts: such a cut could change the ids
            else:
                # Punctuation after a letter or digit is a piece of its own: a word is learned once for all its endings.
                word = m.rstrip(PUNCTUATION)
                if word and word != m and word[-1].isalnum():
                    ended.append((m, word))
                    if word not in known:
                        if word in older:
                            known[word] = older[word]
                        else:
                            spaced.add(word)
                else:
                    spaced.add(m)
        words = list(spaced)
        for fresh, joined, leads in ((words, " " + " ".join(words), self.spaces), (lined, "".join(lined), self.breaks)):
            if fresh:
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.kind)
                at = np.append(np.flatnonzero(leads[ids]), len(ids)) * self.width
                if len(at) != len(fresh) + 1:
                    raise AssertionError("a part has a second lead")
                raw = ids.tobytes()
                known.update((m, raw[i:j]) for m, i, j in zip(fresh, at[:-1].tolist(), at[1:].tolist(), strict=True))
        for m, word in ended:
            known[m] = known[word] + self._ending(m[len(word) :])

    def _ending(self, marks: str) -> bytes:
        got = self.endings.get(marks)
        if got is None:
            got = self.whole(marks)
            if len(self.endings) < 10_000:
                self.endings[marks] = got
        return got

    def _parts(self, text: str) -> list[str] | None:
        """The text cut before single spaces, and before line breaks where those stand alone; None: don't cut."""
        if any(s in text for s in self.special) or " \n" in text or text.startswith("\n"):
            return None
        if "\n" in text and "\n\n" not in text and "\n " not in text:
            text = text.replace("\n", " \n")
        parts = text.split(" ")
        return None if len(text) > LONGEST_PIECE * len(parts) else parts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        # Nothing here makes cycles, and the collector would walk the lists of parts again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._all(texts)
        finally:
            if collects:
                gc.enable()

    def _all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            held, end = 0, at
            while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK_BYTES):
                held += len(texts[end])
                end += 1
            out.extend(self._block(texts[at:end]))
            at = end
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        parts: list[list[str] | None] = []
        wanted: set[str] = set()
        for text in texts:
            p = self._parts(text)
            if p is not None:
                wanted.update(p[1:])
            parts.append(p)
        self._learn(wanted)
        get, out = self.ids.__getitem__, []
        heads = self.tokenizer.encode_batch_fast([p[0] if p else "" for p in parts], add_special_tokens=False)
        for text, p, head in zip(texts, parts, heads, strict=True):
            try:
                got = None if p is None else b"".join(map(get, p[1:]))
            except TypeError:
                got = None
            out.append(self.whole(text) if got is None else np.array(head.ids, dtype=self.kind).tobytes() + got)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _local_tokenizer(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    return path


def token_lengths(docs: DataFrame, tokenizer: str | None = None, end_ids: int = 0) -> DataFrame:
    """doc_id and n_tokens of each document; end_ids are added to each."""
    prepare(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for b in batches:
            n = [len(x) // encoder.width + end_ids for x in encoder.encode_all([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lengths, "doc_id long, n_tokens long")


#: Lengths of a page, and pages of a book.
PAGE = 64


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, exact: what a context limit of that many tokens keeps and loses.

    n_tokens; n_docs and tokens at this length; docs_longer and tokens_longer beyond it; total_docs and total_tokens;
    truncated_total: tokens that are left if every document is cut to n_tokens; quantile: the share of documents of
    at most n_tokens. Suffix sums go by pages of 64 lengths, and of these by 64 again, so no task gathers the histogram.
    """
    at = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    at = materialise(at.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "histogram")
    after = lambda w: w.rowsBetween(1, W.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))

    def suffixes(rows: DataFrame, key: str, page: str, names: tuple[str, str]) -> DataFrame:
        """rows with names: the documents and tokens of all larger keys of the same page."""
        inner = after(W.partitionBy(page).orderBy(key))
        return rows.select("*", zero(F.sum("n_docs").over(inner)).alias(names[0]), zero(F.sum("tokens").over(inner)).alias(names[1]))

    sums = [F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens")]
    pages = at.groupBy(F.floor(F.col("n_tokens") / PAGE).alias("_page")).agg(*sums)
    pages = pages.withColumn("_book", F.floor(F.col("_page") / PAGE))
    books = pages.groupBy("_book").agg(*sums)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    over = after(W.orderBy("_book"))  # a row for every 4,096 lengths
    books = books.select("_book", *[zero(F.sum(c).over(over)).alias(n) for c, n in (("n_docs", "_bd"), ("tokens", "_bt"))], F.sum("n_docs").over(whole).alias("total_docs"), F.sum("tokens").over(whole).alias("total_tokens"))
    pages = suffixes(pages, "_page", "_book", ("_pd", "_pt")).drop("n_docs", "tokens").join(books, "_book")
    pages = pages.select("_page", "total_docs", "total_tokens", (F.col("_bd") + F.col("_pd")).alias("_d"), (F.col("_bt") + F.col("_pt")).alias("_t"))
    rows = suffixes(at.withColumn("_page", F.floor(F.col("n_tokens") / PAGE)), "n_tokens", "_page", ("_id", "_it")).join(pages, "_page")
    longer, more = F.col("_d") + F.col("_id"), F.col("_t") + F.col("_it")
    return rows.select(
        "n_tokens",
        "n_docs",
        "tokens",
        longer.alias("docs_longer"),
        more.alias("tokens_longer"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - more + longer * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """truncated_total, docs cut and tokens lost for any context limits, read off the histogram."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    below = histogram.groupBy().agg(F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"))
    got = asked.join(histogram, F.col("n_tokens") <= F.col("context"), "left").groupBy("context").agg(
        F.max(F.struct("n_tokens", "docs_longer", "tokens_longer")).alias("x")
    )
    cut, lost = F.coalesce(F.col("x.docs_longer"), F.col("d")), F.coalesce(F.col("x.tokens_longer"), F.col("t"))
    return got.crossJoin(F.broadcast(below)).select(
        "context", cut.alias("docs_cut"), (F.col("t") - lost + cut * F.col("context")).alias("truncated_total"), (lost - cut * F.col("context")).alias("tokens_lost")
    )


# --- the file format -----------------------------------------------------------------------------------------------
# A file is one zstandard frame per document (little-endian ids, 2 bytes each where all fit, else 4), then a
# skippable frame with the directory, then a skippable frame with the seek table. Fixed values of the formats:
SKIP_DIRECTORY = 0x184D2A50
SKIP_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
#: Layout of an entry (compressed and full size, checksum) and of the footer (frames, flags, magic).
_ENTRY, _FOOTER = "<III", "<IBI"


class TokenFile:
    """Reads documents of one file by their place in it; decompresses the frames asked for and checks each."""

    def __init__(self, uri: str):
        import zstandard

        self.files, self.path = pafs.FileSystem.from_uri(uri)
        self.plain = zstandard.ZstdDecompressor()
        self.file = self.files.open_input_file(self.path)
        size = self.file.size()
        self.file.seek(size - struct.calcsize(_FOOTER))
        n, flags, magic = struct.unpack(_FOOTER, self.file.read(struct.calcsize(_FOOTER)))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"no seek table in {uri}")
        length = n * struct.calcsize(_ENTRY) + struct.calcsize(_FOOTER)
        self.file.seek(size - length)
        self.table = np.frombuffer(self.file.read(n * struct.calcsize(_ENTRY)), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.file.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", self.file.read(8))
        if magic != SKIP_DIRECTORY:
            raise ValueError(f"no directory in {uri}")
        body = self.file.read(length)
        self.width = int(body[0])
        directory = self.plain.decompress(body[1:])
        #: Ids of the documents; those that have none are 0 here and marked in `without`.
        self.doc_ids = np.frombuffer(directory, dtype="<i8", count=n)
        self.without = np.frombuffer(directory, dtype="u1", offset=8 * n).astype(bool)

    def ids(self, ks: np.ndarray) -> pa.Array:
        return pa.array(self.doc_ids[ks], mask=self.without[ks])

    def read(self, k: int) -> np.ndarray:
        return self.read_many(np.array([k]))[0]

    def read_many(self, ks: np.ndarray) -> list[np.ndarray]:
        """The ids of some documents; frames that stand side by side are fetched in one piece."""
        import xxhash

        out, at = [], 0
        while at < len(ks):
            end = at + 1
            while end < len(ks) and ks[end] == ks[end - 1] + 1 and self.starts[ks[end] + 1] - self.starts[ks[at]] <= BLOCK_BYTES:
                end += 1
            first = int(self.starts[ks[at]])
            self.file.seek(first)
            piece = memoryview(self.file.read(int(self.starts[ks[end - 1] + 1]) - first))
            for k in ks[at:end].tolist():
                got = self.plain.decompress(piece[int(self.starts[k]) - first : int(self.starts[k + 1]) - first], max_output_size=max(1, int(self.table[k, 1])))
                if len(got) != self.table[k, 1] or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != self.table[k, 2]:
                    raise ValueError(f"frame {k} of {self.path} is damaged")
                out.append(np.frombuffer(got, dtype="<u2" if self.width == 2 else "<u4").astype("<u4"))
            at = end
        return out

    def close(self) -> None:
        self.file.close()


def _write(folder: str, tokenizer: str | None, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        encoder, pack = Encoder.of(tokenizer), zstandard.ZstdCompressor(level=1)
        width, last = encoder.width, np.array([end], dtype=encoder.kind).tobytes()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.tok"  # one name per attempt: a task that is run again does no harm
        out, ids, table, total, first = None, [], [], 0, None
        for b in batches:
            first = b.column(2)[0].as_py() if first is None and len(b) else first
            out = out or files.open_output_stream(f"{root}/{name}", compression=None)
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, coded in zip(b.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                raw = coded + last
                frame = pack.compress(raw)
                out.write(frame)
                table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                ids.append(doc)
                total += len(raw) // width
        if out is None:
            return
        without = np.array([i is None for i in ids], dtype="u1")
        body = bytes([width]) + pack.compress(np.array([i or 0 for i in ids], dtype="<i8").tobytes() + without.tobytes())
        out.write(struct.pack("<II", SKIP_DIRECTORY, len(body)) + body)
        seek = np.array(table, dtype="<u4").tobytes() + struct.pack(_FOOTER, len(table), CHECKSUMS, SEEK_MAGIC)
        out.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)
        out.close()
        cols = [[name], [ids[0]], [first], [len(ids)], [total]]
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "first_doc", "first_hash", "n_docs", "n_ids"])

    return write


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end: int = END_ID) -> tuple[DataFrame, str]:
    """Write all documents in ascending doc_id order; a manifest (file, first_doc, first_hash, n_docs, n_ids, nth, start) and the folder.

    Files are ranges of doc_id and the text's hash, one for about FILE_BYTES of the stored input, so an id that very many
    documents share, or that they lack, is spread over files as well. Only files that the manifest names count.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or shared_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(1, spark.sparkContext.defaultParallelism, min(-(-stored // FILE_BYTES), 1 << 20))
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    manifest = materialise(ranged.mapInArrow(_write(folder, tokenizer, end), "file string, first_doc long, first_hash long, n_docs long, n_ids long"), "manifest")
    # One row per file here: files grow with the data, rows of the manifest only with the files.
    by = W.orderBy(F.col("first_doc").asc_nulls_last(), "first_hash")
    start = F.coalesce(F.sum("n_ids").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return manifest.select("*", (F.row_number().over(by) - 1).alias("nth"), start.alias("start")), folder


def read_tokens(manifest: DataFrame, folder: str, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) from the files; wanted: only these documents' frames are read."""
    keep = None if wanted is None else np.array(sorted(wanted), dtype=np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(f"{folder}/{name}")
                lengths = f.table[:, 1] // f.width
                starts = start + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                chosen = np.arange(len(lengths)) if keep is None else np.flatnonzero(np.isin(f.doc_ids, keep) & ~f.without)
                for at in range(0, len(chosen), 500):
                    part = chosen[at : at + 500]
                    ids = f.read_many(part)
                    cols = [f.ids(part), pa.array(starts[part]), pa.array(lengths[part].astype(np.int64)), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                f.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    # A task for about every file: a number that is given is not coalesced.
    return manifest.select("file", "start").repartition(max(1, manifest.count()), "file").mapInArrow(read, schema)
