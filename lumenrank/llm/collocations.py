"""Operator 13: phrases of two to four words that occur together, from exact counts for each language.

1. Words are counted for each language: a task counts what it reads in numpy and sends each word once per window. A word's
   code is a 64-bit hash of its bytes; the table of words tells whether a frequent word shares its code with another one,
   in which case everything starts again with other hash values, so codes are exact.
2. Infrequent words break the pieces: a word that occurs less than `least` times can't be in a phrase that often. Up to NUMBERED
   frequent words have numbers, by frequency within their language, in a table of that bound that tasks get. Beyond it codes
   stand for themselves, and tasks know frequent ones by a table of bits of bounded size; where that lets an infrequent
   word pass, its phrases are counted like all others, and are too rare to be kept: the bits save work and decide nothing.
   Likewise, runs of three words are counted only where both their pairs are frequent, and runs of four by their runs of three.
3. What is left is packed as n-grams of numbers or codes into binary keys of n times 4 or 8 bytes, counted by windows of a task, written,
   and dealt out by ranges of keys; Spark sorts each range by key prefixes (radix sort) and runs of equal keys are summed.
   A phrase of any frequency is one row for each window, so no range gets more than its share of a hot one.
4. The counts of the parts, the longest phrases around and the words themselves come by equi-joins on keys.

Defined results: null texts are empty, a null lang is `und`; doc_ids are not used, so repeated and missing ones count as they
come; a text is processed in chunks that share three words where no piece ends, so its length doesn't matter; an empty
table gives no rows; extra columns are ignored. Counts are longs, products and quotients of them decimals of 38 digits.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_shared, materialise, prepare, scratch

#: Occurrences of a candidate, words of the longest, rows of a language's report; what makes a phrase redundant, in percent.
LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
#: Bytes of a chunk, distinct entries of a window, rows of an Arrow batch of sorted keys.
CHUNK, WINDOW, SORTED_ROWS = 1 << 20, 1 << 21, 50_000
#: Bits of a table of frequent words or phrases: so many for each of them, and at least and at most so many.
PER_WORD, FEWEST_BITS, MOST_BITS = 32, 1 << 16, 1 << 29
#: Frequent words that are numbered at most, and bytes of a number.
NUMBERED, NARROW = 1 << 22, 4

_ENDS = np.zeros(256, dtype=bool)  # bytes that end a piece
_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAPS = np.zeros(256, dtype=bool)  # bytes between words, also those that end a piece
_GAPS[[ord(" "), ord("\t")]] = True
_GAPS |= _ENDS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Codes:
    """Words of a piece of text and their codes: sums of values of bytes times powers of an odd base, modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng([seed, 13])
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        n = CHUNK + 2
        self._bases = base, pow(base, -1, 1 << 64)
        self.up, self.down = self._powers(n)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for b in self._bases:
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            found.append(np.multiply.accumulate(p))
        return found[0], found[1]

    def words(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lower-cased bytes; start, end, code and piece of each word."""
        low = _LOWER[data]
        inside = np.concatenate([[False], ~_GAPS[low], [False]])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turn[::2], turn[1::2]
        up, down = (self.up, self.down) if len(data) < len(self.up) else self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[low] * up[: len(data)], out=sums[1:])
        code = (sums[end] - sums[start]) * down[start]
        return low, start, end, code ^ (code >> np.uint64(29)), np.cumsum(_ENDS[low])[start]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each language's texts of a batch (columns lang and text) as one run of bytes; a line break ends each text."""
    langs = batch.column(0).dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch.column(1).take(pa.array(np.flatnonzero(code == k))).cast(pa.large_binary())
        yield lang, np.frombuffer(b"\n".join(x or b"" for x in texts.to_pylist()), dtype=np.uint8)


def chunks(codes: Codes, data: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[tuple[np.ndarray, ...], int]]:
    """Words of the chunks of a long run of bytes, and how many of a chunk's first words the chunk before had as its last."""
    at, shared, most = 0, 0, limit
    while at < len(data):
        end = min(at + most, len(data))
        if end < len(data):
            ended = np.flatnonzero(_ENDS[data[at:end]])
            gaps = ended if len(ended) else np.flatnonzero(_GAPS[data[at:end]])
            if not len(gaps):  # within one word
                most *= 2
                continue
            end = at + int(gaps[-1]) + 1
        found = codes.words(data[at:end])
        onward, back = end, 0
        if end < len(data) and not _ENDS[data[end - 1]]:
            back = LONGEST - 1
            if len(found[1]) <= back:
                most *= 2
                continue
            onward = at + int(found[1][-back])
        yield found, shared
        at, shared, most = onward, back, limit


def _sums(order: np.ndarray, new: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(counts[order], first)


def _bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of these ranges, one after the other."""
    begin = np.cumsum(length) - length
    return data[np.arange(int(length.sum())) + np.repeat(start - begin, length)]


class WordWindow:
    """Words of one language with their counts, each once."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # code, count, length, bytes
        self.size = 0

    def add(self, found: tuple[np.ndarray, ...], shared: int) -> None:
        low, start, end, code = (found[0], *(x[shared:] for x in found[1:4]))
        if len(code):
            self._put(code, np.ones(len(code), np.int64), start, end - start, low)

    def _put(self, code, count, start, length, data) -> None:
        order = np.argsort(code, kind="stable")
        own = code[order]
        start, length = start[order], length[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (length[1:] != length[:-1])])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        unlike = _bytes(data, start, length) != _bytes(data, start[first][group], length)
        if unlike.any():  # words that share a code stay apart, and the table of words will show them
            owner = np.repeat(np.arange(len(order)), length)
            new |= np.isin(group, group[owner[unlike]])
        at, total = _sums(order, new, count)
        first = np.flatnonzero(new)
        self.held.append((code[at], total, length[first], _bytes(data, start[first], length[first])))
        self.size += len(at)

    def flush(self, lang: str) -> pa.RecordBatch | None:
        if not self.held:
            return None
        if len(self.held) > 1:
            code, count, length, data = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            self._put(code, count, np.cumsum(length) - length, length, data)
        code, count, length, data = self.held.pop()
        self.size = 0
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(code), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), words, pa.array(count)], ["lang", "id", "word", "f"])


def _windows(batches: Iterator[pa.RecordBatch], codes: Codes, make) -> Iterator[pa.RecordBatch]:
    """Counts of each language by windows of about WINDOW entries."""
    windows: dict[str, WordWindow] = {}
    for b in batches:
        for lang, data in _by_lang(b):
            window = windows.setdefault(lang, make(lang))
            for found, shared in chunks(codes, data):
                window.add(found, shared)
                if window.size >= WINDOW:
                    yield from _some(window.flush(lang))
        if sum(w.size for w in windows.values()) >= 4 * WINDOW or len(windows) > 1000:
            for lang in list(windows):
                yield from _some(windows.pop(lang).flush(lang))
    for lang, window in windows.items():
        yield from _some(window.flush(lang))


def _some(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    if batch is not None:
        yield from (batch.slice(at, SORTED_ROWS) for at in range(0, batch.num_rows, SORTED_ROWS))


#: Stands for a language without frequent words: no code is its single one, as that has no number.
_NO_WORDS = np.zeros(1, np.uint64), np.zeros(1, np.uint64)


def fold(lang: str, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a language and each row of codes."""
    h = np.full(len(codes), int.from_bytes(lang.encode()[:64].ljust(8, b"\0"), "little") * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k]) * _SPREAD
        h ^= h >> np.uint64(31)
    return h


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of bits."""
    return ((h * _SPREAD) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def runs_of(code: np.ndarray, n: int) -> np.ndarray:
    """All runs of n codes, as rows."""
    return np.lib.stride_tricks.sliding_window_view(code, n) if len(code) >= n else np.zeros((0, n), np.uint64)


class GramWindow:
    """Runs of n words of one language as rows of numbers, of which both parts of n - 1 words may be frequent.

    numbers: for each language the sorted codes of its frequent words and their numbers; without it codes stand for themselves.
    table: bits of the frequent runs of n - 1 words; not needed for single words that have numbers.
    """

    def __init__(self, lang: str, n: int, table: np.ndarray | None, numbers: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        self.lang, self.n, self.table, self.numbers = lang, n, table, numbers
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, found: tuple[np.ndarray, ...], shared: int) -> None:
        code, piece, n = found[3], found[4], self.n
        if len(code) < n:
            return
        known = np.ones(len(code) - n + 2, dtype=bool)  # by the first word of n - 1
        if self.numbers is not None:
            codes, number = self.numbers.get(self.lang, _NO_WORDS)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            frequent = codes[at] == code
            code = number[at]
            for k in range(n - 1):
                known &= frequent[k : k + len(known)]
        if self.table is not None:
            at = slots(fold(self.lang, runs_of(code, n - 1)), 64 * len(self.table))
            known &= (self.table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        start = np.flatnonzero(known[:-1] & known[1:] & (piece[: len(known) - 1] == piece[n - 1 :]))
        start = start[start + n > shared]  # what lies among the shared words was counted with the chunk before
        if len(start):
            self.held.append(runs_of(code, n)[start])
            self.size += len(start)

    def flush(self, lang: str) -> pa.RecordBatch | None:
        if not self.held:
            return None
        keys = np.concatenate(self.held)
        self.held, self.size = [], 0
        keys = keys[np.argsort(fold(lang, keys))]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        count, keys = np.diff(np.append(first, len(keys))), keys[first]
        width = 8 if self.numbers is None else NARROW
        offsets = (np.arange(len(keys) + 1) * width * self.n).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.astype(f">u{width}").tobytes())])
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), binary, pa.array(count.astype(np.int64))], ["lang", "key", "f"])


def _runs(least: int):
    """Sums of runs of equal keys in sorted rows; only those of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = key = None
        total = 0

        def kept(langs, keys, sums):
            good = pa.array(sums >= least)
            return pa.RecordBatch.from_arrays([langs.filter(good), keys.filter(good), pa.array(sums[sums >= least])], ["lang", "key", "f"])

        for b in batches:
            if not len(b):
                continue
            langs, keys, f = b.column(0), b.column(1), b.column(2).to_numpy()
            new = np.ones(len(b), dtype=bool)
            if len(b) > 1:
                new[1:] = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(langs[1:], langs[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            sums = np.add.reduceat(f, first)
            at = pa.array(first)
            langs, keys = langs.take(at), keys.take(at)
            if key is not None:
                if (langs[0].as_py(), keys[0].as_py()) == (lang, key):
                    sums[0] += total
                elif total >= least:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([key], pa.binary()), pa.array([total])], ["lang", "key", "f"])
            lang, key, total = langs[-1].as_py(), keys[-1].as_py(), int(sums[-1])
            if len(sums) > 1:
                yield kept(langs[:-1], keys[:-1], sums[:-1])
        if key is not None and total >= least:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([key], pa.binary()), pa.array([total])], ["lang", "key", "f"])

    return run


@contextlib.contextmanager
def _rows_a_batch(spark, rows: int) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """(lang, id, word, f) of words that occur `least` times or more, with one row without a word for what the others add up
    to in each language; and the seed of the codes. Codes are unique among all words of a language and the frequent ones."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    for seed in range(64):

        def count(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            return _windows(batches, Codes(seed), lambda lang: WordWindow())

        each = texts.mapInArrow(count, "lang string, id long, word binary, f long").groupBy("lang", "id", "word").agg(F.sum("f").alias("f"))
        coded = each.groupBy("lang", "id").agg(F.sum("f").alias("f"), F.count("*").alias("same"), F.max("word").alias("word"))
        often = F.col("f") >= least
        named = F.when(often, F.col("id")).alias("id"), F.when(often, F.col("word")).alias("word")
        words = materialise(coded.groupBy("lang", *named).agg(F.sum("f").alias("f"), F.max("same").alias("same")), "words")
        if not words.where("id is not null and same > 1").take(1):
            return words.drop("same"), seed
    raise RuntimeError("no hash tells the frequent words apart")


def _table(frequent: DataFrame, n: int, width: int = 8) -> np.ndarray:
    """Bits of frequent runs of n words (lang, key), MOST_BITS of them at most; more runs make it let more of others pass."""
    bits, most = FEWEST_BITS, frequent.count() * PER_WORD
    while bits < min(most, MOST_BITS):
        bits *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), dtype=object)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), f">u{width}").astype(np.uint64).reshape(-1, n)
            at = np.concatenate([slots(fold(x, code[lang == x]), bits) for x in dict.fromkeys(lang)])
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    found = frequent.select("lang", "key").mapInArrow(place, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def numbered(words: DataFrame) -> tuple[DataFrame, dict[str, tuple[np.ndarray, np.ndarray]] | None]:
    """words with key, and for each language the sorted codes of its frequent words with their numbers.

    Up to NUMBERED frequent words are numbered by frequency within their language, and a key is a number of NARROW bytes: the
    tables are bounded, and sent to all tasks. More than that keep their codes of 8 bytes as keys, and no table is sent.
    """
    often = words.where("id is not null")
    if often.limit(NUMBERED + 1).count() > NUMBERED:
        return words.withColumn("key", F.unhex(F.lpad(F.hex("id"), 16, "0"))), None
    number = F.row_number().over(W.partitionBy("lang").orderBy(F.col("f").desc(), "id")) - 1  # NUMBERED rows at most
    often = materialise(often.withColumn("number", number.cast("long")), "numbers")
    found = often.select("lang", "id", "number").toArrow()
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    code, own = found.column("id").to_numpy().view(np.uint64), found.column("number").to_numpy().astype(np.uint64)
    tables = {}
    for x in dict.fromkeys(lang):
        at = np.flatnonzero(lang == x)
        at = at[np.argsort(code[at])]
        tables[x] = code[at], own[at]
    key = F.unhex(F.lpad(F.hex("number"), 2 * NARROW, "0"))
    return often.select("lang", "id", "word", "f", key.alias("key")).unionByName(words.where("id is null").withColumn("key", F.lit(None).cast("binary"))), tables


def phrase_counts(docs: DataFrame, words: DataFrame, numbers: dict | None, seed: int, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, key, f) of all phrases of 2 to `longest` words that occur `least` times or more; key: the words' keys.

    By length: a phrase is only counted where its first and its last n - 1 words are frequent.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    schema = "lang string, key binary, f long"
    shorter, found, width = words.where("id is not null").select("lang", "key"), None, 8 if numbers is None else NARROW
    for n in range(2, longest + 1):
        table = None if n == 2 and numbers is not None else _table(shorter, n - 1, width)
        sent = spark.sparkContext.broadcast((table, numbers))

        def count(batches: Iterator[pa.RecordBatch], n: int = n, sent=sent) -> Iterator[pa.RecordBatch]:
            return _windows(batches, Codes(seed), lambda lang: GramWindow(lang, n, *sent.value))

        grams = materialise(texts.mapInArrow(count, schema), "grams")
        with _rows_a_batch(spark, SORTED_ROWS):
            dealt = grams.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
            shorter = materialise(dealt.mapInArrow(_runs(least), schema), "phrases")
        drop_shared(spark, grams)
        sent.destroy()
        found = shorter if found is None else found.unionByName(shorter)
    return found


def _part(first: Column | int, many: Column | int, width: int) -> Column:
    """Keys of so many words of a phrase's key from the word `first` (from 0)."""
    first, many = (x if isinstance(x, Column) else F.lit(x) for x in (first, many))
    return F.col("key").substr((first * width + 1).cast("int"), (many * width).cast("int"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """For each language the `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    a: occurrences of the phrase; l and r: of the two parts of its lowest-scoring cut; n: of all words; score:
    floor(2000000 a / (l + r)). Phrases that lie in a longer one with 100 f >= covered a are left out.
    """
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession) as kept:
        words, seed = word_counts(docs, least)
        words, numbers = numbered(words)
        phrases = phrase_counts(docs, words, numbers, seed, least, longest)
        out = _ranked(words, phrases, 8 if numbers is None else NARROW, top, covered)
        out = materialise(out, "collocations")
        kept.append(out)
        return out


def _ranked(words: DataFrame, phrases: DataFrame, width: int, top: int, covered: int) -> DataFrame:
    big = "decimal(38,0)"
    sized = phrases.withColumn("many", F.expr(f"cast(length(key) / {width} as int)"))
    ids = words.where("id is not null")
    parts = phrases.unionByName(ids.select("lang", "key", "f")).withColumnRenamed("key", "part")  # counts of all parts
    cuts = sized.select("lang", "key", F.col("f").alias("a"), "many", F.explode(F.sequence(F.lit(1), F.col("many") - 1)).alias("k"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("_l"), F.col("f").alias("l")).withColumnRenamed("lang", "_ll"), (F.col("lang") == F.col("_ll")) & (_part(0, F.col("k"), width) == F.col("_l"))).drop("_ll", "_l")
    cuts = cuts.join(parts.select("lang", F.col("part").alias("_r"), F.col("f").alias("r")).withColumnRenamed("lang", "_rl"), (F.col("lang") == F.col("_rl")) & (_part(F.col("k"), F.col("many") - F.col("k"), width) == F.col("_r"))).drop("_rl", "_r")
    score = F.expr(f"cast(cast(2000000 as {big}) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "key", "a", "many").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every phrase within a longer one, with the most that a longer one occurs.
    lengths = F.sequence(F.lit(2), F.col("many") - 1)
    inner = sized.where("many > 2").select("lang", "key", "f", "many", F.explode(lengths).alias("n"))
    inner = inner.select("lang", "key", "f", "n", F.explode(F.sequence(F.lit(0), F.col("many") - F.col("n"))).alias("at"))
    around = inner.groupBy("lang", _part(F.col("at"), F.col("n"), width).alias("key")).agg(F.max("f").alias("longer"))
    stays = F.expr(f"longer is null or cast(100 as {big}) * cast(longer as decimal(19,0)) < cast({covered} as {big}) * cast(a as decimal(19,0))")
    left = best.join(around, ["lang", "key"], "left").where(stays).select("lang", "key", "a", "many", "cut.score", "cut.l", "cut.r")
    # Ties at the end of the report need their words: until then all of them stay.
    order = [F.col("score").desc(), F.col("a").desc()]
    near = left.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    near = materialise(near, "near")
    each = near.select("lang", "key", F.posexplode(F.expr(f"transform(sequence(0, many - 1), i -> substr(key, cast(i * {width} + 1 as int), {width}))")).alias("at", "part"))
    named = each.join(ids.select("lang", F.col("key").alias("part"), "word"), ["lang", "part"])
    spelt = named.groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))  # at most `longest` words
    phrase = F.expr("array_join(transform(w, x -> cast(x.word as string)), ' ')")
    full = near.join(spelt.select("lang", "key", phrase.alias("phrase")), ["lang", "key"])
    ranked = full.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
