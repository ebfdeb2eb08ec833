"""The near-dedup stage: SimHash first, then all that it misses, so that what is linked is exactly what is similar.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Operator 9 links the
fingerprints of the same shingles through its Gray-order index, and these pairs are compared first: they join most
copies. But no radius of fingerprints holds all similar pairs (at 0.8 about ten of 64 bits differ, and any number may),
so the rest comes from prefixes: with all shingles in one order, two sets that share 0.8 of their union share a shingle
among the first n - ceil(0.8 n) + 1 of each. The order is by a count of hashed shingles, rare ones first, so what very
many texts share stands in few prefixes; any order gives the same pairs. Every pair of a shared shingle is then
compared whole, unless it is in one group already: first each text with the nearest of some others of its shingles, in a few rounds,
then all pairs that are still in different groups. Nothing is capped.

A shingle that only one text has in its prefix never leaves the task that finds it alone; shingles that the counts show
to be very frequent are dealt out over several tasks. Texts are hashed again where their sets are needed, as the sets
take more room than the texts; only texts of pairs leave their tasks, known by a bitmap of fixed size. Pairs of one
shingle are first told apart by sketches: bit h of a set's sketch is the parity of its shingles of hash h, so the bits
in which two sketches differ are at most the shingles that only one of the sets has, and no similar pair is lost.

Defined results: words as in simhash (lower case A-Z, parted by white space); a text under five words is one shingle;
null texts and texts without words are one group; a null doc_id comes after all others; of rows that are equal in
doc_id and text one stays; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles, simhash
from .common import components, drop_shared, first_of_each, materialise, prepare, scratch, text_column, text_hash

WORDS = 5
#: The similarity as a fraction.
SIMILAR = (4, 5)
#: Counters of hashed shingles, and how many of them travel as one row.
COUNTERS = 1 << 20
_PART = 1 << 14
#: Postings of one shingle that go to one task, by its counter's excess over the mean.
HOT = 1 << 16
#: Rounds that compare each text with one other, then rounds that compare it with the nearest few of all others, before all pairs that are left.
ROUNDS, JOINING, NEAREST = 2, 2, 3

#: Bits that tell which texts are asked for, by their hashes.
ASKED = 1 << 25
#: Bits of a sketch, as a power of two.
SKETCH = 8

_ROW = "doc_id long, text_hash long, node long, n int, fp long, sketch binary, part int, body binary"


def _name(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED)


def _sketch(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH) & 1).tobytes()


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Blocks of texts: the first one's number, their shingles (how many, hashes), and the sorted set of each."""
    for lo, many, hashes in shingles.of_batch(data, offsets, words, simhash.SEED):
        ends = np.cumsum(many)
        found = []
        for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True):
            s = np.sort(hashes[a:b])
            found.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a else s)
        yield lo, many, hashes, found


def _rows(words: int):
    """Of each row its set's name, size and sketch and its fingerprint; at the end the task's counts, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        names = [f.split()[0] for f in _ROW.split(", ")]
        for b in batches:
            n, sketches = len(b), []
            node, size, fp = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.uint64)
            for lo, many, hashes, found in _sets(*text_column(b, "text"), words):
                here = slice(lo, lo + len(many))
                fp[here], node[here], size[here] = simhash.majorities(many, hashes), [_name(s) for s in found], [len(s) for s in found]
                sketches += [_sketch(s) for s in found]
                np.add.at(counts, (np.concatenate(found) % np.uint64(COUNTERS)).astype(np.int64), 1)
            columns = [b.column(0), b.column(1), pa.array(node.view(np.int64)), pa.array(size), pa.array(fp.view(np.int64)), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        some = [k for k in range(COUNTERS // _PART) if counts[k * _PART : (k + 1) * _PART].any()]
        if some:
            bodies = pa.array([counts[k * _PART : (k + 1) * _PART].tobytes() for k in some], pa.binary())
            empty = [pa.nulls(len(some), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(some, pa.int32()), bodies], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(body, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "body"])


def _prefixes(counts, words: int, over: int, under: int):
    """Per set the shingles of its prefix: token, salt, node, n, and how many of the set follow the token.

    salt: -1, or for a frequent token which of its shares the posting goes to. A task sends a set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.frombuffer(counts.value, np.int64)
        excess = np.maximum(0, of - 2 * int(of.mean()))
        sent: set[int] = set()
        for b in batches:
            out = []
            for s in (s for _, _, _, found in _sets(*text_column(b, "text"), words) for s in found):
                n = len(s)
                name = _name(s)
                if not n or name in sent:
                    continue
                sent.add(name)
                node = np.uint64(name).view(np.int64)
                k = n - -(-over * n // under) + 1
                place = (s % np.uint64(COUNTERS)).astype(np.int64)
                first = np.lexsort((s, of[place]))[:k]
                after = n - 1 - np.arange(k)
                shared = of[place[first]] > 1
                first, after = first[shared], after[shared]
                shares = excess[place[first]] // HOT + 1
                salt = np.where(shares > 1, (np.uint64(name) % shares.astype(np.uint64)).astype(np.int32), -1).astype(np.int32)
                out.append((s[first].view(np.int64), salt, np.full(len(first), node, np.int64), np.full(len(first), n, np.int32), after.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["token", "salt", "node", "n", "after"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token and node those of tokens with several nodes, each once, and all of frequent tokens."""
    names = ["token", "salt", "node", "n", "after"]
    held = [np.zeros(0, k) for k in (np.int64, np.int32, np.int64, np.int32, np.int32)]
    gone = None  # the last posting that went out, whose token may go on

    def sift(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, gone
        token, salt, node = columns[:3]
        if not len(token):
            return
        fresh = np.concatenate([[gone is None or (token[0], node[0]) != gone], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        columns = [c[fresh] for c in columns]
        token, salt, node = columns[:3]
        if not len(token):
            return
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        many = np.diff(np.append(head, len(token)))
        keep = (np.repeat(many, many) > 1) | (salt >= 0)
        if gone is not None and token[0] == gone[0]:
            keep[: many[0]] = True
        wait = not keep[-1] and not last  # a lone posting of the last token: its next may be in the next batch
        held = [c[-1:] if wait else c[:0] for c in columns]
        if keep.any():
            out = [c[keep] for c in columns]
            gone = (out[0][-1], out[2][-1])
            yield pa.RecordBatch.from_arrays([pa.array(out[k]) for k in (0, 2, 3, 4)], ["token", "node", "n", "after"])

    for b in batches:
        yield from sift([np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)], False)
    yield from sift(held, True)


#: Postings that are looked at together, and pairs that they make at once.
GATHER = 1 << 16
MADE = 1 << 19


def _nearest(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """Of pairs at distance d, for each text on either side the nearest partner: at most one row for each text."""
    a, b, d = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([d, d])
    order = np.lexsort((b, d, a))
    order = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])]
    return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in (a, b, d)], ["a", "b", "d"])


def _across(over: int, under: int, nearest: bool = False):
    """Pairs of one token and different groups, of fitting sizes, places and sketches; rows of a token are neighbours.

    nearest: no pairs, but for each text of a block of them the partner of nearest sketch, with the distance.
    """
    names = ("token", "component", "node", "n", "after")

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((columns[1], columns[0]))
        token, group, node, n, after, sketch = (c[order] for c in columns)
        rows = len(token)
        fresh = np.ones(rows, dtype=bool)
        fresh[1:] = token[1:] != token[:-1]
        apart = fresh.copy()
        apart[1:] |= group[1:] != group[:-1]
        until = lambda edge: np.repeat(np.append(np.flatnonzero(edge)[1:], rows), np.diff(np.append(np.flatnonzero(edge), rows)))
        first, end = until(apart), until(fresh)  # of a row's partners: those of its token after its group
        many = end - first
        done = np.cumsum(many)
        n, after = n.astype(np.int64), after.astype(np.int64)
        at = 0
        while at < rows:
            base = done[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(done, base + MADE, side="right")))
            m = many[at:to]
            i = np.repeat(np.arange(at, to), m)
            j = np.repeat(first[at:to] - (np.cumsum(m) - m), m) + np.arange(len(i))
            most = 1 + np.minimum(after[i], after[j])  # if the token is the first that they share
            fits = (most * (over + under) >= over * (n[i] + n[j])) & (np.minimum(n[i], n[j]) * under >= np.maximum(n[i], n[j]) * over)
            i, j = i[fits], j[fits]
            apart_by = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
            near = apart_by * (over + under) <= (n[i] + n[j]) * (under - over)
            x, y = node[i[near]], node[j[near]]
            if len(x) and nearest:
                yield _nearest(x, y, apart_by[near])
            elif len(x):
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            if not len(b):
                continue
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(len(b), -1)
            held.append([*(b.column(c).to_numpy() for c in names), sketch])
            size += len(b)
            if size >= GATHER:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                edge = np.flatnonzero(columns[0] != columns[0][-1])
                cut = int(edge[-1]) + 1 if len(edge) else 0  # the last token may go on
                if cut:
                    yield from pairs([c[:cut] for c in columns])
                held, size = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if size:
            yield from pairs([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _alike(words: int, over: int, under: int):
    """The pairs whose texts are similar; a batch hashes each of its texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            nodes, first = np.unique(np.concatenate([a, c]), return_index=True)
            column = pa.chunked_array([b.column("x"), b.column("y")]).combine_chunks()
            batch = pa.RecordBatch.from_arrays([column.take(pa.array(first))], ["text"])
            sets = [s for _, _, _, found in _sets(*text_column(batch, "text"), words) for s in found]
            keep = []
            for i, j in zip(np.searchsorted(nodes, a).tolist(), np.searchsorted(nodes, c).tolist(), strict=True):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                keep.append(both * (over + under) >= over * (len(sets[i]) + len(sets[j])))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ."""
    word = lambda c, k: F.conv(F.hex(F.substring(c, 1 + 8 * k, 8)), 16, -10).cast("long")
    return sum((F.bit_count(word(x, k).bitwiseXOR(word(y, k))) for k in range((1 << SKETCH) // 64)), F.lit(0))


def _wanted(bits):
    """The texts whose bits are set, each once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sent = np.frombuffer(bits.value, np.uint64), set()
        for b in batches:
            names = b.column(0).to_numpy()
            bit = names.view(np.uint64) % np.uint64(ASKED)
            found = np.flatnonzero(of[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
            new = [i for i in found.tolist() if (h := int(names[i])) not in sent and not sent.add(h)]
            if new:
                yield b.take(pa.array(new))

    return run


def _verified(pairs: DataFrame, classes: DataFrame, source: DataFrame, words: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of sets that are similar. Of all texts only those of pairs are shuffled, and what shares a bit with one."""
    spark = pairs.sparkSession
    x, y = classes.select(F.col("node").alias("a"), F.col("text_hash").alias("x")), classes.select(F.col("node").alias("b"), F.col("text_hash").alias("y"))
    asked = materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), "asked")
    bit = asked.select(F.explode(F.array("x", "y")).alias("h")).selectExpr(f"cast(conv(hex(h), 16, 10) AS decimal(20,0)) % {ASKED} AS h").selectExpr("cast(h AS long) AS h")
    bits = np.zeros(ASKED // 64, np.int64)  # at most so many rows come here, whatever the number of pairs
    for part in bit.groupBy(F.expr("h div 64").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 AS int))")).alias("v")).toLocalIterator():
        bits[part.k] = part.v
    found = source.select("text_hash", "text").mapInArrow(_wanted(spark.sparkContext.broadcast(bits.tobytes())), "text_hash long, text string")
    texts = materialise(found.dropDuplicates(["text_hash"]), "texts")
    met = asked.withColumnsRenamed({"x": "_x", "y": "_y"}).join(texts.select(F.col("text_hash").alias("_x"), F.col("text").alias("x")), "_x")
    met = met.join(texts.select(F.col("text_hash").alias("_y"), F.col("text").alias("y")), "_y").select("a", "b", "x", "y")
    alike = materialise(met.mapInArrow(_alike(words, *similar), "a long, b long"), "alike")
    for old in (asked, texts):
        drop_shared(spark, old)
    return alike


def _counted(spark, made: DataFrame):
    """The counters of all tasks, summed, as a broadcast of fixed size."""
    summed = made.where("part is not null").select("part", "body").repartition("part").mapInArrow(_summed, "part int, body binary")
    whole = np.zeros((COUNTERS // _PART, _PART), dtype=np.int64)
    for r in summed.toLocalIterator():
        whole[r.part] = np.frombuffer(r.body, np.int64)
    return spark.sparkContext.broadcast(whole.tobytes())


def _near_fingerprints(classes: DataFrame, differ: int) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints operator 9 links, enough to span its groups."""
    heads = materialise(classes.where("n > 0").groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = classes.where("n > 0").join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    a, b = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    near = simhash.links(heads.select("fp"), differ).join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return materialise(equal.unionByName(near).distinct(), "near")


def similar_rows(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR, differ: int = simhash.DIFFER) -> DataFrame:
    """doc_id, text_hash and class for each row of docs: rows whose texts are linked, directly or by others, have one class."""
    spark = prepare(docs.sparkSession)
    over, under = similar
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as kept:
        made = materialise(source.mapInArrow(_rows(words), _ROW), "rows")
        counts = _counted(spark, made)
        rows = made.where("part is null").select("doc_id", "text_hash", "node", "n", "fp", "sketch")
        one = F.min_by(F.struct("text_hash", "n", "fp", "sketch"), F.xxhash64("doc_id", "text_hash"))
        classes = materialise(rows.groupBy("node").agg(one.alias("one")).select("node", "one.*"), "classes")
        near = _near_fingerprints(classes, differ)
        found = source.select("text").mapInArrow(_prefixes(counts, words, over, under), "token long, salt int, node long, n int, after int")
        found = found.repartition("token", "salt").sortWithinPartitions("token", "node").mapInArrow(_shared, "token long, node long, n int, after int")
        postings = materialise(found, "postings")
        fits = lambda x, y: F.least(x, y) * under >= F.greatest(x, y) * over
        links = _verified(near, classes, source, words, similar)
        groups = materialise(components(links), "groups")
        open_, now = postings, None

        def grouped() -> DataFrame:
            """Postings with their groups, of tokens that are still in several."""
            left = open_.join(groups.withColumnRenamed("node", "_g"), F.col("node") == F.col("_g"), "left")
            here = materialise(left.select("token", "node", "n", "after", F.coalesce("component", "node").alias("component")), "grouped")
            several = materialise(here.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token"), "several")
            out = materialise(here.join(several, "token"), "open")
            for old in (here, several):
                drop_shared(spark, old)
            return out

        for k in range(ROUNDS):
            now, before = grouped(), now
            if before is not None:
                drop_shared(spark, before)
            open_ = now.select("token", "node", "n", "after")
            pivot = F.min(F.struct(F.xxhash64("node", F.lit(k)), F.col("node").alias("p"), F.col("component").alias("c"), F.col("n").alias("m")))
            pivots = materialise(now.groupBy("token").agg(pivot.alias("v")), "pivots")
            met = now.join(pivots, "token").where((F.col("component") != F.col("v.c")) & fits(F.col("n"), F.col("v.m")))
            met = materialise(met.select("node", "v.p", (F.col("n") + F.col("v.m")).alias("both")).distinct(), "met")
            # Of its shingles' pivots a text meets the one whose sketch is the nearest, if that can be similar.
            met = met.join(classes.select("node", F.col("sketch").alias("x")), "node").join(classes.select(F.col("node").alias("p"), F.col("sketch").alias("y")), "p")
            near = met.withColumn("d", _differing(F.col("x"), F.col("y"))).where(F.col("d") * (over + under) <= F.col("both") * (under - over))
            tried = near.groupBy("node").agg(F.min(F.struct("d", F.xxhash64("p", F.lit(k)), "p")).alias("v"))
            more = _verified(tried.select(F.col("node").alias("a"), F.col("v.p").alias("b")), classes, source, words, similar)
            drop_shared(spark, pivots)
            if not more.take(1):
                break
            links = links.unionByName(more)
            groups = materialise(components(links), "groups")
        # Few bytes make many pairs here: more partitions than adaptive execution would leave.
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # Groups whose members are similar across have very many such pairs; the nearest few of each text join them first.
        for k in range(JOINING + 1):
            now, before = grouped(), now
            if before is not None:
                drop_shared(spark, before)
            open_ = now.select("token", "node", "n", "after")
            left = now.join(classes.select("node", "sketch"), "node").repartition(tasks, "token").sortWithinPartitions("token")
            if k == JOINING:
                break
            best = left.mapInArrow(_across(over, under, True), "a long, b long, d long").groupBy("a").agg(F.collect_set(F.struct("d", "b")).alias("v"))
            tried = best.select("a", F.explode(F.slice(F.sort_array("v"), 1, NEAREST)).alias("v")).select(F.least("a", "v.b").alias("a"), F.greatest("a", "v.b").alias("b"))
            more = _verified(tried.distinct(), classes, source, words, similar)
            if not more.take(1):
                break
            links = links.unionByName(more)
            groups = materialise(components(links), "groups")
        pairs = materialise(left.mapInArrow(_across(over, under), "a long, b long").distinct(), "pairs")
        links = links.unionByName(_verified(pairs, classes, source, words, similar))
        joined = materialise(components(links), "joined")
        kept += [made, joined]
    found = rows.join(joined.withColumnRenamed("node", "_g"), F.col("node") == F.col("_g"), "left")
    return found.select("doc_id", "text_hash", F.coalesce("component", "node").alias("class"))


def similar_groups(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that pairs of at least this Jaccard similarity reach (null if it has none)."""
    rows = similar_rows(docs, words, similar)
    least = rows.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "class").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The first row of docs of each group; columns stay as they are."""
    return first_of_each(docs, similar_rows(docs, words, similar))
