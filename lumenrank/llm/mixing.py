"""Operator 6 [native]: mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted f = target / source_size times. floor(f) copies are certain; the fraction that
is left over is rounded by the pivotal method: two documents meet, words are moved between their expected amounts at
random until one of the two is a whole number of copies, and the other one goes on to meet the next. Inside a chunk
of a source this is one fold over an array; what a chunk leaves over (one document) meets the leftovers of other
chunks on the next level, a reduction tree whose levels shrink by the chunk size. The words of a source stay what
they were at every step, so only the very last document of a source moves its total.

Only DataFrame functions are used.

Defined results: a null text or one of white space has size 0 and takes nothing; a null source is a source of its
own, last in order; repeated rows are rows of their own (a number is given to each row of equal doc_id); an empty
table gives an empty result; extra columns are ignored by mix() and kept by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, prepare, scratch

#: Characters that end a word; all others belong to words.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one fold rounds; the tree has log(n) / log(CHUNK) levels.
CHUNK = 48
#: Classes of size: of more than one part in so many of the source's words; a class has fewer documents than its number.
CLASSES = (4, 12, 40, 400)
#: Weights that sources get in their order, again and again.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MOST = 3


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a number for rows that share a doc_id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): all words shared by weight, no target above most times its source.

    Filling up in closed form: in order of most * size / weight, the first sources are held at their limit; the
    rest share what remains by weight. The first prefix after which no limit is exceeded is the answer.
    One row per source goes through the two global windows, never one per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(everything) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight)
    limit = F.col("source_size") * F.lit(float(most))
    order = W.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    held, whole = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(held), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(held), F.lit(0.0))
    )
    # level: what a unit of weight gets if all sources before this one are held at their limits.
    per = per.select("*", limit.alias("limit"), level.alias("level"), F.row_number().over(order).alias("nth"))
    free = F.col("limit") / F.col("weight") >= F.col("level")
    fair = F.min(F.when(free, F.struct("nth", "level"))).over(whole)["level"]
    target = F.least(F.col("limit"), F.coalesce(fair, F.lit(float("inf"))) * F.col("weight"))
    return per.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).select("source", "source_size", "n_docs", "weight", "target")


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """One step of the pivotal method: the survivor acc = (id, n, size, p) meets x; the one that is settled goes to out.

    With sizes s, t and fractions p, q, moving words from one to the other ends either when the first is settled or
    when the second is. Both ends are reached with the chance that leaves every expectation as it was.
    """
    s, t, p, q = acc["size"].cast("double"), x["size"].cast("double"), acc["p"], x["p"]
    give = F.least(p * s, (1 - q) * t)  # words that acc can give to x
    take = F.least((1 - p) * s, q * t)  # words that acc can take from x
    whole = F.lit(float(1 << 30))
    u = F.pmod(F.xxhash64(acc["doc_id"], acc["n"], x["doc_id"], x["n"], F.lit(seed)), F.lit(1 << 30)).cast("double") / whole
    gives = u * (give + take) < take
    p2 = F.when(gives, F.when(p * s <= (1 - q) * t, F.lit(0.0)).otherwise(p - give / s)).otherwise(
        F.when((1 - p) * s <= q * t, F.lit(1.0)).otherwise(p + take / s)
    )
    q2 = F.when(gives, F.when((1 - q) * t <= p * s, F.lit(1.0)).otherwise(q + give / t)).otherwise(
        F.when(q * t <= (1 - p) * s, F.lit(0.0)).otherwise(q - take / t)
    )
    one = lambda r, v: F.struct(r["doc_id"].alias("doc_id"), r["n"].alias("n"), r["size"].alias("size"), v.alias("p"))
    settled = (p2 <= 0.0) | (p2 >= 1.0)
    return F.struct(F.when(settled, one(x, q2)).otherwise(one(acc, p2)).alias("left"), F.when(settled, one(acc, p2)).otherwise(one(x, q2)).alias("done"))


def _fold(items: Column, seed: int) -> Column:
    """The array with settled fractions 0 or 1 for all but one item, which comes last."""
    first = F.struct(F.element_at(items, 1).alias("left"), F.slice(items, 1, 0).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        met = F.transform(F.array(x), lambda y: _meet(acc["left"], y, seed))  # a lambda's variable is evaluated once
        return F.element_at(F.transform(met, lambda m: F.struct(m["left"].alias("left"), F.concat(acc["out"], F.array(m["done"])).alias("out"))), 1)

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, step, lambda a: F.concat(a["out"], F.array(a["left"])))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 6, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (0, or 1, 2, ... for further rows of the same doc_id), source, size, source_size, target, copies, taken."""
    with scratch(prepare(docs.sparkSession)) as kept:
        mixed = materialise(_mix(docs, weights, most, seed, chunk), "mixed")
        kept.append(mixed)
    return mixed


def _mix(docs: DataFrame, weights: tuple[float, ...], most: float, seed: int, chunk: int) -> DataFrame:
    # Rows that repeat a doc_id are told apart by their count; each keeps its own copies.
    counted = sized(docs).groupBy("doc_id", "source", "size").count()
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))
    sizes = materialise(counted.select("doc_id", "source", "size", n.alias("n")), "sizes")
    key, none = F.coalesce("source", F.lit("")), F.col("source").isNull()
    goal = targets(sizes, weights, most).select(key.alias("key"), none.alias("none"), "source_size", "n_docs", "target")
    goal = materialise(goal.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    base = sizes.select("doc_id", "n", "size", key.alias("key"), none.alias("none"))
    wanted = base.join(goal, ["key", "none"]).withColumn("p", F.col("f") - F.floor("f"))
    # The fraction is the same for a whole source; documents of size 0 have nothing to move and take nothing.
    rest = (F.col("p") > 0) & (F.col("size") > 0)
    rounded = wanted.where(~rest).select("key", "none", "doc_id", "n", "size", F.lit(0).cast("long").alias("extra"))
    # Documents are settled by classes of size, the largest first. By how many words a class missed, the fraction of
    # all smaller documents is shifted, so what a source misses in the end is a part of one of its smallest documents.
    level = sum((F.col("size") * k <= F.col("source_size")).cast("int") for k in CLASSES)
    classed = materialise(wanted.where(rest).withColumn("class", level), "classed")
    present = sorted(r[0] for r in classed.select("class").distinct().collect())  # at most len(CLASSES) + 1 numbers
    missed = goal.select("key", "none", F.lit(0.0).alias("missed"))
    for c in present:
        left = classed.where(F.col("class") >= c).groupBy("key", "none").agg(F.sum("size").alias("left"))
        shift = missed.join(left, ["key", "none"]).select("key", "none", (F.col("missed") / F.col("left")).alias("shift"))
        shift = materialise(shift, "shift")  # a row per source: small enough, so the join needs no shuffle of documents
        parts = _parts(F.least(F.lit(CLASSES[c]), F.col("n_docs")) if c < len(CLASSES) else F.col("n_docs"), chunk)
        own = classed.where(F.col("class") == c).join(shift, ["key", "none"])
        now = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") - F.col("shift")))
        done = _round(own.withColumn("p", now).withColumn("parts", parts), seed + c, chunk)
        rounded = rounded.unionByName(done)
        if c != present[-1]:
            more = done.join(goal, ["key", "none"]).groupBy("key", "none").agg(F.sum(((F.col("extra") - (F.col("f") - F.floor("f"))) * F.col("size")).cast("decimal(38,9)")).cast("double").alias("more"))
            missed = missed.join(more, ["key", "none"], "left").select("key", "none", (F.col("missed") + F.coalesce("more", F.lit(0.0))).alias("missed"))
            missed = materialise(missed, "missed")
    copies = (F.floor("f") + F.col("extra")).cast("long")
    source = F.when(~F.col("none"), F.col("key")).alias("source")
    return rounded.join(goal, ["key", "none"]).select(
        "doc_id", "n", source, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _round(items: DataFrame, seed: int, chunk: int) -> DataFrame:
    """key, none, doc_id, n, size, extra: fractions p rounded to 0 or 1 by the reduction tree; parts: chunks of a source."""
    here = items.select("key", "none", "parts", F.struct("doc_id", "n", "size", "p").alias("item"))
    extra = []
    level = 0
    while True:
        # Chunks are dealt by a hash of the document, so a large source is many groups of about equal size.
        part = F.pmod(F.xxhash64("item.doc_id", "item.n", "item.size", F.lit(seed * 1000 + level)), F.col("parts"))
        shuffled = F.struct(F.xxhash64("item.doc_id", "item.n", F.lit(seed)).alias("h"), F.col("item").alias("i"))
        groups = here.groupBy("key", "none", "parts", part.alias("part")).agg(F.sort_array(F.collect_list(shuffled)).alias("items"))
        items = F.transform("items", lambda z: z["i"])
        folded = materialise(groups.select("key", "none", "parts", _fold(items, seed + level).alias("items")), "rounded")
        done = folded.select("key", "none", F.explode(F.slice("items", 1, F.size("items") - 1)).alias("item"))
        extra.append(done.select("key", "none", "item.doc_id", "item.n", "item.size", F.round("item.p").cast("long").alias("extra")))
        left = folded.select("key", "none", "parts", F.element_at("items", -1).alias("item"))
        widest = folded.agg(F.max("parts")).first()[0]
        if widest is None or widest <= 1:
            break
        here = left.withColumn("parts", _parts(F.col("parts"), chunk))
        level += 1
    # One document of each source is left with a fraction: it is rounded alone, by its own chance.
    u = F.pmod(F.xxhash64("item.doc_id", "item.n", F.lit(seed + 77)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = F.when(u < F.col("item.p"), 1).otherwise(0).cast("long").alias("extra")
    extra.append(left.select("key", "none", "item.doc_id", "item.n", "item.size", last))
    rounded = extra[0]
    for more in extra[1:]:
        rounded = rounded.unionByName(more)
    return rounded


def _parts(of: Column, chunk: int) -> Column:
    return F.ceil(of / F.lit(float(chunk))).cast("long")


def mixed_documents(docs: DataFrame, seed: int = 6) -> DataFrame:
    """The rows of docs, each as often as mix() takes it."""
    own = "_lr_size _lr_source _lr_n _lr_id".split()
    mixed = mix(docs, seed=seed)
    taken = mixed.where("copies > 0").select(
        F.col("size").alias(own[0]), F.col("source").alias(own[1]), F.col("n").alias(own[2]), F.col("doc_id").alias(own[3]), F.col("copies").alias("_lr_copies")
    )
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn(own[0], size).withColumn(own[1], F.col("source").cast("string")).withColumn(own[3], F.col("doc_id").cast("long"))
    if mixed.where("n > 0").take(1):
        same = W.partitionBy(own[3], own[1], own[0]).orderBy(F.xxhash64("text"))
        rows = rows.withColumn(own[2], (F.row_number().over(same) - 1).cast("long"))
    else:  # no row needs a number, so texts are shuffled once
        own.remove("_lr_n")
    on = [rows[c].eqNullSafe(taken[c]) if c in ("_lr_source", "_lr_id") else rows[c] == taken[c] for c in own]
    met = rows.join(taken, on)
    return met.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_lr_copies").cast("int"))).alias("_lr_k")).drop("_lr_k")
