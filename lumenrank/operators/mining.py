"""Training sets from rankings and judgements: negatives, pairs, splits, samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import materialise

#: Runs of items that are sent to all executors: some 20 MB.
ASKED_RUNS = 300_000


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Of rows with equal keys the one that comes last."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def corpus_cap(corpus: DataFrame, relevant: DataFrame, cap: int, order: str = "doc_id") -> DataFrame:
    """All relevant documents, even past the cap, then others in file order up to it."""
    from .ordering import place

    marked = corpus.join(relevant.select("doc_id").distinct().withColumn("_rel", F.lit(True)), "doc_id", "left")
    n = relevant.select("doc_id").distinct().join(corpus, "doc_id", "left_semi").count()
    # Only others are numbered, and no more of them than the cap leaves room for are kept.
    others = place(marked.where("_rel is null"), F.col(order), [], "_i").where(F.col("_i") < max(0, cap - n)).drop("_i", "_rel")
    return marked.where("_rel").drop("_rel").unionByName(others)


def positives_per_query(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id, rel, nth): relevant documents with text by (rel desc, id)."""
    kept = qrels.where("rel > 0").join(corpus.where(F.length(F.trim("text")) > 0).select("doc_id"), "doc_id", "left_semi")
    return kept.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id")).cast("long"))


def hard_negatives(ranked: DataFrame, positives: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(query_id, doc_id, score, nth): the best n ranked documents that aren't positive, one for each trimmed text."""
    free = ranked.join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    t = free.join(docs.select("doc_id", F.trim("text").alias("t")), "doc_id").where("t <> ''")
    t = t.withColumn("d", F.row_number().over(W.partitionBy("query_id", "t").orderBy("rank"))).where("d = 1")
    return t.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long")).where(F.col("nth") <= n).select("query_id", "doc_id", "score", "nth")


def reason(rank: Column, compact_rank: Column, k: int = 10, edge: int = 100) -> Column:
    """Why a compact ranking's document is a negative."""
    return F.when(rank <= k, "top10").when((compact_rank > edge) | (rank > edge - k), "rank_boundary").otherwise("compact")


def refuse_test_split(split: str, select: str) -> None:
    if select == "train" and split.strip().lower() == "test":
        raise ValueError("training rows may not be mined from a test split")


def overlapping(docs: DataFrame, items: DataFrame, words: int = 5, share: float = 0.5) -> DataFrame:
    """(query_id, doc_id): documents (doc_id, text) that hold at least a share of an item's (query_id, text) different runs of words.

    The items' runs are the small side: up to ASKED_RUNS of them are sent to the documents and looked up word by word where a
    text stands, so only runs that meet one go on; beyond, runs are compared by 64-bit hashes in a join. A text of fewer
    words is one run.
    """
    from ..functions import text as X
    from . import lexical
    from .ordering import spread

    def cut(rows: DataFrame, key: str, run) -> DataFrame:
        t = rows.select(key, X.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
        starts = F.sequence(F.lit(1), F.greatest(F.size("t") - (words - 1), F.lit(1)))
        return t.select(key, F.explode(F.transform(starts, lambda i: run(F.slice("t", i, F.lit(words))))).alias("run"))

    def counted(met: DataFrame, asked: DataFrame) -> DataFrame:
        many = asked.groupBy("query_id").agg(F.count("*").alias("n"))
        return met.distinct().groupBy("query_id", "doc_id").agg(F.count("*").alias("held")).join(many, "query_id").where(F.col("held") >= F.col("n") * share).select("query_id", "doc_id")

    docs = docs.select("doc_id", "text")
    told = cut(items, "query_id", lambda r: r).distinct().limit(ASKED_RUNS + 1).toArrow()
    if told.num_rows > ASKED_RUNS:
        asked = cut(items, "query_id", F.xxhash64).distinct()
        return counted(cut(docs, "doc_id", F.xxhash64).join(asked, "run"), asked)
    texts = [tuple(r) for r in told["run"].to_pylist()]
    number = {r: i for i, r in enumerate(dict.fromkeys(texts))}
    pairs = pa.table({"query_id": told["query_id"], "run": pa.array([number[r] for r in texts], pa.int64())})
    asked = docs.sparkSession.createDataFrame(pairs, f"query_id {items.schema['query_id'].dataType.simpleString()}, run long")
    tokens = spread(docs).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return counted(lexical.held_runs(tokens, [list(r) for r in number], words).join(asked, "run"), asked)


#: Steps of a walk over the corpus; one that doesn't divide its size visits every document.
STEPS = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099)


def sampled_negatives(queries: DataFrame, corpus: DataFrame, labelled: DataFrame, n: int, seed: str) -> DataFrame:
    """(query_id, doc_id, nth): n documents per query that aren't labelled for it (all there are, if these are fewer).

    A query walks the corpus from a hashed start in steps of a hashed prime that does not divide the corpus's size: each
    place is as likely as any other, none comes twice, and among the first n + b places, for b labelled documents, n
    are free. So a query is joined with n + b documents only.
    """
    from .ordering import place

    total = corpus.count()
    steps = [p for p in STEPS if total % p]
    held = labelled.groupBy("query_id").agg(F.count("*").alias("b"))
    digits = lambda k: F.conv(F.substring(hash_order(f"{seed}:{k}", F.col("query_id")), 1, 15), 16, 10).cast("long")
    asked = queries.select("query_id").distinct().join(held, "query_id", "left")
    looks = F.least(F.lit(n) + F.coalesce("b", F.lit(0)), F.lit(total)).cast("int")
    asked = asked.select("query_id", (digits("start") % max(1, total)).alias("start"), F.get(F.array(*[F.lit(p) for p in steps]), (digits("step") % len(steps)).cast("int")).alias("step"), looks.alias("looks"))
    asked = asked.where("looks > 0").select("query_id", "start", "step", F.explode(F.sequence(F.lit(0), F.col("looks") - 1)).alias("k"))
    asked = asked.select("query_id", "k", F.pmod(F.col("start") + F.col("k") * F.col("step").cast("long"), F.lit(total)).alias("i"))
    ring = place(corpus.select("doc_id"), F.col("doc_id"), [], "i")
    met = asked.join(ring, "i").join(labelled.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("k"))
    return met.withColumn("nth", nth.cast("long")).where(F.col("nth") <= n).select("query_id", "doc_id", "nth")


def fnv64a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a string's UTF-8 bytes, as a decimal number. Words of 32 bits, so nothing overflows."""
    digits = F.hex(text.cast("binary"))
    octets = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    octets = F.when(F.length(digits) > 0, octets).otherwise(F.array().cast("array<long>"))
    word = (1 << 32) - 1
    # The offset basis 14695981039346656037 and the prime 2^40 + 435.
    first = F.struct(F.lit(14695981039346656037 >> 32).alias("hi"), F.lit(14695981039346656037 & word).alias("lo"))

    def step(h: Column, octet: Column) -> Column:
        low = h["lo"].bitwiseXOR(octet)
        lo = low * 435
        hi = h["hi"] * 435 + F.shiftleft(low.bitwiseAND((1 << 24) - 1), 8) + F.shiftright(lo, 32)
        return F.struct(hi.bitwiseAND(word).alias("hi"), lo.bitwiseAND(word).alias("lo"))

    wide = lambda c: c.cast("decimal(20,0)")
    return F.aggregate(octets, first, step, lambda h: (wide(h["hi"]) * F.lit(1 << 32).cast("decimal(11,0)") + wide(h["lo"])).cast("decimal(20,0)"))


def hash_started_negatives(pairs: DataFrame, corpus: DataFrame, dataset: str, offset: int = 0) -> DataFrame:
    """(query_id, positive_id, doc_id) for each pair (query_id, positive_id): the first document from a hashed start on,
    in the order of ids and round the end, that is no positive of the query; none if all are.

    The start is the FNV-1a hash of dataset, query and positive, parted by zero bytes, modulo the corpus's size. A query's
    positives stand in runs of places that follow each other, and each place knows where its run ends, so a pair whose start is
    taken goes on behind that run at once: a row a pair, however many positives a query has. At most b + 1 places are passed,
    for b positives.
    """
    from .ordering import place

    total = corpus.count()
    key = F.concat_ws("\0", F.lit(dataset), F.col("query_id").cast("string"), F.col("positive_id").cast("string"))
    start = F.pmod(fnv64a(key), F.lit(max(1, total)).cast("decimal(20,0)")).cast("long")
    pairs = materialise(pairs.select("query_id", "positive_id").distinct().withColumn("start", F.pmod(start + offset, F.lit(max(1, total)))), "pairs")
    ring = materialise(place(corpus.select("doc_id"), F.col("doc_id"), [], "i").select("doc_id", "i"), "ring")
    taken = pairs.select("query_id", F.col("positive_id").alias("doc_id")).join(ring, "doc_id").select("query_id", "i")
    back = W.partitionBy("query_id").orderBy(F.col("i").desc())
    ends = F.when(F.coalesce(F.lag("i").over(back) != F.col("i") + 1, F.lit(True)), F.col("i"))
    taken = taken.withColumn("end", ends).withColumn("free", F.last("end", True).over(back.rowsBetween(W.unboundedPreceding, 0)) + 1).drop("end")
    taken = materialise(taken, "taken")
    first = taken.where("i = 0").select("query_id", F.col("free").alias("first"))  # where a search goes on that is round the end
    per = pairs.groupBy("query_id").agg(F.count("*").alias("b")).join(first, "query_id", "left")
    met = pairs.join(taken.withColumnRenamed("i", "start"), ["query_id", "start"], "left").join(per, "query_id")
    ahead = F.coalesce("free", "start")
    met = met.select("query_id", "positive_id", "b", "start", F.when(ahead < total, ahead).otherwise(F.coalesce("first", F.lit(0))).alias("i"))
    met = met.where((F.col("i") < total) & (F.pmod(F.col("i") - F.col("start"), F.lit(max(1, total))) <= F.col("b")))
    return met.join(ring, "i").select("query_id", "positive_id", "doc_id")


def hash_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary"), 256)


def hash_split(rows: DataFrame, key: str, seed: str, parts: list[tuple[str, float]]) -> DataFrame:
    """rows with `split`: the order of sha256(seed:key) cut at the given shares. A row's place is its hash as a share of
    the whole range, so no order is built; shares hold as the law of large numbers has it."""
    u = F.conv(F.substring(hash_order(seed, F.col(key)), 1, 8), 16, 10).cast("long") / float(1 << 32)
    at, split = 0.0, None
    for name, share in parts:
        at += share
        split = F.when(u < at, name) if split is None else split.when(u < at, name)
    return rows.withColumn("split", split.otherwise(parts[-1][0]))


def ordered_split(rows: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """rows with `split`: exactly the first floor(share * n) keys (at least 1, at most n - 1) in hash order are "train"."""
    from .ordering import place

    keys = rows.select(key).distinct()
    n = keys.count()
    cut = min(max(1, int(share * n)), max(1, n - 1))
    u = F.conv(F.substring(hash_order(seed, F.col(key)), 1, 8), 16, 10).cast("long")
    placed = place(keys, u, [hash_order(seed, F.col(key))], "_i").withColumn("split", F.when(F.col("_i") < cut, "train").otherwise("eval"))
    return rows.join(placed.select(key, "split"), key)


def group_hard_negatives(pairs: DataFrame, per_positive: int) -> DataFrame:
    """(query, positive, negatives): pairs (query, text, label, pos) by query; the j-th negative of the i-th positive is (i + j) mod n."""
    p = pairs.where("label > 0").withColumn("i", F.row_number().over(W.partitionBy("query").orderBy("pos")) - 1).select("query", F.col("text").alias("positive"), "i")
    n = pairs.where("label <= 0").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("n"))
    m = p.join(n, "query")
    take = F.sequence(F.lit(0), F.least(F.size("n"), F.lit(per_positive)) - 1)
    return m.select("query", "positive", F.transform(take, lambda j: F.get("n", ((F.col("i") + j) % F.size("n")).cast("int"))["text"]).alias("negatives"))


def flatten_hard_negatives(groups: DataFrame) -> DataFrame:
    """(query, text, label): a positive and a negative pair for each negative."""
    e = groups.select("query", "positive", F.explode("negatives").alias("negative"))
    return e.select("query", F.col("positive").alias("text"), F.lit(1).alias("label")).unionByName(e.select("query", F.col("negative").alias("text"), F.lit(0).alias("label")))


def boundary_losses(ranked: DataFrame, positives: DataFrame, lo: int, hi: int, n: int) -> DataFrame:
    """(query_id, positive_id, doc_id, nth): what ranks above a positive lost between lo and hi: the window first, then earlier ranks."""
    lost = ranked.join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").where((F.col("rank") > lo) & (F.col("rank") <= hi))
    lost = lost.groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("positive_id"), F.min("rank").alias("at"))
    free = ranked.join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    above = free.join(lost, "query_id").where(F.col("rank") < F.col("at"))
    order = W.partitionBy("query_id").orderBy((F.col("rank") <= lo).cast("int"), "rank")
    return above.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= n).select("query_id", "positive_id", "doc_id", "nth")


def quality_frontier(model: DataFrame, teacher: DataFrame, gap: float) -> DataFrame:
    """Queries where the teacher's ndcg leads by the gap, with their place by (gap, rank improvement)."""
    m = model.select("query_id", F.col("ndcg_10").alias("model"), F.col("first_relevant_rank").alias("model_rank"))
    t = teacher.select("query_id", F.col("ndcg_10").alias("teacher"), F.col("first_relevant_rank").alias("teacher_rank"))
    f = m.join(t, "query_id").withColumn("gap", F.round(F.col("teacher") - F.col("model"), 6)).where(F.col("gap") >= gap)
    better = F.when(F.col("model_rank") == 0, 1000).otherwise(F.col("model_rank")) - F.when(F.col("teacher_rank") == 0, 1000).otherwise(F.col("teacher_rank"))
    return f.select("query_id", "gap", better.cast("long").alias("improvement"))


def curate_frontier(rows: DataFrame, cap: int) -> DataFrame:
    """(query_id, positive, negatives): rows merged by (query_id, positive), different negatives in order, at most cap."""
    e = rows.select("query_id", "positive", "pos", F.posexplode("negatives").alias("k", "negative"))
    first = e.groupBy("query_id", "positive", "negative").agg(F.min(F.struct("pos", "k")).alias("at"))
    nth = F.row_number().over(W.partitionBy("query_id", "positive").orderBy("at"))
    kept = first.withColumn("n", nth).where(F.col("n") <= cap)
    return kept.groupBy("query_id", "positive").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "negative"))), lambda x: x["negative"]).alias("negatives"))


def resolve_texts(rows: DataFrame, corpus: DataFrame, unique: bool = False) -> DataFrame:
    """rows (text, ...) with doc_id: the first id of equal texts, or none where a text is ambiguous (unique)."""
    by = corpus.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    by = by.where("n = 1") if unique else by
    return rows.join(by.drop("n"), "text", "left")


def without_leaks(rows: DataFrame, test_ids: DataFrame, ids: list[str]) -> DataFrame:
    """rows none of whose ids occur in the test split."""
    for c in ids:
        rows = rows.join(test_ids.select(F.col("id").alias(c)).distinct(), c, "left_anti")
    return rows
