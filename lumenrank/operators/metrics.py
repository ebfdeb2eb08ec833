"""Ranking and pair metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def per_query(ranked: DataFrame, qrels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Every ranking metric for each query that has a relevant document (in the corpus, if one is given).

    ranked: (query_id, doc_id, rank); qrels: (query_id, doc_id, rel). Gains are linear; ideal gains come from all
    relevant documents; a precision's denominator is k even for short lists; MAP@k divides by min(k, relevant).
    """
    rel = qrels.where(F.col("rel") > 0).select("query_id", "doc_id", F.col("rel").cast("double").alias("rel"))
    if corpus is not None:
        rel = rel.join(corpus.select("doc_id"), "doc_id", "left_semi")
    ideal = rel.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id")))
    gain = F.col("rel") / F.log2(F.col("i") + 1.0)
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), *[F.sum(F.when(F.col("i") <= k, gain)).alias(f"ideal{k}") for k in (10, 100)])
    hits = ranked.select("query_id", "doc_id", "rank").join(rel, ["query_id", "doc_id"])
    hits = hits.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    won = F.col("rel") / F.log2(F.col("rank") + 1.0)
    within = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0.0))
    agg = hits.groupBy("query_id").agg(
        *[within(k, won).alias(f"dcg{k}") for k in (10, 100)], *[within(k, F.lit(1.0)).alias(f"hits{k}") for k in (1, 5, 10, 100)],
        *[within(k, F.col("nth") / F.col("rank")).alias(f"ap{k}") for k in (10, 100)], F.min("rank").alias("first"),
    )
    m = ideal.join(agg, "query_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return m.select(
        "query_id", "relevant", F.coalesce("first", F.lit(0)).cast("long").alias("first_relevant_rank"),
        *[(z(f"dcg{k}") / F.col(f"ideal{k}")).alias(f"ndcg_{k}") for k in (10, 100)],
        F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0).alias("mrr_10"),
        *[(z(f"hits{k}") / k).alias(f"precision_{k}") for k in (1, 5, 10)], *[F.least(z(f"hits{k}"), F.lit(1.0)).alias(f"hit_{k}") for k in (1, 5, 10)],
        *[(z(f"ap{k}") / F.least(F.lit(k), F.col("relevant"))).alias(f"map_{k}") for k in (10, 100)],
        *[(z(f"hits{k}") / F.col("relevant")).alias(f"recall_{k}") for k in (10, 100)],
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the evaluated queries, and their number."""
    names = [c for c in metrics.columns if c not in ("query_id", "relevant", "first_relevant_rank")]
    return metrics.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])


def diagnostics(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row per query with its best k and their relevance, in rank order."""
    rows = ranked.where(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "rel"))).alias("top_k"))


def failing(metrics: DataFrame, k: int = 10) -> DataFrame:
    """Queries without a relevant document among the first k."""
    return metrics.where((F.col("first_relevant_rank") == 0) | (F.col("first_relevant_rank") > k))


def pair_eval(pairs: DataFrame) -> DataFrame:
    """pairs (score, target): mean score of either side, margin, and how often the sign is right."""
    pos = F.col("target") > 0
    right = F.when(pos, F.col("score") > 0).otherwise(F.col("score") < 0)
    mean = lambda c: F.avg(F.when(c, F.col("score")))
    return pairs.agg(mean(pos).alias("mean_positive"), mean(~pos).alias("mean_negative"), (mean(pos) - mean(~pos)).alias("margin"), F.avg(right.cast("double")).alias("accuracy"))


def roc_auc(pairs: DataFrame) -> DataFrame:
    """Mann-Whitney with mean ranks for ties: counted per distinct score, and summed up by ranges of scores."""
    from .ordering import running

    per = running(pairs.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("target") > 0).alias("p")), "score", ["n"])
    ranks = per.withColumn("rank", F.col("n_below") + (F.col("n") + 1) / 2.0)
    t = ranks.agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    auc = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.greatest(F.col("p") * F.col("q"), F.lit(1)))
    return t.select(F.when((F.col("p") == 0) | (F.col("q") == 0), 0.0).otherwise(F.least(F.greatest(auc, F.lit(0.0)), F.lit(1.0))).alias("auc"))


def best_threshold(pairs: DataFrame) -> DataFrame:
    """The highest score that, taken as the least of the positive side, is right most often; all-negative is the start."""
    from .ordering import running

    per = pairs.groupBy("score").agg(F.count_if(F.col("target") > 0).alias("p"), F.count_if(F.col("target") <= 0).alias("q"))
    # Right are the positives from a score on, all less those below it, and the negatives below it.
    per = running(per, "score", ["p", "q"]).withColumn("gain", F.col("q_below") - F.col("p_below"))
    best = per.agg(F.max(F.struct("gain", "score")).alias("b"), F.max("score").alias("top"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    right = F.col("b.gain") + F.col("p")
    threshold = F.when(right > F.col("q"), F.col("b.score")).otherwise(F.col("top"))
    return best.select(threshold.alias("threshold"), (F.greatest(right, F.col("q")) / (F.col("p") + F.col("q"))).alias("accuracy"))


def grouped_rank(pairs: DataFrame) -> DataFrame:
    """rank of a query's best positive: 1 + negatives strictly above it; shares of 1, 5, 10, MRR and the mean."""
    best = pairs.groupBy("query_id").agg(F.max(F.when(F.col("target") > 0, F.col("score"))).alias("best"))
    rank = pairs.join(best.where("best is not null"), "query_id").groupBy("query_id").agg((1 + F.count_if((F.col("target") <= 0) & (F.col("score") > F.col("best")))).alias("rank"))
    share = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}")
    return rank.agg(F.count("*").alias("queries"), share(1), share(5), share(10), F.avg(1 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"))


def movement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How vectors (id, v) moved between two caches."""
    from ..functions import vectors as V

    m = a.select("id", F.col("v").alias("x")).join(b.select("id", F.col("v").alias("y")), "id")
    cos, l2 = V.cosine(F.col("x"), F.col("y")), V.l2_distance(F.col("x"), F.col("y"))
    largest = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p.cast("double") - q.cast("double"))))
    m = m.select(cos.alias("c"), l2.alias("d"), largest.alias("m"))
    return m.agg(F.count("*").alias("n"), F.avg("c").alias("mean_cosine"), F.min("c").alias("min_cosine"), F.avg("d").alias("mean_l2"), F.max("d").alias("max_l2"), F.max("m").alias("max_abs"), F.count_if(F.col("m") > 0).alias("changed"))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at place ceil(share * n) of the sorted values."""
    return F.percentile_disc(share, values) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {values})")


def deciles(values: DataFrame, column: str) -> DataFrame:
    """decile 1 to 9 and the value at place floor(d n / 10), counted from 0."""
    from .ordering import place

    n = values.agg(F.count("*").alias("n"))
    asked = n.select(F.explode(F.sequence(F.lit(1), F.lit(9))).alias("decile"), "n")
    at = place(values.select(F.col(column).alias("value")), F.col("value"), [], "i")
    asked = asked.select("decile", F.floor(F.col("decile") * F.col("n") / 10).alias("i"))  # nine rows
    return at.join(F.broadcast(asked), "i").select(F.col("decile").cast("long").alias("decile"), "value")


# --- losses (forward values) ---------------------------------------------------------------------------------------


def info_nce(scores: DataFrame, group: str, temperature: float = 0.05, least: int = 1) -> DataFrame:
    """(group, loss): -ln of the softmax share of the target among a group's scores (score, is_target).

    Groups of fewer than `least` candidates have no row: with 2, a positive without a negative doesn't count.
    """
    t = temperature if temperature > 0 else 0.05
    q = W.partitionBy(group)
    if least > 1:
        scores = scores.withColumn("_n", F.count("*").over(q)).where(F.col("_n") >= least).drop("_n")
    e = scores.withColumn("e", F.exp((F.col("score") - F.max("score").over(q)) / t))
    share = e.withColumn("p", F.col("e") / F.sum("e").over(q)).where("is_target")
    return share.select(group, (-F.ln(F.greatest(F.col("p"), F.lit(1e-12)))).alias("loss"))


def hard_negative_scores(anchors: DataFrame, candidates: DataFrame, batch: list[str]) -> tuple[DataFrame, DataFrame]:
    """Scores (q, score, is_target) of hard-negative groups: against all candidates of the batch, and against their own.

    anchors: (batch, q, x); candidates: (batch, q, slot, y), slot 0 being the positive and the others the negatives of q.
    """
    from ..functions import vectors as V

    a, c = anchors.select(*batch, "q", "x"), candidates.select(*batch, F.col("q").alias("own"), "slot", "y")
    m = a.join(c, batch).select("q", "own", "slot", V.cosine(F.col("x"), F.col("y")).alias("score"))
    m = m.withColumn("is_target", (F.col("q") == F.col("own")) & (F.col("slot") == 0))
    return m.select("q", "score", "is_target"), m.where("q = own").select("q", "score", "is_target")


def hybrid_info_nce(whole: DataFrame, grouped: DataFrame, group: str, weight: float = 0.25, temperature: float = 0.05, least: int = 1) -> DataFrame:
    """(whole, grouped, hybrid): mean losses over all candidates and within groups, and whole + weight * grouped."""
    w = info_nce(whole, group, temperature).agg(F.avg("loss").alias("whole"))
    g = info_nce(grouped, group, temperature, least).agg(F.avg("loss").alias("grouped"))
    both = w.crossJoin(F.broadcast(g))  # one row each
    return both.withColumn("hybrid", F.col("whole") + weight * F.coalesce("grouped", F.lit(0.0)))


def teacher_loss(candidates: DataFrame, group: str, temperature: float = 1.0, model_temperature: float | None = None) -> DataFrame:
    """(group, loss): cross-entropy of the model's softmax (score) under the teacher's (teacher).

    Columns `teacher_temperature` and `weight` hold for the rows of a group (one value for each): a temperature of 0 or
    less is the general one, groups of weight 0 or less, of fewer than two candidates or without complete teacher scores
    have no row.
    """
    q = W.partitionBy(group)
    soft = lambda c, t: F.exp((F.col(c) - F.max(c).over(q)) / t)
    own, weight = F.lit(temperature), F.lit(1.0)
    rows = candidates.withColumn("_n", F.count("*").over(q)).withColumn("_t", F.count("teacher").over(q)).where("_n >= 2 and _t = _n")
    if "teacher_temperature" in candidates.columns:
        own = F.when(F.col("teacher_temperature") > 0, F.col("teacher_temperature")).otherwise(F.lit(temperature))
    if "weight" in candidates.columns:
        weight, rows = F.col("weight"), rows.where("weight > 0")
    e = rows.withColumn("m", soft("score", F.lit(temperature if model_temperature is None else model_temperature))).withColumn("t", soft("teacher", own))
    e = e.withColumn("pm", F.col("m") / F.sum("m").over(q)).withColumn("pt", F.col("t") / F.sum("t").over(q))
    return e.groupBy(group).agg(F.sum(-weight * F.col("pt") * F.ln(F.greatest(F.col("pm"), F.lit(1e-12)))).alias("loss"))


def quantized_prefix(rows: DataFrame, vector: str, dims: int, bits: int, seed: int = 1) -> DataFrame:
    """rows (id, vector) with the first dims components coded and decoded, at the length that they had."""
    from .ranking import coded_vectors, decoded_vectors

    coded = coded_vectors(rows.select("id", F.slice(vector, 1, dims).alias("y")), bits, seed, key="id")
    return rows.drop(vector).join(decoded_vectors(coded, bits, seed, key="id").withColumnRenamed("vector", vector), "id")


def throughput(rows: DataFrame, counts: list[str], seconds: str) -> DataFrame:
    """rows with <count>_per_second; 0 where no time passed."""
    took = F.col(seconds).cast("double")
    return rows.withColumns({f"{c}_per_second": F.when(took > 0, F.col(c) / F.when(took > 0, took).otherwise(1.0)).otherwise(0.0) for c in counts})


def rank_margin(candidates: DataFrame, group: str, margin: float) -> DataFrame:
    """(group, loss): half the squared hinge on the hardest negative that the teacher puts below the positive."""
    pos = F.max(F.when(F.col("is_target"), F.col("score"))).over(W.partitionBy(group))
    teacher = F.max(F.when(F.col("is_target"), F.col("teacher"))).over(W.partitionBy(group))
    c = candidates.withColumn("pos", pos).withColumn("tpos", teacher)
    hardest = F.max(F.when(~F.col("is_target") & (F.col("teacher") < F.col("tpos")), F.col("score")))
    g = c.groupBy(group).agg(F.max("pos").alias("pos"), hardest.alias("neg"))
    gap = F.greatest(F.lit(0.0), margin - (F.col("pos") - F.col("neg")))
    return g.select(group, F.coalesce(0.5 * gap * gap, F.lit(0.0)).alias("loss"))
