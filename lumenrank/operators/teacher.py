"""Teacher scores of candidates: requests, import, audit, filter, normalisation, relabelling, agreement.

Candidates are rows (example, source, query, slot, text, score): slot 0 is the positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _example():
    return W.partitionBy("example")



def requests(groups: DataFrame, missing_only: bool = False, most: int | None = None) -> DataFrame:
    """(example, source, query, slot, role, text) of groups (example, source, query, positive, negatives, teacher_scores).

    missing_only: of examples without scores. most: of the first so many of those that are asked for, by example.
    """
    g = groups.where(F.coalesce(F.size("teacher_scores"), F.lit(0)) <= 0) if missing_only else groups
    if most is not None:
        if most < 1:
            raise ValueError("a maximum is at least 1")
        g = g.orderBy("example").limit(most)
    e = g.select("example", "source", "query", F.posexplode(F.concat(F.array("positive"), "negatives")).alias("slot", "text"))
    return e.withColumn("role", F.when(F.col("slot") == 0, "positive").otherwise("negative"))


def import_scores(candidates: DataFrame, scores: DataFrame, overwrite: bool = True, allow_missing: bool = True) -> DataFrame:
    """candidates with score from rows of (source, query, text, score) or (source, query, scores), keys compared trimmed.

    A vector of scores for the example comes first (its source, then a blank one); it must be as long as the example has
    candidates, or the example gets none. Without one each candidate is looked up in the same way, and an example gets
    all its scores or none. Examples that have scores keep them unless overwrite; an example without complete scores
    keeps what it has, or fails the read unless allow_missing.
    """
    if "scores" not in scores.columns:
        scores = scores.withColumn("scores", F.lit(None).cast("array<double>"))
    held = candidates if "score" in candidates.columns else candidates.withColumn("score", F.lit(None).cast("double"))
    n, whole = F.count("*").over(_example()), lambda c: F.count(c).over(_example()) == F.count("*").over(_example())
    rows = held.select("*", F.trim("source").alias("_s"), F.trim("query").alias("_q"), F.trim("text").alias("_t"), F.col("score").alias("_old"), n.alias("_n")).drop("score")
    keys = scores.select(F.trim(F.coalesce("source", F.lit(""))).alias("_s"), F.trim("query").alias("_q"), F.trim("text").alias("_t"), "score", "scores")
    vectors, single = keys.where("scores is not null"), keys.where("scores is null")
    blank = F.col("_s") == ""
    rows = rows.join(vectors.select("_s", "_q", F.col("scores").alias("_v1")), ["_s", "_q"], "left").join(vectors.where(blank).select("_q", F.col("scores").alias("_v2")), "_q", "left")
    rows = rows.join(single.select("_s", "_q", "_t", F.col("score").alias("_c1")), ["_s", "_q", "_t"], "left").join(single.where(blank).select("_q", "_t", F.col("score").alias("_c2")), ["_q", "_t"], "left")
    vector = F.coalesce("_v1", "_v2")
    found = F.when(vector.isNotNull(), F.when(F.size(vector) == F.col("_n"), F.get(vector, F.col("slot").cast("int")))).otherwise(F.coalesce("_c1", "_c2"))
    rows = rows.withColumn("_found", found.cast("double"))
    rows = rows.withColumn("_has", whole("_old")).withColumn("_whole", whole("_found"))
    missing = F.col("_old") if allow_missing else F.raise_error(F.concat(F.lit("an example has candidates without a score: "), F.col("_s"), F.lit(" "), F.col("_q"))).cast("double")
    kept = F.lit(False) if overwrite else F.col("_has")
    return rows.withColumn("score", F.when(kept, F.col("_old")).when(F.col("_whole"), F.col("_found")).otherwise(missing)).select(*candidates.drop("score").columns, "score")


def assert_unique(scores: DataFrame, keys: list[str]) -> DataFrame:
    """scores, failing when it is read if keys repeat or a score isn't finite."""
    n = F.count("*").over(W.partitionBy(*keys))
    bad = (n > 1) | F.isnan("score") | (F.abs("score") == float("inf"))
    return scores.withColumn("_ok", F.when(bad, F.raise_error(F.lit("duplicate key or score that isn't finite"))).otherwise(F.lit(True))).where("_ok").drop("_ok")


def per_example(candidates: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(example, source, rank, top1, margin, range, entropy, entropy_share): ties with the best count as first."""
    pos = F.max(F.when(F.col("slot") == 0, F.col("score"))).over(_example())
    e = candidates.withColumn("pos", pos).withColumn("x", F.exp((F.col("score") - F.max("score").over(_example())) / temperature))
    e = e.withColumn("p", F.col("x") / F.sum("x").over(_example()))
    neg = F.when(F.col("slot") > 0, F.col("score"))
    a = e.groupBy("example", "source").agg(
        F.max("pos").alias("pos"), F.max(neg).alias("neg"), (1 + F.count_if((F.col("slot") > 0) & (F.col("score") > F.col("pos")))).alias("rank"),
        (F.max("score") - F.min("score")).alias("range"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("entropy"), F.count("*").alias("n"),
    )
    share = F.when(F.col("n") > 1, F.col("entropy") / F.ln(F.greatest(F.col("n"), F.lit(2)).cast("double"))).otherwise(0.0)
    return a.select("example", "source", "rank", (F.col("rank") == 1).alias("top1"), (F.col("pos") - F.col("neg")).alias("margin"), "range", "entropy", share.alias("entropy_share"))


def audit(candidates: DataFrame) -> DataFrame:
    """Means over all examples (source null) and over each source's."""
    e = per_example(candidates)
    return e.rollup("source").agg(
        F.grouping("source").cast("long").alias("is_total"), F.count("*").alias("examples"), F.avg(F.col("top1").cast("double")).alias("top1_rate"), F.avg("rank").alias("mean_rank"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("margin", "range", "entropy", "entropy_share")],
    )


def keep(candidates: DataFrame, top1: bool = False, least_margin: float | None = None, most_entropy: float | None = None) -> DataFrame:
    """Candidates of the examples that meet all conditions."""
    e = per_example(candidates)
    c = F.lit(True)
    if top1:
        c = c & F.col("top1")
    if least_margin is not None:
        c = c & (F.col("margin") >= least_margin)
    if most_entropy is not None:
        c = c & (F.col("entropy") <= most_entropy)
    return candidates.join(e.where(c).select("example"), "example", "left_semi")


def judged(candidates: DataFrame, top1: bool = False, least_margin: float = float("-inf"), most_entropy_share: float = 0.0, temperature: float = 1.0) -> DataFrame:
    """(example, scored, top1, margin, passes): an example without scores passes; one without negatives has margin 0."""
    has = candidates.groupBy("example").agg((F.count("score") > 0).alias("scored"), F.count("*").alias("candidates"))
    e = has.join(per_example(candidates.where("score is not null"), temperature), "example", "left").withColumn("margin", F.coalesce("margin", F.lit(0.0)))
    ok = F.col("margin") >= least_margin
    if top1:
        ok = ok & F.col("top1")
    if most_entropy_share > 0:
        ok = ok & (F.col("entropy_share") <= most_entropy_share)
    return e.select("example", "scored", "candidates", "top1", "margin", (~F.col("scored") | F.coalesce(ok, F.lit(False))).alias("passes"))


def filter_scores(candidates: DataFrame, judgement: DataFrame, drop: bool = False) -> DataFrame:
    """candidates of the examples that don't pass judged() without their scores, or without the examples (drop)."""
    met = candidates.join(judgement.select("example", "passes"), "example")
    if drop:
        return met.where("passes").drop("passes")
    return met.withColumn("score", F.when(F.col("passes"), F.col("score"))).drop("passes")


def filter_summary(judgement: DataFrame, drop: bool = False) -> DataFrame:
    """One row: examples and candidates, how many had scores, kept, lost them or went, and top-1 share and margin before and after."""
    kept, scored = F.col("scored") & F.col("passes"), F.col("scored")
    count, mean = (lambda c: F.count_if(c)), (lambda c, v: F.coalesce(F.avg(F.when(c, v)), F.lit(0.0)))
    failing = F.count_if(scored & ~F.col("passes"))
    hit = F.col("top1").cast("double")
    return judgement.agg(
        F.count("*").alias("examples"), F.sum("candidates").alias("candidates"), count(~scored).alias("missing"), count(scored).alias("scored"), count(kept).alias("kept"),
        (F.lit(0).cast("long") if drop else failing).alias("cleared"), (failing if drop else F.lit(0).cast("long")).alias("dropped"),
        mean(scored, hit).alias("top1_before"), mean(kept, hit).alias("top1_after"), mean(scored, F.col("margin")).alias("margin_before"), mean(kept, F.col("margin")).alias("margin_after"),
    )


def with_pool(relabelled: DataFrame, pool: DataFrame, least: int) -> DataFrame:
    """(query, positive, negatives): the pairs of relabel() with their kept negatives, filled up to `least` from the query's pool."""
    kept = relabelled.where("action = 'kept'").groupBy("example").agg(F.array_sort(F.collect_set(F.struct("slot", "text"))).alias("own"))
    more = pool.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("pool"))
    pairs = relabelled.where(F.col("action").isin("original", "promoted")).select("example", "slot", "query", F.col("text").alias("positive"))
    m = pairs.join(kept, "example", "left").join(more, "query", "left")
    texts = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: x["text"])
    own = F.filter(F.array_distinct(texts("own")), lambda x: x != F.col("positive"))
    spare = F.filter(F.array_except(texts("pool"), own), lambda x: x != F.col("positive"))
    filled = F.concat(own, F.slice(spare, F.lit(1), F.greatest(F.lit(0), F.lit(least) - F.size(own))))
    return m.select("example", "slot", "query", "positive", filled.alias("negatives"))


def normalize(candidates: DataFrame, mode: str) -> DataFrame:
    """score as z-score within source, family (the source up to a colon), or example; a variance below 1e-12 divides by 1."""
    if mode == "none":
        return candidates
    key = {"source": F.col("source"), "family": F.substring_index("source", ":", 1), "example": F.col("example")}[mode]
    g = candidates.withColumn("_g", key).groupBy("_g").agg(F.avg("score").alias("_m"), F.var_pop("score").alias("_v"), F.stddev_pop("score").alias("_s"))
    sd = F.when(F.col("_v") < 1e-12, 1.0).otherwise(F.col("_s"))
    return candidates.withColumn("_g", key).join(g, "_g").withColumn("score", (F.col("score") - F.col("_m")) / sd).drop("_g", "_m", "_v", "_s")


def relabel(candidates: DataFrame, promote_at: float, slack: float, keep_at: float, cap: int) -> DataFrame:
    """candidates with action: original, promoted (score >= promote_at and >= positive - slack, best cap), kept (<= keep_at) or dropped."""
    pos = F.max(F.when(F.col("slot") == 0, F.col("score"))).over(_example())
    able = (F.col("slot") > 0) & (F.col("score") >= promote_at) & (F.col("score") >= F.col("pos") - slack)
    c = candidates.withColumn("pos", pos).withColumn("able", able)
    nth = F.row_number().over(_example().orderBy(F.col("able").desc(), F.col("score").desc(), "slot"))
    c = c.withColumn("nth", nth)
    action = F.when(F.col("slot") == 0, "original").when(F.col("able") & (F.col("nth") <= cap), "promoted").when(~F.col("able") & (F.col("score") <= keep_at), "kept").otherwise("dropped")
    return c.withColumn("action", action).drop("pos", "able", "nth")


def relabelled_pairs(relabelled: DataFrame) -> DataFrame:
    """(query, positive, origin): originals first, then promoted, each (query, positive) once."""
    p = relabelled.where(F.col("action").isin("original", "promoted"))
    order = W.partitionBy("query", "text").orderBy((F.col("action") == "promoted").cast("int"), "example", "slot")
    return p.withColumn("n", F.row_number().over(order)).where("n = 1").select("query", F.col("text").alias("positive"), F.col("action").alias("origin"))


def negative_pool(candidates: DataFrame, most: float) -> DataFrame:
    """(query, text, score, nth): negatives that score no more than `most`, each text once (the first), by score."""
    n = candidates.where((F.col("slot") > 0) & (F.col("score") <= most))
    first = n.withColumn("d", F.row_number().over(W.partitionBy("query", "text").orderBy("example", "slot"))).where("d = 1")
    return first.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy("score", "example", "slot")).cast("long")).select("query", "text", "score", "nth")


def agreement(teachers: list[DataFrame], least_margin: float) -> DataFrame:
    """(example, slot, score): mean scores of the examples in which every teacher's margin is large enough."""
    kept = None
    for t in teachers:
        ok = per_example(t).where(F.col("margin") >= least_margin).select("example")
        kept = ok if kept is None else kept.join(ok, "example", "left_semi")
    rows = None
    for t in teachers:
        part = t.select("example", "slot", "score")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(kept, "example", "left_semi").groupBy("example", "slot").agg(F.avg("score").alias("score"))


def bridge_dedup(rows: DataFrame, longest: int = 8000) -> DataFrame:
    """(query, candidate, score): the highest score of each pair, texts cut to so many characters."""
    cut = rows.select(F.substring("query", 1, longest).alias("query"), F.substring("candidate", 1, longest).alias("candidate"), "score")
    return cut.groupBy("query", "candidate").agg(F.max("score").alias("score"))
