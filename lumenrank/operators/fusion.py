"""Fusion of two or more rankings of the same queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Weight of the lexical side, and the constant of reciprocal rank fusion.
ALPHA, RRF_K = 0.75, 60


def check(alpha: float = ALPHA, k: int = RRF_K, weight: float = 1.0) -> None:
    if not 0 <= alpha <= 1 or k <= 0 or weight < 0:
        raise ValueError("alpha must be in [0, 1], k above 0, weight at least 0")


def union(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, doc_id, dense_score, dense_rank, bm25_score, bm25_rank) of all that either side ranks."""
    d = dense.select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = lexical.select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    return d.join(b, ["query_id", "doc_id"], "full_outer")


def _minmax(c: str) -> Column:
    q = W.partitionBy("query_id")
    lo, hi = F.min(c).over(q), F.max(c).over(q)
    return F.when(F.col(c).isNull(), 0.0).when(hi == lo, 1.0).otherwise((F.col(c) - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo))


def _zscore(c: str) -> Column:
    q = W.partitionBy("query_id")
    mean, sd = F.avg(c).over(q), F.stddev_pop(c).over(q)
    return F.when(F.col(c).isNull() | (sd == 0), 0.0).otherwise((F.col(c) - mean) / F.when(sd == 0, 1.0).otherwise(sd))


def fuse(dense: DataFrame, lexical: DataFrame, method: str = "minmax", alpha: float = ALPHA, k: int = RRF_K, weight: float = 1.0, protect: int = 0, top: int | None = None, digits: int = 6) -> DataFrame:
    """minmax or zscore: (1 - alpha) dense + alpha lexical; rrf: 1 / (k + rank) + weight / (k + rank).

    Ties go by dense rank, lexical rank, id. The first `protect` dense documents stay on top.
    """
    check(alpha, k, weight)
    u = union(dense, lexical)
    if method == "rrf":
        score = F.coalesce(1 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(weight / (k + F.col("bm25_rank")), F.lit(0.0))
    else:
        side = {"minmax": _minmax, "zscore": _zscore}[method]
        score = (1 - alpha) * side("dense_score") + alpha * side("bm25_score")
    fused = u.withColumn("score", F.round(score, digits) + 0.0)
    first = F.when(F.col("dense_rank") <= protect, F.col("dense_rank"))
    order = W.partitionBy("query_id").orderBy(first.asc_nulls_last(), F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "doc_id")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def weighted_rrf(rankings: list[tuple[DataFrame, float]], k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Any number of rankings; ties go by the ranks in the order of the lists, then id."""
    tagged = None
    for n, (r, w) in enumerate(rankings):
        part = r.select("query_id", "doc_id", (w / (k + F.col("rank"))).alias("part"), F.lit(n).alias("list"), "rank")
        tagged = part if tagged is None else tagged.unionByName(part)
    sums = tagged.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), digits).alias("score"), *[F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"r{n}") for n in range(len(rankings))])
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), *[F.col(f"r{n}").asc_nulls_last() for n in range(len(rankings))], "doc_id")
    return sums.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "doc_id", "score", "rank")


def dedup_ranking(ranked: DataFrame) -> DataFrame:
    """The first place of each document, ranks counted anew."""
    first = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    return first.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("first", "doc_id")).cast("long").alias("rank"))


def calibration(base: DataFrame, other: DataFrame, metric: str = "ndcg") -> DataFrame:
    """One row: how the other ranking's metric moves per query, and what choosing the better of both would give."""
    b, o = base.select("query_id", F.col(metric).alias("b")), other.select("query_id", F.col(metric).alias("o"))
    d = b.join(o, "query_id").withColumn("delta", F.col("o") - F.col("b"))
    return d.agg(
        F.count_if(F.col("delta") > 1e-12).alias("improved"), F.count_if(F.col("delta") < -1e-12).alias("regressed"),
        F.count_if(F.abs("delta") <= 1e-12).alias("tied"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"),
        F.max("delta").alias("max_delta"), F.avg(F.greatest("b", "o")).alias("oracle"),
    )


def top_one_agreement(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: the queries of both rankings, and the share whose first documents are the same."""
    b, o = (r.where(F.col("rank") == 1).select("query_id", F.col("doc_id").alias(n)) for r, n in ((base, "b"), (other, "o")))
    return b.join(o, "query_id").agg(F.count("*").alias("queries"), F.avg((F.col("b") == F.col("o")).cast("double")).alias("top1_agreement"))


def grid(dense: DataFrame, lexical: DataFrame, alphas: list[float], constants: list[int], weights: list[float], top: int, digits: int = 6) -> DataFrame:
    """(setting, query_id, doc_id, score, rank) of every blend, in one pass: minmax:alpha, zscore:alpha, rrf:constant:weight.

    Both lists are united once, and a row per document and setting is ranked.
    """
    u = union(dense, lexical).withColumns({f"_{n}_{c}": f(f"{c}_score") for n, f in (("m", _minmax), ("z", _zscore)) for c in ("dense", "bm25")})
    scores = []
    for name, n in (("minmax", "m"), ("zscore", "z")):
        for alpha in alphas:
            check(alpha=alpha)
            scores.append((f"{name}:{alpha:g}", (1 - alpha) * F.col(f"_{n}_dense") + alpha * F.col(f"_{n}_bm25")))
    for k in constants:
        for w in weights:
            check(k=k, weight=w)
            scores.append((f"rrf:{k}:{w:g}", F.coalesce(1 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(w / (k + F.col("bm25_rank")), F.lit(0.0))))
    many = F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), (F.round(c, digits) + 0.0).alias("score")) for s, c in scores])).alias("g")
    long = u.select("query_id", "doc_id", "dense_rank", "bm25_rank", many).select("query_id", "doc_id", "dense_rank", "bm25_rank", "g.setting", "g.score")
    order = W.partitionBy("setting", "query_id").orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "doc_id")
    return long.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("setting", "query_id", "doc_id", "score", "rank")


def pick(measured: DataFrame, primary: str, guarded: dict[str, float], slack: float = 0.0) -> DataFrame:
    """measured (setting, metrics) with protected (no guarded metric falls below its bound by more than slack) and picked:
    the best protected setting by the primary metric, then by name."""
    ok = F.lit(True)
    for metric, bound in guarded.items():
        ok = ok & (F.col(metric) >= bound - slack)
    m = measured.withColumn("protected", F.coalesce(ok, F.lit(False)))
    place = F.row_number().over(W.orderBy(F.col("protected").desc(), F.col(primary).desc(), "setting"))  # one row per setting
    return m.withColumn("picked", (place == 1) & F.col("protected"))


def router_features(ranked: DataFrame, other: DataFrame, k: int = 10) -> DataFrame:
    """Per query: margin of the best two scores, gap from first to k-th, spread of the best k, overlap and agreement with other."""
    best = ranked.where(F.col("rank") <= k)
    shape = best.groupBy("query_id").agg(
        (F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))).alias("margin"),
        (F.max("score") - F.min("score")).alias("gap"), F.stddev_pop("score").alias("spread"),
    )
    same = best.alias("a").join(other.where(F.col("rank") <= k).alias("b"), ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.count("*").alias("overlap"), F.max(F.when((F.col("a.rank") == 1) & (F.col("b.rank") == 1), 1).otherwise(0)).alias("same_top")
    )
    return shape.join(same, "query_id", "left").na.fill(0, ["overlap", "same_top"])
