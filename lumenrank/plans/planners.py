"""Sizes and budgets in closed form, over frames of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import window_count
from ..operators.ranking import payload_bytes


def attention_plan(settings: DataFrame) -> DataFrame:
    """settings (queries, keys, top_k, block, blocks): keys scored and used per query, their share, and whether that grows
    slower than the square. block 0: no routing; top_k 0: ceil(sqrt(keys))."""
    keys = F.col("keys").cast("double")
    used = F.least(keys, F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(F.ceil(F.sqrt(keys))))
    anchors = F.ceil(keys / F.greatest(F.col("block"), F.lit(1)))
    routed = anchors + F.least(keys, F.least(F.col("blocks"), anchors) * F.col("block"))
    scored = F.when(F.col("block") > 0, routed).otherwise(keys)
    return settings.select(
        "*", used.cast("long").alias("used"), scored.cast("long").alias("scored"), (scored * F.col("queries")).cast("long").alias("scores"),
        (scored / keys).alias("score_fraction"), (used / keys).alias("use_fraction"), (scored < keys).alias("sub_quadratic"),
    )


def kv_memory_plan(settings: DataFrame) -> DataFrame:
    """settings (layers, tokens, dim, bits): bytes of keys and values at full and at quantised width."""
    n = F.col("layers") * F.col("tokens") * 2
    dense, packed = n * F.col("dim") * 4, n * payload_bytes(F.col("dim"), F.col("bits"))
    return settings.select("*", dense.cast("long").alias("dense_bytes"), packed.cast("long").alias("packed_bytes"), (dense / packed).alias("ratio"))


def gate_plan(plan: DataFrame, most_fraction: float | None = None, sub_quadratic: bool = False, most_mib: float | None = None, size: str = "packed_bytes") -> DataFrame:
    """plan with passes: what it scores, that it grows slower than the square, and that it fits into so many MiB."""
    ok = F.lit(True)
    if most_mib is not None:
        ok = ok & (F.col(size) <= most_mib * 1024 * 1024)
    if most_fraction is not None:
        ok = ok & (F.col("score_fraction") <= most_fraction)
    if sub_quadratic:
        ok = ok & F.col("sub_quadratic")
    return plan.withColumn("passes", ok)


#: Bytes of a vector's entry beside its payload, packed in its parent or flat.
OVERHEAD = {"packed": 8, "flat": 48}
SIDECAR = {"none": 0, "fp16": 2, "dense": 4}


def storage_plan(scenarios: DataFrame, bits: DataFrame, sidecars: DataFrame) -> DataFrame:
    """scenarios (name, parents, length, width, stride, dim) x bits x sidecars: vectors, bytes, multiples of dense."""
    n = F.col("parents") * window_count(F.col("length"), F.col("width"), F.col("stride"))
    grid = scenarios.crossJoin(F.broadcast(bits)).crossJoin(F.broadcast(sidecars))  # settings, a handful of rows each
    side: Column = F.coalesce(*[F.when(F.col("sidecar") == k, F.lit(v) * F.col("dim")) for k, v in SIDECAR.items()])
    payload = payload_bytes(F.col("dim"), F.col("bits"))
    total = n * (payload + side + OVERHEAD["packed"])
    dense = n * F.col("dim") * 4
    return grid.select(
        "name", "bits", "sidecar", n.cast("long").alias("vectors"), payload.cast("long").alias("payload_bytes"), total.cast("long").alias("packed_bytes"),
        (n * (payload + side + OVERHEAD["flat"])).cast("long").alias("flat_bytes"), (total / dense).alias("dense_multiple"), (F.col("dim") * 4 / payload).alias("compression"),
    )


def fits(budget_bytes: Column, dim: Column, bits: Column) -> Column:
    """Vectors that fit a budget."""
    return F.floor(budget_bytes / payload_bytes(dim, bits)).cast("long")


def batch_estimate(rows: Column, batch: int) -> Column:
    """Batches of an epoch; a last batch of a single row is left out."""
    return F.when(rows % batch == 1, F.floor(rows / batch)).otherwise(F.ceil(rows / batch)).cast("long")


def routing_calibration(scores: DataFrame, block: int, top_blocks: int, k: int) -> DataFrame:
    """(mode, recall): share of each query's exact best k keys that lie in the blocks chosen by each way of judging a
    block: its middle, first or last key, the better of its two ends, its mean, its mean plus or minus radius, its median,
    its largest score (oracle), or a hash of the block alone (what chance gives).

    scores: (q, k, score), the exact products. With `value` (a number for each key) the cosine between what attention over
    the chosen keys and over all of them gives is told as well.
    """
    q = W.partitionBy("q")
    exact = scores.withColumn("r", F.row_number().over(q.orderBy(F.col("score").desc(), "k"))).where(F.col("r") <= k)
    b = scores.withColumn("block", F.floor(F.col("k") / block))
    n = F.count("*").over(q)
    b = b.withColumn("n", n)
    start = F.col("block") * block
    mid = start + F.floor((F.least(start + block, F.col("n")) - start) / 2)
    judged = b.groupBy("q", "block").agg(
        F.max(F.when(F.col("k") == mid, F.col("score"))).alias("anchor"), F.avg("score").alias("mean"), (F.avg("score") + F.stddev_pop("score")).alias("mean_radius"),
        F.max("score").alias("oracle"), F.max(F.when(F.col("k") == start, F.col("score"))).alias("first"), F.max_by("score", "k").alias("last"),
        (F.avg("score") - F.stddev_pop("score")).alias("mean_less_radius"), F.median("score").alias("median"),
        (F.conv(F.substring(F.sha2(F.concat_ws(":", F.first("q"), F.first("block")).cast("binary"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("chance"),
    )
    judged = judged.withColumn("ends", F.greatest("first", "last"))
    modes = ["anchor", "mean", "mean_radius", "mean_less_radius", "median", "oracle", "first", "last", "ends", "chance"]
    long = judged.select("q", "block", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("s")) for m in modes])).alias("z")).select("q", "block", "z.mode", F.round("z.s", 9).alias("s"))
    best = long.withColumn("r", F.row_number().over(W.partitionBy("q", "mode").orderBy(F.col("s").desc(), "block"))).where(F.col("r") <= top_blocks)
    hit = exact.withColumn("block", F.floor(F.col("k") / block)).join(best.select("q", "block", "mode"), ["q", "block"])
    queries = exact.select("q").distinct().count()
    recall = hit.groupBy("mode").agg((F.count("*") / F.lit(float(max(1, queries * k)))).alias("recall"))
    if "value" not in scores.columns:
        return recall
    soft = lambda rows, *keys: rows.withColumn("e", F.exp(F.col("score") - F.max("score").over(W.partitionBy(*keys)))).groupBy(*keys).agg((F.sum(F.col("e") * F.col("value")) / F.sum("e")).alias("o"))
    whole = soft(scores, "q").withColumnRenamed("o", "w")
    chosen = soft(scores.withColumn("block", F.floor(F.col("k") / block)).join(best.select("q", "block", "mode"), ["q", "block"]), "mode", "q")
    cosine = chosen.join(whole, "q").groupBy("mode").agg((F.sum(F.col("o") * F.col("w")) / F.sqrt(F.sum(F.col("o") * F.col("o")) * F.sum(F.col("w") * F.col("w")))).alias("output_cosine"))
    return recall.join(cosine, "mode")
