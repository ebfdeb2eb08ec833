"""Places in a total order without gathering it: rows are counted by ranges of a number, and numbered within a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ranges that rows are dealt to: at least LEAST, and one for BIN_ROWS rows up to MOST, whose bounds are found in two steps.
LEAST, MOST = 64, 4096
BIN_ROWS = 200_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores, where they come in fewer partitions than there are cores (a small file is one row group, and
    one task), by keys if any are given; large inputs have more partitions than cores and are left as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def ranged(rows: DataFrame, by: Column) -> DataFrame:
    """rows with _by and _bin: the range of `by` (a number that is not null) that they are in, ascending.

    Bounds come from approximate quantiles. A range holds about the same number of rows, more only where rows tie.
    """
    keyed = rows.withColumn("_by", by)
    n, bins = rows.count(), LEAST
    while bins < MOST and n > bins * BIN_ROWS:
        bins *= 2
    found = keyed.agg(F.percentile_approx("_by", [i / bins for i in range(1, bins)], 10 * bins)).first()[0]
    bounds = sorted(set(found or []))
    # Of many bounds every 64th is looked at first, then only the 64 that follow.
    groups = [bounds[k : k + 64] for k in range(0, len(bounds), 64)] or [[]]
    below = lambda of: F.size(F.filter(of, lambda b: b < F.col("_by")))
    literal = lambda of: F.array(*[F.lit(b) for b in of])
    if len(groups) == 1:
        return keyed.withColumn("_bin", below(literal(groups[0])) if groups[0] else F.lit(0))
    group = below(literal([g[-1] for g in groups[:-1]]))
    inner = F.get(F.array(*[literal(g) for g in groups]), F.col("_group"))
    return keyed.withColumn("_group", group).withColumn("_bin", F.col("_group") * 64 + below(inner)).drop("_group")


def place(rows: DataFrame, by: Column, order: list, name: str, within: list[str] | None = None) -> DataFrame:
    """rows with name: place from 0 in the order of (by, *order), counted within the given columns."""
    within = within or []
    keyed = ranged(rows, by)
    counts = keyed.groupBy(*within, "_bin").count()
    before = W.partitionBy(*within).orderBy("_bin") if within else W.orderBy("_bin")  # at most MOST rows for each group
    first = counts.select(*within, "_bin", F.coalesce(F.sum("count").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    at = F.row_number().over(W.partitionBy(*within, "_bin").orderBy("_by", *order)) - 1
    return keyed.withColumn("_at", at).join(first, [*within, "_bin"]).withColumn(name, F.col("_first") + F.col("_at")).drop("_by", "_bin", "_at", "_first")


def running(rows: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """rows of different `by` with <sum>_below: what the rows of smaller `by` add up to."""
    keyed = ranged(rows, F.col(by))
    per = keyed.groupBy("_bin").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)  # at most MOST rows
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    first = per.select("_bin", *[zero(f"_{c}", before).alias(f"_{c}") for c in sums])
    inner = W.partitionBy("_bin").orderBy("_by").rowsBetween(W.unboundedPreceding, -1)
    found = keyed.withColumns({f"{c}_below": zero(c, inner) for c in sums}).join(first, "_bin")
    return found.withColumns({f"{c}_below": F.col(f"{c}_below") + F.col(f"_{c}") for c in sums}).drop("_by", "_bin", *[f"_{c}" for c in sums])
