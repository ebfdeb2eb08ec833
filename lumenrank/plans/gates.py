"""Comparison of metrics and gates on them. Metrics are rows (dataset, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLACK = 1e-6


def unpivot(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) of one row per key."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return wide.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))


def compare(old: DataFrame, new: DataFrame, least_ratio: float | None = None) -> DataFrame:
    """(dataset, metric, old, new, delta, ratio, passes); only datasets and metrics of both sides."""
    m = old.select("dataset", "metric", F.col("value").alias("old")).join(new.select("dataset", "metric", F.col("value").alias("new")), ["dataset", "metric"])
    ratio = F.when(F.col("old") != 0, F.col("new") / F.when(F.col("old") == 0, 1.0).otherwise(F.col("old")))
    ok = F.lit(True) if least_ratio is None else F.coalesce(ratio >= least_ratio, F.lit(True))
    return m.select("dataset", "metric", "old", "new", (F.col("new") - F.col("old")).alias("delta"), ratio.alias("ratio"), ok.alias("passes"))


_OPS = {
    ">=": lambda v, b: v >= b - SLACK,
    "<=": lambda v, b: v <= b + SLACK,
    ">": lambda v, b: v > b + SLACK,
    "<": lambda v, b: v < b - SLACK,
    "==": lambda v, b: F.abs(v - b) <= SLACK,
}


def read_thresholds(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(dataset, metric, op, bound) of lines such as "scifact ndcg_10 >= 0.5" or "ndcg_10 >= 0.5" (for all datasets); # starts a comment."""
    rows = []
    for line in lines:
        words = line.split("#")[0].split()
        if not words:
            continue
        if len(words) not in (3, 4) or words[-2] not in _OPS:
            raise ValueError(f"no threshold: {line!r}")
        rows.append((words[0] if len(words) == 4 else None, words[-3], words[-2], float(words[-1])))
    return spark.createDataFrame(rows, "dataset string, metric string, op string, bound double")


def thresholds_of(spark: SparkSession, settings: dict[str, str], prefix: str = "GATE_") -> DataFrame:
    """The same of settings by name (as an environment has them): GATE_MIN_<METRIC> and GATE_MAX_<METRIC>, all datasets."""
    lines = []
    for name, value in sorted(settings.items()):
        for word, op in (("MIN_", ">="), ("MAX_", "<=")):
            if name.startswith(prefix + word):
                lines.append(f"{name[len(prefix + word) :].lower()} {op} {value}")
    return read_thresholds(spark, lines)


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each threshold (dataset or null for all, metric, op, bound) against what was measured; a dataset's own threshold
    takes the place of the general one; a metric that is missing fails. No threshold at all is an error."""
    if thresholds.isEmpty():
        raise ValueError("no checks")
    general = thresholds.where("dataset is null").drop("dataset").join(metrics.select("dataset").distinct())
    own = thresholds.where("dataset is not null")
    rules = general.join(own, ["dataset", "metric", "op"], "left_anti").unionByName(own)
    m = rules.join(metrics, ["dataset", "metric"], "left")
    ok = F.lit(None).cast("boolean")
    for op, holds in _OPS.items():
        ok = F.when(F.col("op") == op, holds(F.col("value"), F.col("bound"))).otherwise(ok)
    return m.select("dataset", "metric", "op", "bound", "value", F.coalesce(ok, F.lit(False)).alias("passes"))


def gate_scoreboard(current: DataFrame, anchor: DataFrame, metrics: list[str], tolerance: float, aliases: dict[str, list[str]] | None = None, macro: str | None = None) -> DataFrame:
    """(metric, current, anchor, delta, passes) as means over datasets; rows (dataset, seed, metrics).

    aliases: other names under which a side may have a metric, the first that is there counts. macro: the name of a row
    that holds the means already; a side that has it is taken by its word. Each side must have one row for each dataset,
    and seeds must agree; otherwise it is an error.
    """

    def named(side: DataFrame) -> DataFrame:
        for m in metrics:
            known = [c for c in [m, *(aliases or {}).get(m, [])] if c in side.columns]
            if not known:
                raise ValueError(f"no column for {m}")
            side = side.withColumn(m, F.coalesce(*known))
        return side

    current, anchor = named(current), named(anchor)
    both = current.alias("c").join(anchor.alias("a"), "dataset", "full_outer")
    n = both.groupBy("dataset").agg(F.count("c.seed").alias("c"), F.count("a.seed").alias("a"), F.max(F.col("c.seed") != F.col("a.seed")).alias("differ"))
    wrong = n.where("c <> 1 or a <> 1 or differ").count()
    if wrong:
        raise ValueError(f"{wrong} datasets without exactly one row on either side, or with other seeds")

    def means(side: DataFrame, name: str) -> DataFrame:
        if macro is not None:
            whole = side.where(F.col("dataset") == macro)
            side = whole if not whole.isEmpty() else side
        return unpivot(side, ["dataset"], metrics).groupBy("metric").agg(F.avg("value").alias(name))

    met = means(current, "current").join(means(anchor, "anchor"), "metric")
    return met.select("metric", "current", "anchor", (F.col("current") - F.col("anchor")).alias("delta"), (F.col("current") >= F.col("anchor") - tolerance - SLACK).alias("passes"))


def diagnose_training(steps: DataFrame, falling: list[str], floors: dict[str, float] | None = None) -> DataFrame:
    """(metric, first, last, least, most, steps, warning) of a run's metrics (step, metric, value).

    Warnings: a value that isn't finite; a metric that ought to fall and doesn't; one that ends below its floor.
    """
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    m = steps.groupBy("metric").agg(
        F.min_by("value", "step").alias("first"), F.max_by("value", "step").alias("last"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("steps"), F.max(bad).alias("bad")
    )
    warning = F.when(F.col("bad"), "not finite").when(F.col("metric").isin(falling) & (F.col("steps") > 1) & (F.col("last") >= F.col("first")), "does not fall")
    for name, floor in (floors or {}).items():
        warning = warning.when((F.col("metric") == name) & (F.col("last") < floor), "below its floor")
    return m.withColumn("warning", warning).drop("bad")


def best_checkpoint(rows: DataFrame, primary: str, ties: list[str], least_delta: float) -> dict:
    """A fold on the driver over the checkpoints of a run (a row each, so few) in order of step: better by at least least_delta, or tied and better in the next metrics."""
    best = None
    for r in rows.orderBy("step").toLocalIterator():
        r = r.asDict()
        if best is None or r[primary] > best[primary] + least_delta:
            best = r
        elif abs(r[primary] - best[primary]) <= least_delta and tuple(r[m] for m in ties) > tuple(best[m] for m in ties):
            best = r
    return best
