"""Operator 7: shards that all have the corpus's mixture, by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; the row of rank r among n gets the fractional rank
(r + u) / n, with a u in [0, 1) of the source's own, so that the rows of many small sources don't fall together. In
the order of fractional ranks every source is spread evenly, and the order is cut into shards whose counts differ by
one at most (law "rows").

No rank needs a source, or the corpus, in one task: rows are first counted by hash ranges ("bins") of about equal
size, running sums of the counts give each bin its first rank, and only within a bin are rows numbered. Bins grow in
number with the rows up to BIN_ROWS rows each.

The hash is MD5 of seed, doc_id and text, which other engines have as well: so the query can be held against SQL.

Defined results: a null text counts as empty; a null source is a source of its own; equal doc_ids, and null ones, are
rows of their own, ordered by text; rows equal in doc_id and text get ranks of their own in any order; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, prepare, scratch

#: Rows of a bin: a bin is sorted in one task.
BIN_ROWS = 50_000
#: There are about so many bins even where the rows are few, so that tasks are even.
BINS = 1024
_RING = 1 << 40


def _rank(df: DataFrame, stratum: list[str], by: Column, order: list[Column], n: Column, per_bin: Column, name: str) -> DataFrame:
    """df with name: the row's rank, from 0, within its stratum; by: a number in [0, 1) that orders rows first."""
    bins = F.greatest(F.lit(1), F.ceil(n / per_bin)).cast("long")
    df = df.withColumn("_bin", F.least(F.floor(by * bins), bins - 1).cast("long"))
    counts = materialise(df.groupBy(*stratum, "_bin").count(), "bins")
    # Running sums over bins go by pages of 64 bins, so no task holds more than that of a source.
    paged = counts.withColumn("_page", F.floor(F.col("_bin") / 64))
    pages = paged.groupBy(*stratum, "_page").agg(F.sum("count").alias("_sum"))
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    pages = pages.select(*stratum, "_page", zero(F.sum("_sum").over(before(*stratum, "_page"))).alias("_paged"))
    within = paged.select(*stratum, "_page", "_bin", zero(F.sum("count").over(before(*stratum, "_page", "_bin"))).alias("_inner"))
    first = within.join(pages, [*stratum, "_page"]).select(*stratum, "_bin", (F.col("_paged") + F.col("_inner")).alias("_first"))
    ranked = df.withColumn("_at", F.row_number().over(W.partitionBy(*stratum, "_bin").orderBy(*order)) - 1)
    return ranked.join(first, [*stratum, "_bin"]).withColumn(name, F.col("_first") + F.col("_at")).drop("_bin", "_at", "_first")


def cut(pos: Column, total: int, shards: int) -> dict[str, Column]:
    """shard and slot of the row at pos of total: shard k holds positions from ceil(k * total / shards) on, in whole numbers."""
    div = lambda a, b: F.call_function("div", a.cast("long"), F.lit(b).cast("long"))
    k = div(pos * F.lit(shards).cast("long"), max(total, 1))
    first = div(k * F.lit(total).cast("long") + F.lit(shards - 1), shards)
    return {"shard": k.cast("int"), "slot": (pos - first).cast("long")}


def shard(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot, and the position in the interleaved order (pos)."""
    with scratch(prepare(docs.sparkSession)) as kept:
        return _shard(docs, shards, seed, kept)


def _shard(docs: DataFrame, shards: int, seed: int, kept: list[DataFrame]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("stratum"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("|"), text).cast("binary")).alias("shuffled"),
        ),
        "rows",
    )
    per = materialise(rows.groupBy("stratum").agg(F.count("*").alias("n_source")), "sources")
    total = per.agg(F.sum("n_source")).first()[0] or 0
    per_bin = F.lit(float(max(1, min(BIN_ROWS, -(-total // BINS)))))
    rows = rows.join(per, "stratum")
    digits = F.conv(F.substring("shuffled", 1, 10), 16, 10).cast("long")
    turn = digits / F.lit(float(_RING))
    ranked = materialise(_rank(rows, ["stratum"], turn, [digits, F.col("shuffled"), F.col("doc_id")], F.col("n_source"), per_bin, "rank"), "ranked")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("stratum")).cast("binary")), 1, 10), 16, 10).cast("long") / F.lit(float(_RING))
    ranked = ranked.withColumn("share", (F.col("rank") + start) / F.col("n_source"))
    order = [F.col("share"), F.col("stratum"), F.col("rank")]
    placed = _rank(ranked.withColumn("_all", F.lit(0)), ["_all"], F.col("share"), order, F.lit(total), per_bin, "pos")
    placed = placed.withColumns(cut(F.col("pos"), total, shards))
    source = F.when(F.col("stratum") != "", F.expr("substring(stratum, 2)")).alias("source")
    placed = materialise(placed.select("doc_id", source, "size", "text_crc32", "shard", "slot", "pos"), "placed")
    kept.append(placed)
    return placed


def sharded_documents(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """The columns of shard() with law and grown_shard, as one row per document."""
    out = shard(docs, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "pos")
