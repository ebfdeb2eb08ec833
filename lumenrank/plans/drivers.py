"""Evaluations from files of cached vectors: dense, hybrid with BM25, and by packed codes, from paths to metrics.

Ids of files are strings; rankings work on numbers. Each side's ids are numbered once, in their own order, so ties go by id as they
do in the files; the numbers are written to the shared folder and everything else joins on them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics, fusion, metrics, ranking
from ..sources import files
from ..tables import materialise


def numbered(ids: DataFrame, name: str) -> DataFrame:
    """(id, name) of different ids: numbers that grow with the ids, not without gaps."""
    return materialise(ids.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias(name)), "ids")


@dataclass
class Cached:
    """Queries (query_id, x), docs (doc_id, y), qrels (query_id, doc_id, rel) by number, and the numbers of both sides' ids."""

    queries: DataFrame
    docs: DataFrame
    qrels: DataFrame
    query_ids: DataFrame
    doc_ids: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, query_vectors: str, doc_vectors: str, qrels: str) -> Cached:
        """From files of vectors and judgements. A judged query without a vector is an error; documents without one are not ranked."""
        rel = files.read_qrels(spark, qrels)
        q, d = files.read_vectors(spark, query_vectors), files.read_vectors(spark, doc_vectors)
        lost = files.missing_vectors(rel.select(F.col("query_id").alias("id")).distinct(), q)
        if lost:
            raise ValueError(f"{lost} judged queries have no vector in {query_vectors}")
        query_ids, doc_ids = numbered(q, "query_id"), numbered(d, "doc_id")
        queries = q.join(query_ids, "id").select("query_id", F.col("vector").alias("x"))
        docs = d.join(doc_ids, "id").select("doc_id", F.col("vector").alias("y"))
        judged = rel.withColumnsRenamed({"query_id": "_q", "doc_id": "_d"})
        judged = judged.join(query_ids.withColumnRenamed("id", "_q"), "_q").join(doc_ids.withColumnRenamed("id", "_d"), "_d").select("query_id", "doc_id", "rel")
        judged = materialise(judged, "judged")
        asked = queries.join(judged.select("query_id").distinct(), "query_id", "left_semi")
        return cls(materialise(asked, "queries"), materialise(docs, "vectors"), judged, query_ids, doc_ids)

    def named(self, ranked: DataFrame) -> DataFrame:
        """A ranking with the files' ids in place of numbers."""
        rows = ranked.join(self.query_ids.withColumnRenamed("id", "_q"), "query_id").join(self.doc_ids.withColumnRenamed("id", "_d"), "doc_id")
        return rows.drop("query_id", "doc_id").withColumnsRenamed({"_q": "query_id", "_d": "doc_id"})


def evaluate_dense(cached: Cached, top_k: int = 10) -> DataFrame:
    """Means of the metrics of the exhaustive ranking."""
    found = ranking.dense_top_k(cached.queries, cached.docs, ranking.depth(top_k), digits=6)
    return metrics.summary(metrics.per_query(found, cached.qrels, cached.docs))


def hybrid_ranking(spark: SparkSession, cached: Cached, corpus: str, queries: str, method: str = "minmax", top_k: int = 10, **settings) -> DataFrame:
    """The dense ranking of cached vectors fused with BM25 over the files' texts; only documents with a vector take part."""
    k = ranking.depth(top_k)
    texts = files.read_texts(spark, corpus).join(cached.doc_ids, "id").select("doc_id", "text")
    asked = files.read_texts(spark, queries).join(cached.query_ids, "id").select("query_id", "text").join(cached.queries.select("query_id"), "query_id", "left_semi")
    lexical = ranking.Bm25(texts).top_k(asked, k)
    return fusion.fuse(ranking.dense_top_k(cached.queries, cached.docs, k, digits=6), lexical, method, top=k, **settings)


def evaluate_hybrid(spark: SparkSession, cached: Cached, corpus: str, queries: str, method: str = "minmax", top_k: int = 10, **settings) -> DataFrame:
    """Means of the metrics of hybrid_ranking()."""
    found = materialise(hybrid_ranking(spark, cached, corpus, queries, method, top_k, **settings), "hybrid")
    return metrics.summary(metrics.per_query(found, cached.qrels, cached.docs))


def evaluate_quantized(cached: Cached, runs: list[diagnostics.Run], top_k: int = 10, per_query: str | None = None, per_query_k: int = 0) -> DataFrame:
    """A row for each run by packed codes: metrics, losses against the dense ranking, bytes. per_query: a folder for the rows of
    all runs, as JSON lines with the files' ids, to depth per_query_k if that is deeper than the evaluated one."""
    rows = materialise(diagnostics.run_rows(runs, cached.queries, cached.docs, cached.qrels, top_k, per_query_k), "runs")
    if per_query:
        files.write_jsonl(cached.named(rows), per_query)
    return diagnostics.evaluate_runs(rows, runs, cached.queries, cached.docs, cached.qrels, top_k)
