"""State, table functions, batch orders by turns, and places of lines, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ranking, tablefunctions, turntaking
from ..streaming import cache
from ..tables import shared_root
from .base import Registry, Tables, r6
from .retrieval import dense_sql

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add

_READS = """WITH e AS (SELECT DISTINCT client_id::BIGINT AS client_id, CASE WHEN kind = 'purchase' THEN 'write' ELSE 'read' END AS kind, click_id AS seq, value FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND NOT (kind = 'purchase' AND value IS NULL)),
h AS (SELECT *, last_value(CASE WHEN kind = 'write' THEN value END IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY seq, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, last_value(CASE WHEN kind = 'write' THEN seq END IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY seq, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS written FROM e)
SELECT client_id, seq, round(coalesce(held, 0), 6) AS value, coalesce(written, 0)::DOUBLE AS written, held IS NOT NULL AS found FROM h WHERE kind = 'read'"""


def _cache_events(clicks):
    """A client's purchases write, its other clicks read; repeated rows count once."""
    known = clicks.where("client_id is not null and kind is not null and not (kind = 'purchase' and value is null)")
    kind = F.when(F.col("kind") == "purchase", F.lit(cache.WRITE)).otherwise(F.lit(cache.READ))
    return known.select(F.col("client_id").cast("long").alias("client_id"), kind.alias("kind"), F.col("click_id").cast("long").alias("seq"), F.array("value", F.col("click_id").cast("double")).alias("value"))


def _told(reads):
    return reads.select("client_id", "seq", r6(F.get("value", F.lit(0)), "value"), F.get("value", F.lit(1)).alias("written"), "found")


@add(_READS)
def kv_cache_reads(t: Tables):
    """What each click finds in a cache that purchases write."""
    return _told(cache.cached_reads(_cache_events(t.clicks).distinct(), "client_id", 2))


@add(_READS)
def kv_cache_stream(t: Tables):
    """The same by a streaming query with a value of state for each client."""
    import uuid

    folder = f"{shared_root(t.spark)}/cache-{uuid.uuid4().hex}"
    _cache_events(t.clicks).distinct().write.parquet(f"{folder}/in")
    with cache.state_settings(t.spark):
        stream = t.spark.readStream.schema("client_id long, kind string, seq long, value array<double>").parquet(f"{folder}/in")
        reads = cache.cache(stream, "client_id", 2).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        query = reads.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    query.awaitTermination()
    return _told(t.spark.read.schema("client_id long, seq long, value array<double>, found boolean").parquet(f"{folder}/out"))


@add(f"WITH {dense_sql(50)} SELECT query_id, string_agg(doc_id::VARCHAR || ':' || label::VARCHAR, ',' ORDER BY rank) AS packed, count(*) AS n FROM dense JOIN embeddings ON vec_id = doc_id WHERE rank <= 5 GROUP BY query_id")
def candidate_table_function(t: Tables):
    """Runs of candidates by a table function over the best fifty of each query."""
    q = t.embeddings.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    d = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("y"))
    near = ranking.dense_top_k(q, d, 50, digits=6).join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    runs = tablefunctions.candidate_runs(near.select("query_id", "doc_id", "score", "label"), 5)
    packed = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["doc_id"].cast("string"), c["label"].cast("string"))), ",")
    return runs.select("query_id", packed.alias("packed"), "n")


@add(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)
SELECT doc_id, source, row_number() OVER (ORDER BY turn, first) - 1 AS position FROM r"""
)
def order_spread_by_group(t: Tables):
    """Documents of a source spread as far as they can be."""
    return turntaking.spread(t.documents.select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "position")


_WEIGHTS = {"src0": 3, "src1": 2, "src2": 2}


@add(
    """WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY min(doc_id)) AS g, CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src2' THEN 2 ELSE 1 END AS w FROM documents GROUP BY source),
s AS (SELECT list(n ORDER BY g) AS n, list(w ORDER BY g) AS w, count(*) AS many FROM g),
v AS (SELECT 0::BIGINT AS place, 1::BIGINT AS g, 32::BIGINT AS room, n AS rem, 0::BIGINT AS taken, 0::BIGINT AS who, 0::BIGINT AS rank FROM s
UNION ALL SELECT place + take, CASE WHEN room = take OR v.g = many THEN 1 ELSE v.g + 1 END, CASE WHEN room = take THEN 32 ELSE room - take END, list_transform(rem, lambda x, i: CASE WHEN i = v.g THEN x - take ELSE x END), take, v.g, n[v.g] - rem[v.g]
FROM (SELECT v.*, s.*, least(s.w[v.g], v.rem[v.g], v.room) AS take FROM (SELECT place, g, room, rem FROM v WHERE list_sum(rem) > 0) v, s) v),
p AS (SELECT who, unnest(range(rank, rank + taken)) AS rank, unnest(range(place - taken, place)) AS position FROM v WHERE taken > 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM documents)
SELECT doc_id, source, position FROM d JOIN g USING (source) JOIN p ON p.who = g.g AND p.rank = d.rank"""
)
def order_source_turns(t: Tables):
    """Sources take turns by weight within batches of 32."""
    return turntaking.source_turns(t.documents.select("doc_id", "source"), "source", "doc_id", _WEIGHTS, 32).select("doc_id", "source", "position")


@add("SELECT vec_id AS doc_id, round(sum(e * e), 6) AS size FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS e FROM embeddings) GROUP BY ALL")
def export_by_batches(t: Tables):
    """All vectors exported in committed batches; the run is cut off after some of them, and a second one makes the others."""
    import uuid

    from ..sources import commitlog

    path = f"{shared_root(t.spark)}/export-{uuid.uuid4().hex}"
    rows = t.embeddings.select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("y"))
    made = lambda part: part.select("doc_id", r6(V.dot(F.col("y"), F.col("y")), "size"))
    left = [3]

    def cut_off(part):
        left[0] -= 1
        if left[0] < 0:
            raise InterruptedError
        return made(part)

    try:
        commitlog.export(rows, path, "doc_id", cut_off, 8)
    except InterruptedError:
        commitlog.export(rows, path, "doc_id", made, 8)
    return commitlog.CommitLog(t.spark, path).read()
