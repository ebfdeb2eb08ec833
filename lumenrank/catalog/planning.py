"""Planners, comparison and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import routing
from ..plans import gates as G
from ..plans import planners as P
from .base import Registry, Tables, r6

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add


@add(
    """WITH s AS (SELECT o_orderkey AS id, 64 AS queries, o_orderkey % 4096 + 1 AS keys, o_custkey % 3 * 8 AS top_k, o_custkey % 2 * 32 AS block, 4 AS blocks FROM orders),
p AS (SELECT *, least(keys, CASE WHEN top_k > 0 THEN top_k ELSE ceil(sqrt(keys)) END)::BIGINT AS used, CASE WHEN block > 0 THEN ceil(keys / greatest(block, 1)::DOUBLE) + least(keys, least(blocks, ceil(keys / greatest(block, 1)::DOUBLE)) * block) ELSE keys END::BIGINT AS scored FROM s)
SELECT id, used, scored, scored * queries AS scores, round(scored / keys::DOUBLE, 6) AS score_fraction, round(used / keys::DOUBLE, 6) AS use_fraction, scored < keys AS sub_quadratic, scored / keys::DOUBLE <= 0.5 AND scored < keys AS passes FROM p"""
)
def attention_plan(t: Tables):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = t.orders.select(o.alias("id"), F.lit(64).cast("long").alias("queries"), (o % 4096 + 1).alias("keys"), (c % 3 * 8).alias("top_k"), (c % 2 * 32).alias("block"), F.lit(4).alias("blocks"))
    p = P.gate_plan(P.attention_plan(s), 0.5, True)
    return p.select("id", "used", "scored", "scores", r6("score_fraction", "score_fraction"), r6("use_fraction", "use_fraction"), "sub_quadratic", "passes")


_SIZES = "SELECT source, count(*) AS parents, max(n_chars)::BIGINT AS longest FROM documents GROUP BY ALL"


def _sizes(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("parents"), F.max("n_chars").cast("long").alias("longest"))


@add(f"WITH s AS (SELECT s.*, b.bits FROM ({_SIZES}) s, (VALUES (2), (4), (8)) b(bits)) SELECT source, bits, longest AS tokens, 12 * longest * 2 * 64 * 4 AS dense_bytes, (12 * longest * 2 * (64 * bits / 8.0 + 4))::BIGINT AS packed_bytes, round(256 / (64 * bits / 8.0 + 4), 6) AS ratio FROM s")
def kv_memory_plan(t: Tables):
    """What the keys and values of each source's longest document take, a token for each character, in twelve layers."""
    s = _sizes(t).select("source", F.lit(12).cast("long").alias("layers"), F.col("longest").alias("tokens"), F.lit(64).cast("long").alias("dim"), F.explode(F.array(*[F.lit(b).cast("long") for b in (2, 4, 8)])).alias("bits"))
    return P.kv_memory_plan(s).select("source", "bits", "tokens", "dense_bytes", "packed_bytes", r6("ratio", "ratio"))


@add(
    f"""WITH s AS (SELECT source AS name, parents, longest AS length, 64 AS width, 48 AS stride, 128 AS dim FROM ({_SIZES})),
g AS (SELECT *, parents * CASE WHEN length <= width THEN 1 ELSE 1 + ceil((length - width) / stride::DOUBLE)::BIGINT END AS n, dim * bits / 8.0 + 4 AS payload, CASE sidecar WHEN 'none' THEN 0 WHEN 'fp16' THEN 2 ELSE 4 END * dim AS side FROM s, (VALUES (2), (4), (8)) b(bits), (VALUES ('none'), ('fp16'), ('dense')) c(sidecar))
SELECT name, bits, sidecar, n AS vectors, payload::BIGINT AS payload_bytes, (n * (payload + side + 8))::BIGINT AS packed_bytes, (n * (payload + side + 48))::BIGINT AS flat_bytes, round((payload + side + 8) / (dim * 4), 6) AS dense_multiple, round(dim * 4 / payload, 6) AS compression, floor(12288 / payload)::BIGINT AS fits FROM g"""
)
def storage_plan(t: Tables):
    """What windows over all documents of a source would take, if each were as long as the longest."""
    number = lambda n: F.lit(n).cast("long")
    s = _sizes(t).select(F.col("source").alias("name"), "parents", F.col("longest").alias("length"), number(64).alias("width"), number(48).alias("stride"), number(128).alias("dim"))
    b, c = t.spark.createDataFrame([(2,), (4,), (8,)], "bits long"), t.spark.createDataFrame([("none",), ("fp16",), ("dense",)], "sidecar string")
    p = P.storage_plan(s, b, c).withColumn("dim", number(128))
    return p.select("name", "bits", "sidecar", "vectors", "payload_bytes", "packed_bytes", "flat_bytes", r6("dense_multiple", "dense_multiple"), r6("compression", "compression"), P.fits(F.lit(12288), F.col("dim"), F.col("bits")).alias("fits"))


@add("SELECT source, count(*) AS rows, CASE WHEN count(*) % 7 = 1 THEN count(*) // 7 ELSE ceil(count(*) / 7.0)::BIGINT END AS batches FROM documents GROUP BY ALL")
def batch_estimates(t: Tables):
    n = t.documents.groupBy("source").agg(F.count("*").alias("rows"))
    return n.select("source", "rows", P.batch_estimate(F.col("rows"), 7).alias("batches"))


_ROUTING = routing.Settings(block=16, top_blocks=6)
_SUMMARIES = """v AS (SELECT vec_id AS k, vec_id // 16 AS block, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY vec_id // 16) AS n FROM embeddings),
a AS (SELECT block, list(m ORDER BY i) AS mean FROM (SELECT block, i, avg(v[i]) AS m FROM v, range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL), rad AS (SELECT block, max(list_distance(v, mean)) AS radius FROM v JOIN a USING (block) GROUP BY ALL),
f AS (SELECT block, k, v, round(list_inner_product(v, v), 12) AS size FROM v QUALIFY row_number() OVER (PARTITION BY block ORDER BY size DESC, k) = 1),
g AS (SELECT v.block, v.v FROM v JOIN f ON f.block = v.block AND f.k <> v.k QUALIFY row_number() OVER (PARTITION BY v.block ORDER BY list_distance(v.v, f.v) DESC, v.k) = 1),
c AS (SELECT block // 4 AS grp, v FROM f QUALIFY row_number() OVER (PARTITION BY block // 4 ORDER BY size DESC, block) = 1)"""


@add(
    f"""WITH {_SUMMARIES}, q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 25 = 0),
e AS (SELECT q, k, block, list_inner_product(x, v) AS s FROM q, v), t AS (SELECT q, block FROM e QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, k) <= 8),
multi AS (SELECT q, block, max(list_inner_product(x, v)) AS s FROM q, (SELECT block, v FROM f UNION ALL SELECT block, v FROM g) GROUP BY ALL), near AS (SELECT q, grp FROM q, c QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(list_inner_product(x, v), 9) DESC, grp) <= 4),
j AS (SELECT q, block, 'anchor' AS mode, list_inner_product(x, v) AS s FROM q, v WHERE place = n // 2 UNION ALL SELECT q, block, 'summary_mean', list_inner_product(x, mean) FROM q, a
UNION ALL SELECT q, block, 'summary_mean_radius', list_inner_product(x, mean) + radius * sqrt(list_inner_product(x, x)) FROM q, a JOIN rad USING (block) UNION ALL SELECT q, block, 'summary_maxnorm', list_inner_product(x, v) FROM q, f
UNION ALL SELECT q, block, 'summary_blend_radius', 0.5 * list_inner_product(x, mean) + 0.5 * list_inner_product(x, v) + 0.25 * radius * sqrt(list_inner_product(x, x)) FROM q, a JOIN rad USING (block) JOIN f USING (block)
UNION ALL SELECT q, block, 'summary_multirep', s FROM multi UNION ALL SELECT q, block, 'summary_hier_multirep', s FROM multi JOIN near USING (q) WHERE grp = block // 4
UNION ALL SELECT q, block, 'multiprobe', max(s) FROM e JOIN v USING (k, block) WHERE place = 0 OR place = n - 1 GROUP BY q, block UNION ALL SELECT q, block, 'oracle_block_max', max(s) FROM e GROUP BY q, block),
b AS (SELECT q, block, mode FROM j QUALIFY row_number() OVER (PARTITION BY q, mode ORDER BY round(s, 9) DESC, block) <= 6), h AS (SELECT mode, q, count(b.block) FILTER (t.q IS NOT NULL) / 8.0 AS recall FROM b LEFT JOIN t USING (q, block) GROUP BY ALL),
z AS (SELECT count(*) AS n, (count(*) + 15) // 16 AS blocks FROM embeddings)
SELECT mode, round(avg(recall), 6) AS recall, round(min(recall), 6) AS least_recall, CASE mode WHEN 'oracle_block_max' THEN any_value(n) WHEN 'summary_multirep' THEN any_value(blocks) * 2 WHEN 'multiprobe' THEN any_value(blocks) * 2 WHEN 'summary_hier_multirep' THEN (any_value(blocks) + 3) // 4 + least(4, (any_value(blocks) + 3) // 4) * 8 ELSE any_value(blocks) END AS route_scores,
least(any_value(n), 96) AS key_scores, any_value(n) AS dense_scores FROM h, z GROUP BY mode"""
)
def routing_calibration(t: Tables):
    """Every way of judging blocks but the learned one, by the share of exact best keys it reaches and what it costs."""
    modes = tuple(m for m in routing.MODES if m != "learned_block_linear")
    found = routing.calibrate(*_routed(t, 0), _ROUTING, 8, modes)
    return found.select("mode", r6("recall", "recall"), r6("least_recall", "least_recall"), "route_scores", "key_scores", "dense_scores")


def _routed(t: Tables, residue: int):
    q = t.embeddings.where(F.col("vec_id") % 25 == residue).select(F.col("vec_id").alias("query_id"), V.doubles(F.col("embedding")).alias("x"))
    return q, t.embeddings.select(F.col("vec_id").alias("k"), V.doubles(F.col("embedding")).alias("y"))


@add()
def routing_learned(t: Tables):
    """A linear router fitted on other queries than it is judged by; tests compare its weights with plain least squares."""
    asked, keys = _routed(t, 1)
    router = routing.trained(asked, keys, _ROUTING)
    found = routing.calibrate(_routed(t, 0)[0], keys, _ROUTING, 8, ("learned_block_linear",), router)
    return found.select("mode", r6("recall", "recall"), r6("least_recall", "least_recall"), "route_scores", "key_scores", "dense_scores")


_ORDERS = "SELECT o_orderstatus AS dataset, avg(o_totalprice) AS price, count(*)::DOUBLE AS orders FROM orders WHERE o_orderkey % 2 = {half} GROUP BY ALL"


def _side(t: Tables, half: int):
    return t.orders.where(F.col("o_orderkey") % 2 == half).groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))


@add(f"WITH a AS (UNPIVOT ({_ORDERS.format(half=0)}) ON price, orders INTO NAME metric VALUE value), b AS (UNPIVOT ({_ORDERS.format(half=1)}) ON price, orders INTO NAME metric VALUE value) SELECT dataset, metric, round(a.value, 4) AS old, round(b.value, 4) AS new, round(b.value - a.value, 4) + 0.0 AS delta, round(b.value / a.value, 6) AS ratio, b.value / a.value >= 0.99 AS passes FROM a JOIN b USING (dataset, metric)")
def metrics_comparison(t: Tables):
    old, new = (G.unpivot(_side(t, h), ["dataset"], ["price", "orders"]) for h in (0, 1))
    c = G.compare(old, new, 0.99)
    return c.select("dataset", "metric", r6("old", "old", 4), r6("new", "new", 4), r6("delta", "delta", 4), r6("ratio", "ratio"), "passes")


@add(
    f"""WITH a AS (UNPIVOT ({_ORDERS.format(half=0)}) ON price, orders INTO NAME metric VALUE value), g AS (SELECT * FROM (VALUES ('price', '>=', 150000.0::DOUBLE), ('orders', '<=', 3000.0), ('absent', '>=', 1.0)) g(metric, op, bound)), o AS (SELECT 'F' AS dataset, 'price' AS metric, '>=' AS op, 1.0::DOUBLE AS bound),
r AS (SELECT d.dataset, g.* FROM g, (SELECT DISTINCT dataset FROM a) d ANTI JOIN o ON o.dataset = d.dataset AND o.metric = g.metric AND o.op = g.op UNION ALL SELECT dataset, metric, op, bound FROM o)
SELECT r.dataset, r.metric, op, bound, round(value, 4) AS value, coalesce(CASE WHEN op = '>=' THEN value >= bound - 1e-6 ELSE value <= bound + 1e-6 END, false) AS passes FROM r LEFT JOIN a ON a.dataset = r.dataset AND a.metric = r.metric"""
)
def threshold_gate(t: Tables):
    rules = t.spark.createDataFrame([(None, "price", ">=", 150000.0), (None, "orders", "<=", 3000.0), (None, "absent", ">=", 1.0), ("F", "price", ">=", 1.0)], "dataset string, metric string, op string, bound double")
    g = G.gate(G.unpivot(_side(t, 0), ["dataset"], ["price", "orders"]), rules)
    return g.select("dataset", "metric", "op", "bound", r6("value", "value", 4), "passes")


@add(f"WITH a AS (UNPIVOT ({_ORDERS.format(half=0)}) ON price, orders INTO NAME metric VALUE value), b AS (UNPIVOT ({_ORDERS.format(half=1)}) ON price, orders INTO NAME metric VALUE value), c AS (SELECT metric, avg(value) AS current FROM b GROUP BY ALL), d AS (SELECT metric, avg(value) AS anchor FROM a GROUP BY ALL) SELECT metric, round(current, 4) AS current, round(anchor, 4) AS anchor, round(current - anchor, 4) + 0.0 AS delta, current >= anchor - 5 - 1e-6 AS passes FROM c JOIN d USING (metric)")
def scoreboard_gate(t: Tables):
    old, new = (_side(t, h).withColumn("seed", F.lit(1)) for h in (0, 1))
    g = G.gate_scoreboard(new, old, ["price", "orders"], 5.0)
    return g.select("metric", r6("current", "current", 4), r6("anchor", "anchor", 4), r6("delta", "delta", 4), "passes")
