"""Routing of queries to blocks of keys by summaries: what a block is judged by is a few vectors, never its exact scores.

Keys 0 to n - 1 are cut into blocks of a fixed number. summaries() makes a row for each block; route() scores queries against
those rows only, in blocks of queries, with a top-k for each partition. How good a way of judging is, calibrate() tells: the
share of each query's exact best keys that lie in the chosen blocks, and how many inner products it took.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ship import ship
from .blocks import BLOCK, PAIRS, in_blocks, matrix, together, top_k_by_blocks
from .ordering import spread

MODES = ("anchor", "summary_mean", "summary_mean_radius", "summary_maxnorm", "summary_blend_radius", "summary_multirep", "summary_hier_multirep", "learned_block_linear", "multiprobe", "oracle_block_max")
_SUMMARY = "block long, keys long, mean array<double>, radius double, reps array<double>, probes array<double>, anchor array<double>, coarse array<double>"


@dataclass(frozen=True)
class Settings:
    """reps, probes: vectors that a block has for multirep and multiprobe; group, groups: blocks of a group and groups
    chosen in the two-level way; alpha, radius_weight: of the blend; digits: scores are rounded before they are ranked."""

    block: int
    top_blocks: int
    reps: int = 2
    probes: int = 2
    group: int = 4
    groups: int = 4
    alpha: float = 0.5
    radius_weight: float = 0.25
    digits: int | None = 9


def probe_places(n: int, probes: int) -> list[int]:
    """Places of a block of n keys, evenly from its first to its last; one of them is its middle."""
    if probes <= 1 or n <= 1:
        return [n // 2]
    return sorted({min(n - 1, int(np.floor(i * (n - 1) / (probes - 1) + 0.5))) for i in range(probes)})


def farthest_first(y: np.ndarray, count: int, first: int) -> list[int]:
    """Rows of y: `first`, then each time the one farthest from those chosen (of equals, the smallest)."""
    chosen, far = [first], ((y - y[first]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(y)):
        far[chosen] = -np.inf
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((y - y[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


def summaries(keys: DataFrame, s: Settings) -> DataFrame:
    """One row for each block of keys (k, y): mean, radius around it, the key of largest norm and others far from it, probes, the
    middle key, and the key of largest norm of the block's group. A block is one small group of rows."""
    ship(keys.sparkSession)

    def summary(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        y = np.stack(f["y"].to_numpy()).astype(np.float64)
        mean = y.mean(axis=0)
        reps = farthest_first(y, s.reps, int(np.round((y * y).sum(axis=1), 12).argmax()))
        row = {"block": f["block"].iloc[0], "keys": len(y), "mean": mean, "radius": float(np.sqrt(((y - mean) ** 2).sum(axis=1).max())), "reps": y[reps].ravel()}
        return pd.DataFrame([row | {"probes": y[probe_places(len(y), s.probes)].ravel(), "anchor": y[len(y) // 2], "coarse": mean}])

    blocks = keys.select(F.floor(F.col("k") / s.block).alias("block"), "k", "y").groupBy("block").applyInPandas(summary, _SUMMARY).drop("coarse")
    # The group's vector: of its blocks' keys of largest norm, the largest; of equals, the first block's.
    rep = F.expr("slice(reps, 1, size(mean))")
    size = F.round(F.aggregate(rep, F.lit(0.0), lambda a, x: a + x * x), 12)
    group = F.floor(F.col("block") / s.group)
    coarse = blocks.groupBy(group.alias("g")).agg(F.max_by(rep, F.struct(size, -F.col("block"))).alias("coarse"))
    return blocks.join(coarse, group == F.col("g")).drop("g").select(*[c.split()[0] for c in _SUMMARY.split(", ")])


@dataclass
class Router:
    """A linear score of a block from five features: 1, query x mean, query x key of largest norm, |query| radius, keys."""

    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.means) * self.scales) @ self.weights


class Summaries:
    """A batch of summaries() as matrices."""

    def __init__(self, b: pa.RecordBatch):
        col = lambda name: b.column(b.schema.get_field_index(name))
        self.block = col("block").to_numpy()
        self.keys = col("keys").to_numpy().astype(np.float64)
        self.mean, self.anchor, self.coarse = (matrix(col(c)) for c in ("mean", "anchor", "coarse"))
        self.radius = col("radius").to_numpy()
        self._lists = {c: col(c) for c in ("reps", "probes")}

    def best(self, name: str, q: np.ndarray) -> np.ndarray:
        """Largest score (blocks x queries) over a block's vectors of this kind."""
        flat = self._lists[name].flatten().to_numpy().reshape(-1, q.shape[1])
        many = np.diff(self._lists[name].offsets.to_numpy()) // q.shape[1]
        return np.maximum.reduceat(flat @ q.T, np.cumsum(many) - many, axis=0)

    def first_rep(self, dim: int) -> np.ndarray:
        flat = self._lists["reps"].flatten().to_numpy().reshape(-1, dim)
        many = np.diff(self._lists["reps"].offsets.to_numpy()) // dim
        return flat[np.cumsum(many) - many]

    def features(self, q: np.ndarray) -> np.ndarray:
        """(blocks, queries, 5)."""
        one = np.ones((len(self.block), len(q)))
        reach = self.radius[:, None] * np.linalg.norm(q, axis=1)
        return np.stack([one, self.mean @ q.T, self.first_rep(q.shape[1]) @ q.T, reach, one * self.keys[:, None]], axis=2)

    def scores(self, mode: str, q: np.ndarray, s: Settings, router: Router | None) -> np.ndarray:
        if mode == "anchor":
            return self.anchor @ q.T
        if mode == "summary_mean":
            return self.mean @ q.T
        if mode == "summary_mean_radius":
            return self.mean @ q.T + self.radius[:, None] * np.linalg.norm(q, axis=1)
        if mode == "summary_maxnorm":
            return self.first_rep(q.shape[1]) @ q.T
        if mode == "summary_blend_radius":
            blend = self.mean + s.alpha * (self.first_rep(q.shape[1]) - self.mean)
            return blend @ q.T + s.radius_weight * self.radius[:, None] * np.linalg.norm(q, axis=1)
        if mode == "multiprobe":
            return self.best("probes", q)
        if mode == "learned_block_linear":
            return router.score(self.features(q))
        return self.best("reps", q)


def route(queries: DataFrame, blocks: DataFrame, mode: str, s: Settings, router: Router | None = None) -> DataFrame:
    """(query_id, block, score, rank): the top blocks of queries (query_id, x) by summaries(), ties to the smaller block."""
    if mode not in MODES or mode == "oracle_block_max":
        raise ValueError(f"no way to route by {mode}")
    if mode == "learned_block_linear" and router is None:
        raise ValueError("learned_block_linear needs a router")
    columns = [c.split()[0] for c in _SUMMARY.split(", ")]
    rows = blocks.withColumnRenamed("block", "doc_id")
    if mode == "summary_hier_multirep":
        # First the groups, by one vector each; then the blocks of the chosen ones.
        group = F.floor(F.col("doc_id") / s.group)
        coarse = rows.groupBy(group.alias("g")).agg(F.first("coarse").alias("y")).select(F.col("g").alias("doc_id"), "y")
        chosen = top_k_by_blocks(queries, coarse, ["y"], s.groups, lambda q: lambda b: matrix(b.column(1)) @ q.T, s.digits)
        near = chosen.select("query_id", F.col("doc_id").alias("g")).join(queries, "query_id")
        reps = rows.select(group.alias("g"), F.col("doc_id").alias("block"), "reps").join(near, "g")  # s.group * s.groups blocks for each query
        cut = F.transform(F.sequence(F.lit(0), (F.size("reps") / F.size("x")).cast("int") - 1), lambda i: F.slice(F.col("reps"), i * F.size("x") + 1, F.size("x")))
        best = F.array_max(F.transform(cut, lambda r: F.aggregate(F.zip_with(r, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)))
        scored = reps.select("query_id", "block", (F.round(best, s.digits) + 0.0 if s.digits is not None else best).alias("score"))
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "block")
        return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= s.top_blocks)

    def scorer(q: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        return lambda b: Summaries(b.rename_columns(columns)).scores(mode, q, s, router)

    return top_k_by_blocks(queries, rows, columns[1:], s.top_blocks, scorer, s.digits, wide=max(s.reps, s.probes, 5)).withColumnRenamed("doc_id", "block")


def oracle_blocks(queries: DataFrame, keys: DataFrame, s: Settings) -> DataFrame:
    """(query_id, block, score, rank): the top blocks by their best exact score; all keys are scored, as only calibration does."""
    held = keys.groupBy(F.floor(F.col("k") / s.block).alias("doc_id")).agg(F.flatten(F.collect_list("y")).alias("y"))  # s.block keys

    def scorer(q: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        def score(b: pa.RecordBatch) -> np.ndarray:
            many = np.diff(b.column(1).offsets.to_numpy()) // q.shape[1]
            flat = b.column(1).flatten().to_numpy().reshape(-1, q.shape[1])
            return np.maximum.reduceat(flat @ q.T, np.cumsum(many) - many, axis=0)

        return score

    return top_k_by_blocks(queries, held, ["y"], s.top_blocks, scorer, s.digits, wide=s.block).withColumnRenamed("doc_id", "block")


def fit_router(queries: DataFrame, keys: DataFrame, blocks: DataFrame, s: Settings, ridge: float = 1e-3) -> Router:
    """Least squares of "is one of the query's best blocks" on the standardised features, the rare ones weighing as much as
    the others together. The cluster adds up moments of all pairs of query and block, by blocks of queries and PAIRS of them at once:
    what comes back is 5 x 5 numbers."""
    from ..tables import materialise

    spark = ship(keys.sparkSession)
    best = oracle_blocks(queries, keys, s).groupBy("block").agg(F.collect_list("query_id").alias("hits"))  # at most as many as there are queries
    columns = [c.split()[0] for c in _SUMMARY.split(", ")]
    rows = spread(materialise(blocks.join(best, "block", "left").select(*columns, "hits"), "hits"))

    def one(ids: np.ndarray, asked: np.ndarray) -> DataFrame:
        order = np.argsort(ids, kind="stable")
        shared = spark.sparkContext.broadcast((ids[order], asked[order]))  # at most BLOCK queries

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            total = np.zeros((2, 5, 6))
            step = max(1, PAIRS // max(1, len(own)))
            for whole in batches:
                for at in range(0, len(whole) if len(own) else 0, step):
                    b = whole.slice(at, step)
                    x = Summaries(b).features(q)
                    hits = b.column(len(columns))
                    row, who = np.repeat(np.arange(len(b)), np.nan_to_num(pc.list_value_length(hits).to_numpy(zero_copy_only=False)).astype(int)), hits.flatten().to_numpy()
                    place = np.minimum(np.searchsorted(own, who), len(own) - 1)
                    mine = own[place] == who
                    hit = np.zeros(x.shape[:2], bool)
                    hit[row[mine], place[mine]] = True
                    for label in (0, 1):
                        part = x[hit == bool(label)]
                        total[label, :, :5] += part.T @ part
                        total[label, :, 5] += part.sum(axis=0)
            label, i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel().astype(np.int64)) for a in (label, i, j)] + [pa.array(total.ravel())], ["label", "i", "j", "v"])

        return rows.mapInArrow(moments, "label long, i long, j long, v double")

    found = together([one(*b) for b in in_blocks(queries, BLOCK)]).groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 5, 6))
    for r in found:
        total[r.label, r.i, r.j] = r.v
    return solve_router(total, ridge)


def solve_router(total: np.ndarray, ridge: float) -> Router:
    """total[label]: products of the features, and their sums, over examples of that label; feature 0 is 1."""
    n = total[:, 0, 0]
    if not n.all():
        raise ValueError("all blocks are best ones, or none")
    sums, products = total[:, :, 5].sum(axis=0), total[:, :, :5].sum(axis=0)
    means = sums / n.sum()
    scales = 1 / np.sqrt(np.maximum(np.diag(products) / n.sum() - means**2, 0) + 1e-12)
    means[0], scales[0] = 0, 1
    weight = np.array([1.0, n[0] / n[1]])
    a, b = np.zeros((5, 5)), np.zeros(5)
    for label in (0, 1):
        s1 = total[label, :, 5]
        centred = total[label, :, :5] - np.outer(means, s1) - np.outer(s1, means) + n[label] * np.outer(means, means)
        a += weight[label] * centred * np.outer(scales, scales)
        b += weight[label] * label * (s1 - n[label] * means) * scales
    return Router(means, scales, np.linalg.solve(a + ridge * n.sum() * np.eye(5), b))


def route_scores(mode: str, s: Settings, blocks: int, keys: int) -> int:
    """Inner products that judging takes for one query: of vectors of summaries, or for the oracle of all keys."""
    per = {"summary_multirep": min(s.reps, s.block), "multiprobe": len(probe_places(s.block, s.probes)), "learned_block_linear": 2}
    if mode == "oracle_block_max":
        return keys
    if mode == "summary_hier_multirep":
        groups = -(-blocks // s.group)
        return groups + min(s.groups, groups) * s.group * min(s.reps, s.block)
    return blocks * per.get(mode, 1)


def calibrate(queries: DataFrame, keys: DataFrame, s: Settings, k: int, modes: tuple[str, ...] = MODES, router: Router | None = None) -> DataFrame:
    """(mode, recall, least_recall, route_scores, key_scores, dense_scores) for queries (query_id, x) and keys (k, y).

    recall: mean over queries of the share of their exact best k keys that lie in the chosen blocks; least_recall: the least of
    them; scores are inner products for each query: to judge, of the keys chosen at most, and of all keys.
    """
    from ..tables import materialise

    n = keys.count()
    blocks = materialise(summaries(keys, s), "summaries")
    exact = top_k_by_blocks(queries, keys.withColumnRenamed("k", "doc_id"), ["y"], k, lambda q: lambda b: matrix(b.column(1)) @ q.T, s.digits)
    exact = materialise(exact.select("query_id", F.floor(F.col("doc_id") / s.block).alias("block")), "exact")
    chosen = None
    for mode in modes:
        found = oracle_blocks(queries, keys, s) if mode == "oracle_block_max" else route(queries, blocks, mode, s, router)
        found = found.select("query_id", "block", F.lit(mode).alias("mode"))
        chosen = found if chosen is None else chosen.unionByName(found)
    hits = exact.join(chosen, ["query_id", "block"]).groupBy("mode", "query_id").agg((F.count("*") / float(min(k, n))).alias("recall"))
    asked = queries.select("query_id").distinct().count()
    # A query without a hit has no row: its recall is 0.
    told = hits.groupBy("mode").agg((F.sum("recall") / float(asked)).alias("recall"), F.when(F.count("*") < asked, 0.0).otherwise(F.min("recall")).alias("least_recall"))
    total = -(-n // s.block)
    cost = F.create_map(*[F.lit(x) for m in modes for x in (m, route_scores(m, s, total, n))])
    every = keys.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    told = every.join(told, "mode", "left").fillna(0.0, ["recall", "least_recall"])
    return told.select("mode", "recall", "least_recall", cost[F.col("mode")].cast("long").alias("route_scores"), F.lit(min(n, s.top_blocks * s.block)).cast("long").alias("key_scores"), F.lit(n).cast("long").alias("dense_scores"))


def trained(queries: DataFrame, keys: DataFrame, s: Settings, train_top: int | None = None) -> Router:
    """fit_router() over summaries of the keys, with train_top best blocks as the label."""
    from ..tables import materialise

    own = replace(s, top_blocks=train_top or s.top_blocks)
    return fit_router(queries, keys, materialise(summaries(keys, own), "summaries"), own)
