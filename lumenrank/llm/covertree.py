"""Operator 3: exact near-duplicates of embeddings by dual traversal of cover trees.

Equal vectors are one node with a count from the first aggregation on. Unit vectors with cosine >= t lie within
tau = sqrt(2 - 2 t) of each other. The top level of the tree is some pivots, farthest-first from a bounded hashed
sample; every vector goes to its nearest pivot's cell. Cells that lie near each other are packed into blocks of up to
TILE vectors, and a cell of more is dealt into blocks by a hash. A vector meets a block only if the covering radius of one
of its cells lets it: if it is no further from the pivot than that radius and tau. For each pair of blocks one task builds the cover trees of the vectors that it gets (nested
levels, centres more than half a radius apart, all points within half the radius of a centre) and walks them together:
a pair of nodes is dropped if d(centres) - radius - radius > tau, else split, and pairs of leaves are compared exactly.
A task gives back link counts and a spanning forest, never the pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are their
own component; vectors of different lengths never link; an empty table gives none; rows that repeat a vec_id count
as copies if their vectors are equal, and are vectors with links of their own if they are not; rows without a vec_id are vectors like
any other, but never name a component: theirs is the smallest vec_id that they reach, or null (and they are kept) if there
is none; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, prepare, scratch
from .simhash import _hook

LEAST = 0.9
#: Vectors of a block; a task holds two blocks.
TILE = 8192
#: The sample that pivots are drawn from, the most pivots, and vectors for each of them where there are fewer.
SAMPLE, PIVOTS, CELL = 8192, 1024, 512
LEAF, CENTRES = 128, 48
#: What distances may be off by, as the square root of a rounded difference; pairs so near the edge are compared exactly.
SLACK = 1e-7


class Node:
    """A set of points within radius of its centre, which is one of them; children: nodes that split it."""

    __slots__ = ("centre", "children", "points", "radius")

    def __init__(self, points: np.ndarray, centre: int, radius: float):
        self.points, self.centre, self.radius, self.children = points, centre, radius, []


def _distance(unit: np.ndarray, points: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit[points] @ unit[at])))


def cover_tree(unit: np.ndarray, points: np.ndarray | None = None) -> Node | None:
    """The tree over unit vectors. A node whose points do not cluster keeps what few centres leave over as one leaf."""
    points = np.arange(len(unit)) if points is None else points
    if not len(points):
        return None
    root = Node(points, int(points[0]), float(_distance(unit, points, int(points[0])).max()))
    work = [root]
    while work:
        node = work.pop()
        if len(node.points) <= LEAF or node.radius < 1e-6:
            continue
        left, half = node.points, node.radius / 2
        for _ in range(CENTRES):
            c = node.centre if not node.children else int(left[0])
            d = _distance(unit, left, c)
            near = d <= half
            child = Node(left[near], c, float(d[near].max()))
            node.children.append(child)
            work.append(child)
            left = left[~near]
            if not len(left):
                break
        if len(left):
            c = int(left[0])
            node.children.append(Node(left, c, float(_distance(unit, left, c).max())))
    return root


def leaf_pairs(unit: np.ndarray, a: Node | None, b: Node | None, tau: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of leaves that may hold points within tau; the flag tells that both are the same leaf."""
    if a is None or b is None:
        return
    work = [(a, b)]
    slack = tau + SLACK
    while work:
        x, y = work.pop()
        if x is not y and math.sqrt(max(0.0, 2.0 - 2.0 * float(unit[x.centre] @ unit[y.centre]))) > x.radius + y.radius + slack:
            continue
        if x is y:
            if not x.children:
                yield x.points, y.points, True
            work.extend((p, q) for i, p in enumerate(x.children) for q in x.children[i:])
        elif x.children and (not y.children or x.radius >= y.radius):
            work.extend((p, y) for p in x.children)
        elif y.children:
            work.extend((x, q) for q in y.children)
        else:
            yield x.points, y.points, False


def near_links(unit: np.ndarray, sizes: np.ndarray, block: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the copies of others that it links with, and a forest (parent of each) of what is linked.

    block: only pairs of a vector with 0 and one with 1 count; None: all pairs.
    """
    n = len(unit)
    counts, root = np.zeros(n, dtype=np.int64), np.arange(n)
    tau = math.sqrt(max(0.0, 2.0 - 2.0 * least))
    if block is None:
        tree = cover_tree(unit)
        pairs = leaf_pairs(unit, tree, tree, tau)
    else:
        pairs = leaf_pairs(unit, cover_tree(unit, np.flatnonzero(block == 0)), cover_tree(unit, np.flatnonzero(block == 1)), tau)
    for p, q, same in pairs:
        for lo in range(0, len(p), 1024):
            rows = p[lo : lo + 1024]
            for at in range(0, len(q), 1024):
                cols = q[at : at + 1024]
                near = unit[rows] @ unit[cols].T >= least
                if same:
                    near &= rows[:, None] != cols[None, :]
                if not near.any():
                    continue
                counts[rows] += near @ sizes[cols]
                if not same:
                    counts[cols] += sizes[rows] @ near
                while True:  # join what is linked but not yet in one part; each round takes one link of a row
                    apart = near & (root[rows][:, None] != root[cols][None, :])
                    some = np.flatnonzero(apart.any(axis=1))
                    if not len(some):
                        break
                    _hook(root, rows[some], cols[apart[some].argmax(axis=1)])
    return counts, root


def _units(flat: np.ndarray) -> np.ndarray:
    v = flat.astype(np.float64)
    v = v / np.abs(v).max(axis=1)[:, None]  # so that no square of a very large or small component is lost
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(c), dim)


def _compare(least: float):
    """Block pairs are neighbours in a partition; one pair of blocks is held at a time."""

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held)
        dim, y = part.column("dim")[0].as_py(), part.column("y")[0].as_py()
        unit = _units(_matrix(part.column("vector"), dim))
        ids, sizes = part.column("node").to_numpy(), part.column("copies").to_numpy()
        block = None if part.column("x")[0].as_py() == y else (part.column("block").to_numpy() == y).astype(np.int8)
        counts, root = near_links(unit, sizes, block, least)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some]), pa.array(ids[root[some]])], ["node", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            if not len(b):
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("dim", "x", "y")], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for s, e in zip(cut.tolist(), np.append(cut[1:], len(keys)).tolist(), strict=True):
                key = tuple(keys[s].tolist())
                if held and key != now:
                    yield from settle(held)
                    held = []
                now = key
                held.append(b.slice(s, e - s))
        if held:
            yield from settle(held)

    return run


def pack(centres: np.ndarray, sizes: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell the first block and the number of blocks: cells of more than a tile have blocks of their own, the
    others fill blocks with those nearest to the first of them."""
    first, tiles = np.zeros(len(sizes), np.int64), np.where(sizes > 0, -(-sizes // tile), 0)
    block, left = 0, set(np.flatnonzero((sizes > 0) & (sizes <= tile)).tolist())
    for c in np.flatnonzero(sizes > tile).tolist():
        first[c] = block
        block += int(tiles[c])
    while left:
        start = min(left)
        room = tile
        for c in np.argsort(-(centres @ centres[start]), kind="stable").tolist():
            if c in left and (sizes[c] <= room or c == start):
                first[c] = block
                room -= int(sizes[c])
                left.discard(c)
        block += 1
    return first, tiles


def near_duplicates(vectors: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    with scratch(prepare(vectors.sparkSession)) as kept:
        return _near_duplicates(vectors, least, tile, kept)


def _near_duplicates(vectors: DataFrame, least: float, tile: int, kept: list[DataFrame]) -> DataFrame:
    spark = vectors.sparkSession
    # Single-precision vectors travel as they are; products are of double precision.
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    element = element if element == "float" else "double"
    v = F.transform("embedding", lambda x: x.cast(element))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, v).alias("vector"))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # A class has a number of its own, which is written with it: a vec_id may have several vectors, and several classes then.
    node = F.monotonically_increasing_id().alias("node")
    classes = materialise(classes.select(node, "rep", "copies", "vector", F.size("vector").alias("dim")), "classes")
    dims = {r[0]: r[1] for r in classes.groupBy("dim").count().collect()}  # one row per length of vector
    ring = 1 << 30
    pivots: dict[int, np.ndarray] = {}
    for dim, n in dims.items():
        share = ring if n <= SAMPLE else int(ring * SAMPLE / n)
        picked = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vector"), F.lit(ring)) < share)).limit(4 * SAMPLE).select("node", "vector").toPandas()
        if not len(picked):
            picked = classes.where(F.col("dim") == dim).limit(1).select("node", "vector").toPandas()
        unit = _units(np.stack(picked.sort_values("node")["vector"].to_numpy()))
        chosen, far = [0], _distance(unit, np.arange(len(unit)), 0)
        while len(chosen) < min(PIVOTS, -(-n // min(tile, CELL)), len(unit)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distance(unit, np.arange(len(unit)), chosen[-1]))
        pivots[dim] = unit[chosen]
    shared = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors for each length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy()
            cell, away = np.zeros(len(b), np.int32), np.zeros(len(b))
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                cos = _units(_matrix(b.column("vector").take(pa.array(own)), d)) @ shared.value[d].T
                cell[own] = cos.argmax(axis=1)
                away[own] = np.sqrt(np.maximum(0.0, 2 - 2 * cos.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], ["node", "copies", "vector", "dim", "cell", "away"])

    placed = classes.drop("rep").mapInArrow(assign, f"node long, copies long, vector array<{element}>, dim int, cell int, away double")
    placed = materialise(placed, "placed")
    cells = {(r[0], r[1]): (r[2], r[3]) for r in placed.groupBy("dim", "cell").agg(F.count("*"), F.max("away")).collect()}
    # Of each cell the first of its blocks, their number, and the radius; blocks are numbered through.
    tau, total, layout = math.sqrt(max(0.0, 2.0 - 2.0 * least)), 0, {}
    for dim, centres in pivots.items():
        sizes, radius = (np.array([cells.get((dim, c), (0, 0.0))[k] for c in range(len(centres))]) for k in (0, 1))
        first, tiles = pack(centres, sizes, tile)
        layout[dim] = (total + first, tiles, radius)
        total += int((first + tiles).max())
    blocks = spark.sparkContext.broadcast(layout)  # three numbers for each of at most PIVOTS

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cell, node = (b.column(c).to_numpy() for c in ("dim", "cell", "node"))
            block, touches = np.zeros(len(b), np.int32), [None] * len(b)
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                first, tiles, radius = blocks.value[d]
                mixed = (node[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                block[own] = first[cell[own]] + (mixed % tiles[cell[own]].astype(np.uint64)).astype(np.int64)
                cos = _units(_matrix(b.column("vector").take(pa.array(own)), d)) @ shared.value[d].T
                near = np.sqrt(np.maximum(0.0, 2 - 2 * cos)) <= radius + tau + SLACK
                near[np.arange(len(own)), cell[own]] = True
                near &= tiles > 0
                for i, row in zip(own.tolist(), near, strict=True):
                    at = np.flatnonzero(row)
                    many = tiles[at]
                    touches[i] = np.unique(np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum())))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("vector"), b.column("dim"), pa.array(block), pa.array(touches, pa.list_(pa.int32()))], ["node", "copies", "vector", "dim", "block", "touches"])

    dealt = placed.mapInArrow(meet, f"node long, copies long, vector array<{element}>, dim int, block int, touches array<int>")
    dealt = dealt.select("node", "copies", "vector", "dim", "block", F.explode("touches").alias("o"))
    dealt = dealt.select("node", "copies", "vector", "dim", "block", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"))
    dealt = dealt.repartition("dim", "x", "y").sortWithinPartitions("dim", "x", "y")
    found = materialise(dealt.mapInArrow(_compare(least), "node long, n long, other long"), "found")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.where("node <> other").select("node", "other")).withColumnRenamed("node", "_g")
    table = classes.select("node", "rep", "copies", "vector").join(links, "node", "left").join(joined, F.col("node") == F.col("_g"), "left")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    members = materialise(table.select("vector", "rep", n_links, F.coalesce("component", "node").alias("root")), "members")
    named = materialise(members.groupBy("root").agg(F.min("rep").alias("component_id")), "named")
    kept += [members, named]
    table = members.join(named, "root").select(F.col("vector").alias("v2"), "n_links", "component_id")
    own = F.coalesce("component_id", "vec_id")
    out = rows.join(table, F.col("vector") == F.col("v2"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
