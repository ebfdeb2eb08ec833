"""Batch orders in which groups take turns, as closed forms over numbered rows: no loop over rows anywhere.

spread(): one row of each group at a time. source_turns(): sources take turns by weight within each batch, as a loop would that
starts anew with the first source at every batch and passes over exhausted ones. Between two exhaustions all batches are alike, so
a plan of a few phases (their number is bounded by that of the sources) tells the place of every row from its rank in its source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import place, running


def spread(rows: DataFrame, group: str, position: str, name: str = "position") -> DataFrame:
    """rows with name: groups in the order of their first row take turns, one row each, until all are exhausted.

    position: a number, different for all rows. A row's turn is its rank in its group; its place in the turn is told by the group's
    first row, and before it come all rows of earlier turns. Ranks and places are found by ranges, so a group of any size is
    spread over tasks. A null group is a group.
    """
    own = rows.withColumn("_g", F.struct(F.col(group).alias("v")))
    first = own.groupBy("_g").agg(F.min(position).alias("_lead"))
    turn = place(own, F.col(position), [], "_turn", within=["_g"]).join(first, "_g")
    many = turn.groupBy("_turn").agg(F.count("*").alias("_many"))
    before = running(many, "_turn", ["_many"]).select("_turn", F.col("_many_below").alias("_before"))
    at = place(turn, F.col("_lead"), [], "_nth", within=["_turn"]).join(before, "_turn")
    return at.withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_g", "_lead", "_turn", "_before", "_nth")


@dataclass
class Phase:
    """Batches that are alike: how many, the position of the first, and for each source the rank it starts at and the places of its
    rows within a batch."""

    batches: int
    position: int
    start: list[int]
    places: list[list[int]]


def one_batch(left: list[int], weights: list[int], batch: int) -> list[list[int]]:
    """Places that each source's rows take in one batch, with so many rows left."""
    left, places, taken = list(left), [[] for _ in left], 0
    while taken < batch and any(left):
        for g, w in enumerate(weights):
            n = min(w, left[g], batch - taken)
            places[g] += range(taken, taken + n)
            left[g], taken = left[g] - n, taken + n
    return places


def turn_plan(sizes: list[int], weights: list[int], batch: int) -> list[Phase]:
    """Phases of all batches for sources of these sizes; weights are at least 1."""
    if batch < 1 or min(weights, default=1) < 1:
        raise ValueError("a batch and all weights are at least 1")
    left, position, phases = list(sizes), 0, []
    while any(left):
        full = one_batch([batch if n else 0 for n in left], weights, batch)
        if all(n >= len(p) for n, p in zip(left, full, strict=True)):
            places = full
            batches = min(n // len(p) for n, p in zip(left, full, strict=True) if p)
        else:
            places, batches = one_batch(left, weights, batch), 1
        phases.append(Phase(batches, position, [s - n for s, n in zip(sizes, left, strict=True)], places))
        left = [n - batches * len(p) for n, p in zip(left, places, strict=True)]
        position += batches * sum(map(len, places))
    return phases


def source_turns(rows: DataFrame, source: str, position: str, weights: dict[str, int], batch: int, name: str = "position") -> DataFrame:
    """rows with name: sources, in the order of their first row, take turns of `weights` rows (1 where none is given) within
    batches of a fixed size; exhausted ones drop out. A null source is a source. The table of sources is on the driver:
    a row each, as many as the corpus has sources."""
    own = rows.withColumn("_g", F.struct(F.col(source).alias("v")))
    held = own.groupBy("_g").agg(F.count("*").alias("n"), F.min(position).alias("first")).orderBy("first").collect()
    keys = [r["_g"]["v"] for r in held]
    phases = turn_plan([r["n"] for r in held], [weights.get(k, 1) for k in keys], batch)
    plan = [
        (k, p.start[g], len(p.places[g]), len(p.places[g]) * p.batches, p.position, sum(map(len, p.places)), p.places[g])
        for p in phases for g, k in enumerate(keys) if p.places[g]
    ]
    kind = rows.schema[source].dataType.simpleString()
    told = rows.sparkSession.createDataFrame(plan, f"s {kind}, start long, each long, many long, position long, batch long, places array<int>")
    told = told.groupBy(F.struct(F.col("s").alias("v")).alias("_g")).agg(F.collect_list(F.struct("start", "each", "many", "position", "batch", "places")).alias("_plan"))
    ranked = place(own, F.col(position), [], "_rank", within=["_g"]).join(told, "_g")
    rank = F.col("_rank")
    mine = F.get(F.filter("_plan", lambda p: (p["start"] <= rank) & (rank < p["start"] + p["many"])), F.lit(0))
    ranked = ranked.withColumn("_p", mine)
    past = rank - F.col("_p.start")
    found: Column = F.col("_p.position") + F.floor(past / F.col("_p.each")) * F.col("_p.batch") + F.get(F.col("_p.places"), (past % F.col("_p.each")).cast("int"))
    return ranked.withColumn(name, found.cast("long")).drop("_g", "_plan", "_rank", "_p")

