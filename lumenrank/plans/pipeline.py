"""A small plan language: parameters are tables, kernels are Column functions, pipelines bind names once and return frames.

    p = Pipeline("score", params={"docs": ["doc_id", "y"]})
    p.let("near", lambda env: ranking.dense_top_k(env["queries"], env["docs"], 10))
    p.returns("near")
    out = p.run(queries=q, docs=d)["near"]

Everything stays lazy: a pipeline only composes frames, and the optimiser sees the whole of it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame


def kernel(f: Callable[..., Column]) -> Callable[..., Column]:
    """Marks a function of Columns; it may not see frames."""

    def run(*columns: Column) -> Column:
        if any(isinstance(c, DataFrame) for c in columns):
            raise TypeError(f"kernel {f.__name__} takes columns, not frames")
        return f(*columns)

    run.__name__ = f.__name__
    return run


class Pipeline:
    def __init__(self, name: str, params: Mapping[str, list[str]]):
        self.name, self.params = name, dict(params)
        self.steps: list[tuple[str, Callable[[Mapping[str, Any]], Any]]] = []
        self.outputs: tuple[str, ...] = ()

    def let(self, name: str, expression: Callable[[Mapping[str, Any]], Any]) -> Pipeline:
        """Bind a name, once."""
        if self.outputs:
            raise ValueError("nothing may follow the return")
        if name in self.params or any(name == n for n, _ in self.steps):
            raise ValueError(f"{name} is bound already")
        self.steps.append((name, expression))
        return self

    def effect(self, action: Callable[[Mapping[str, Any]], None]) -> Pipeline:
        """A statement without a value: a write."""
        self.steps.append(("", action))
        return self

    def returns(self, *names: str) -> Pipeline:
        known = {*self.params, *(n for n, _ in self.steps)}
        if missing := [n for n in names if n not in known]:
            raise ValueError(f"not bound: {missing}")
        self.outputs = names
        return self

    def run(self, **tables: DataFrame) -> dict[str, DataFrame]:
        if set(tables) != set(self.params):
            raise ValueError(f"{self.name} takes {sorted(self.params)}")
        for n, columns in self.params.items():
            if lacking := [c for c in columns if c not in tables[n].columns]:
                raise ValueError(f"{n} lacks {lacking}")
        if not self.outputs:
            raise ValueError(f"{self.name} returns nothing")
        env: dict[str, Any] = dict(tables)
        for n, f in self.steps:
            value = f(dict(env))
            if n:
                env[n] = value
        return {n: env[n] for n in self.outputs}
