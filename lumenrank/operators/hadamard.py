"""A seeded fast rotation: signs, Hadamard butterflies and a permutation, twice; n log n additions in place of a matrix.

A length that is no power of two is cut into its binary parts, each with butterflies of its own; the permutation between the
two rounds mixes them. All steps are orthogonal, so the whole is, and it is undone by the steps in reverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..ship import ship

ROUNDS = 2


def parts(n: int) -> list[tuple[int, int]]:
    """Powers of two that add up to n, the largest first: (start, length)."""
    found, at = [], 0
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            found.append((at, 1 << bit))
            at += 1 << bit
    return found


def butterflies(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each part of the rows, which undoes itself."""
    out = np.array(x, dtype=np.float64)
    for at, n in parts(out.shape[-1]):
        width = 1
        while width < n:
            pairs = out[..., at : at + n].reshape(*out.shape[:-1], n // (2 * width), 2, width)
            low, high = pairs[..., 0, :].copy(), pairs[..., 1, :].copy()
            pairs[..., 0, :], pairs[..., 1, :] = low + high, low - high
            out[..., at : at + n] = pairs.reshape(*out.shape[:-1], n)
            width *= 2
        out[..., at : at + n] /= np.sqrt(n)
    return out


def steps(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signs and permutation of each round."""
    rng = np.random.default_rng([seed, n])
    return [(rng.integers(0, 2, n) * 2.0 - 1, rng.permutation(n)) for _ in range(ROUNDS)]


def turn(x: np.ndarray, seed: int) -> np.ndarray:
    for signs, order in steps(x.shape[-1], seed):
        x = butterflies(x * signs)[..., order]
    return x


def turn_back(x: np.ndarray, seed: int) -> np.ndarray:
    for signs, order in reversed(steps(x.shape[-1], seed)):
        undone = np.empty_like(x, dtype=np.float64)
        undone[..., order] = x
        x = butterflies(undone) * signs
    return x


def turned_vectors(rows: DataFrame, seed: int, key: str = "k", back: bool = False) -> DataFrame:
    """(k, y) of vectors (k, y), turned, or turned back."""
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({key: f[key], "y": list((turn_back if back else turn)(np.stack(f["y"].to_numpy()).astype(np.float64), seed))})

    return rows.select(key, "y").mapInPandas(run, f"{key} long, y array<double>")
