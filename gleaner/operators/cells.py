"""Contingency cells of coded columns: by one grouped count whose partial sums precede the shuffle, or (pairs) in tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.pair_tables import pair_cells, pair_informations

__all__ = ["both_ways", "budget", "dense", "feature_cells", "given_cells", "pair_cells", "pair_informations"]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def feature_cells(codes: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, x, y, n) of every feature against the target: all features in one pass."""
    named = codes.select(F.col(_q(target)).alias("y"), *[F.col(_q(f)).alias(f"f{i}") for i, f in enumerate(features)])
    long = named.unpivot(["y"], [f"f{i}" for i in range(len(features))], "i", "x")
    counts = long.groupBy("i", "x", "y").agg(F.count("*").alias("n"))
    names = F.create_map(*[F.lit(v) for i, f in enumerate(features) for v in (f"f{i}", f)])
    return counts.select(names[F.col("i")].alias("feature"), "x", "y", "n")


def given_cells(codes: DataFrame, features: list[str], target: str, given: list[str]) -> DataFrame:
    """(feature, x, y, z0.., n) of every feature against the target and the columns ``given``, in one pass."""
    z = [F.col(_q(g)).alias(f"z{i}") for i, g in enumerate(given)]
    named = codes.select(F.col(_q(target)).alias("y"), *z, *[F.col(_q(f)).alias(f"f{i}") for i, f in enumerate(features)])
    keep = ["y", *[f"z{i}" for i in range(len(given))]]
    long = named.unpivot(keep, [f"f{i}" for i in range(len(features))], "i", "x")
    counts = long.groupBy("i", "x", *keep).agg(F.count("*").alias("n"))
    names = F.create_map(*[F.lit(v) for i, f in enumerate(features) for v in (f"f{i}", f)])
    return counts.select(names[F.col("i")].alias("feature"), "x", *keep, "n")


def both_ways(pairs: DataFrame) -> DataFrame:
    """``pair_cells`` with each pair in both orders."""
    turned = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("xj").alias("xi"), F.col("xi").alias("xj"), "y", "n")
    return pairs.unionByName(turned)


def budget(n_codes: list[int], n_y: int) -> int:
    """Cells of all pairs with and without the target, were every combination to occur."""
    n = np.asarray(n_codes, float)
    return int((n.sum() ** 2 - (n**2).sum()) / 2 * (1 + n_y))


def dense(cells: DataFrame, shape: tuple[int, ...], axes: list[str]) -> np.ndarray:
    """A small table of cells as an array of counts."""
    out = np.zeros(shape, np.int64)
    for r in cells.select(*axes, "n").collect():
        out[tuple(r[:-1])] += r[-1]
    return out
