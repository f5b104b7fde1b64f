"""Entropies and informations in nats: of dense count tables (numpy), and of tables of cells (DataFrames)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entropy_from_counts(counts) -> float:
    """Entropy of counts of any shape; 0 for an empty table."""
    n = np.asarray(counts, float).ravel()
    if not n.sum():
        return 0.0
    p = n[n > 0] / n.sum()
    return float(-(p * np.log(p)).sum())


def joint_entropy_from_counts(table) -> float:
    return entropy_from_counts(table)


def conditional_mi(table) -> float:
    """I(X; Y | Z...) of counts with axes (X, Y, Z...): H(XZ) + H(YZ) - H(Z) - H(XYZ), cell by cell; not clipped."""
    t = np.asarray(table, float)
    if t.ndim < 2:
        raise ValueError("the table needs two axes at least")
    if not t.sum():
        return 0.0
    p = t / t.sum()
    xz, yz = p.sum(axis=1, keepdims=True), p.sum(axis=0, keepdims=True)
    z = xz.sum(axis=0, keepdims=True)
    there = p > 0
    ratio = p[there] * np.broadcast_to(z, p.shape)[there] / (np.broadcast_to(xz, p.shape)[there] * np.broadcast_to(yz, p.shape)[there])
    return float((p[there] * np.log(ratio)).sum())


def mutual_information(table) -> float:
    """I(X; Y) of a two-way table of counts."""
    if np.ndim(table) != 2:
        raise ValueError("the table needs exactly two axes")
    return conditional_mi(table)


# --- cells: one row for each combination that occurs, with its count ``n``


def entropy_of_cells(cells: DataFrame, by: list[str] = (), n: str = "n", name: str = "entropy") -> DataFrame:
    """Entropy of the cells of each group ``by``."""
    total = cells.groupBy(*by).agg(F.sum(F.col(n).cast("double")).alias("__n"), F.sum(F.col(n) * F.log(F.col(n).cast("double"))).alias("__s"))
    # -sum(n/N ln(n/N)) = ln N - sum(n ln n) / N
    return total.select(*by, (F.log("__n") - F.col("__s") / F.col("__n")).alias(name))


def mi_of_cells(cells: DataFrame, by: list[str], x: str = "x", y: str = "y", n: str = "n", name: str = "mi") -> DataFrame:
    """I(x; y) of each group."""
    return cmi_of_cells(cells, by, x, y, [], n, name)


def cmi_of_cells(cells: DataFrame, by: list[str], x: str, y: str, given: list[str], n: str = "n", name: str = "cmi") -> DataFrame:
    """I(x; y | given) of each group.

    The sum of n ln(n nz / (nxz nyz)) is that of n ln n over the cells and over their margins z, less that over xz and yz.
    All four come from one grouped sum over grouping sets, so nothing is sorted and no task has all cells of a group.
    Terms are added as decimals: the result doesn't depend on their order, equal columns have equal informations, and
    what cancels is 0.
    """
    by, given = list(by), list(given)
    every = [*by, *given, x, y]
    margins = [every, every[:-1], [*by, *given, y], [*by, *given]]
    sums = cells.groupingSets([[F.col(c) for c in m] for m in margins], *every).agg(F.sum(F.col(n).cast("double")).alias("__n"), F.grouping_id().alias("__g"))
    part = (F.col("__n") * F.log("__n")).cast("decimal(38,18)")
    total = sums.groupBy(*by).agg(F.sum(F.when(F.col("__g").isin(0, 3), part).otherwise(-part)).alias("__s"), F.sum(F.when(F.col("__g") == 0, F.col("__n"))).alias("__t"))
    return total.select(*by, (F.col("__s").cast("double") / F.col("__t")).alias(name))
