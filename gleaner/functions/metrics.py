"""AUC, macro AUC and R2: of arrays, and of DataFrames without bringing rows to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal values share their mean rank."""
    _, back, count = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[back]


def auc_binary(y, score) -> float:
    """Chance that a positive outscores a negative, ties half; 0.5 with one class only."""
    y, score = np.asarray(y) == 1, np.asarray(score, float)
    pos, neg = int(y.sum()), int((~y).sum())
    if not pos or not neg:
        return 0.5
    return float((average_ranks(score)[y].sum() - pos * (pos + 1) / 2) / (pos * neg))


def auc_macro(y, scores) -> float:
    """Mean of each present class's AUC against the rest; column k of ``scores`` belongs to label k."""
    y, scores = np.asarray(y).astype(int), np.asarray(scores, float)
    return float(np.mean([auc_binary(y == k, scores[:, k]) for k in np.unique(y)]))


def r2_score(y, predicted) -> float:
    """1 - residual / total sum of squares; 0 if y is constant."""
    y, predicted = np.asarray(y, float), np.asarray(predicted, float)
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - predicted) ** 2).sum() / total) if total else 0.0


def auc_of_cells(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """``auc`` of each group from (*by, s, p, n): by score s, how many rows are positive and how many there are.

    Scores are cut into ranges; a window runs within each range, and the ranges' totals (one row each) are summed by a
    second one, so no task has all scores. 0.5 where only one class is there.
    """
    kinds = cells.groupBy(*by, "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).withColumn("q", F.col("n") - F.col("p"))
    ranged = kinds.repartitionByRange(*by, "s").withColumn("part", F.spark_partition_id())
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("under", F.coalesce(F.sum("q").over(before(Window.partitionBy(*by, "part").orderBy("s"))), F.lit(0)))
    parts = inside.groupBy(*by, "part").agg(F.sum(F.col("p") * (F.col("under") + F.col("q") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    parts = parts.withColumn("won", F.col("won") + F.col("p") * F.coalesce(F.sum("q").over(before(Window.partitionBy(*by).orderBy("part"))), F.lit(0)))
    sums = parts.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return sums.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / F.col("pos") / F.col("neg")).otherwise(F.lit(0.5)).alias("auc"))


def auc_of_rows(df: DataFrame, positive: Column, score: Column, weight: Column | None = None) -> DataFrame:
    """One row, ``auc``. ``weight``: for how many rows a row stands."""
    n = F.lit(1) if weight is None else weight
    return auc_of_cells(df.groupBy(score.alias("s")).agg(F.sum(F.when(positive, n).otherwise(0).cast("long")).alias("p"), F.sum(n.cast("long")).alias("n")))


def macro_auc_of_rows(df: DataFrame, label: Column, scores: Column) -> DataFrame:
    """One row, ``auc``: the mean over the labels present (0, 1, ...) of each against the rest; label k's score is item k."""
    long = df.select(label.cast("int").alias("y"), F.posexplode(scores).alias("k", "s"))
    cells = long.groupBy("k", "s").agg(F.sum((F.col("y") == F.col("k")).cast("long")).alias("p"), F.count("*").alias("n"))
    there = df.select(label.cast("int").alias("k")).distinct()
    return auc_of_cells(cells, ["k"]).join(F.broadcast(there), "k").agg(F.avg("auc").alias("auc"))


def r2_of_rows(df: DataFrame, y: Column, predicted: Column) -> DataFrame:
    """One row, ``r2``: sums only, by the two-pass formula."""
    mean = df.agg(F.avg(y).alias("mean"))
    sums = df.select(y.alias("y"), predicted.alias("p")).crossJoin(F.broadcast(mean)).agg(F.sum((F.col("y") - F.col("p")) ** 2).alias("res"), F.sum((F.col("y") - F.col("mean")) ** 2).alias("tot"))
    return sums.select(F.when(F.col("tot") == 0, F.lit(0.0)).otherwise(1 - F.col("res") / F.col("tot")).alias("r2"))
