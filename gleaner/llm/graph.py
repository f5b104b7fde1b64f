"""Connected components of an edge table, by rounds of contraction on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Each round points every node at the least of itself and its neighbours, and keeps the edges between different
    pointers. Minima are combined before each shuffle, so a node with very many edges is no hot key. A node's pointer
    is reachable from it and never larger, and the smallest node of a component points at itself, so the last
    pointers are the roots. Nothing is collected but whether edges are left.
    """
    left = staged(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a != b").distinct(), "edges")
    labels = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "pointers")
        # one jump more: the pointer's own pointer
        jump = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
        point = staged(point.join(jump, "root").select("node", F.col("next").alias("root")), "pointers")
        if labels is None:
            labels = point
        else:
            moved = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = staged(labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        of = lambda c: point.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = left.join(of("a"), "a").join(of("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        left = staged(moved.filter("a != b").distinct(), "edges")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def contracted(roots: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``roots`` (node, root) after ``edges`` are added: only edges between different roots are contracted."""

    def moved(table: DataFrame, on: str) -> DataFrame:
        return table.join(roots.select(F.col("node").alias(on), F.col("root").alias("r")), on, "left").withColumn(on, F.coalesce("r", on)).drop("r")

    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).distinct().join(roots, "node", "left_anti")
    above = components(moved(moved(edges.select(a, b), a), b), a, b).select(F.col("node").alias("root"), F.col("root").alias("r"))
    every = roots.unionByName(nodes.select("node", F.col("node").alias("root")))
    return staged(every.join(above, "root", "left").select("node", F.coalesce("r", "root").alias("root")), "roots")
