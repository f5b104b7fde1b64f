"""Is an information more than chance? G-test, permutation of one margin, and control of false discoveries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import SelectorConfig
from gleaner.functions.measures import mutual_information
from gleaner.functions.special import chi2_tail

#: Two tables with the same information may differ in the last bits.
_SLACK = 1e-12


def g_pvalue(n: float, mi: float, freedom: int) -> float:
    """p of G = 2 n MI with so many degrees of freedom; 1 without rows or degrees."""
    return 1.0 if n <= 0 or freedom <= 0 else chi2_tail(2 * n * mi, freedom)


def permutation_pvalue(observed: float, null) -> float:
    """(1 + how many of ``null`` reach ``observed``) / (1 + how many there are)."""
    null = np.asarray(null, float)
    return float((1 + (null >= observed - _SLACK).sum()) / (1 + len(null)))


def false_discovery_mask(p, q: float) -> np.ndarray:
    """Benjamini-Hochberg: reject the smallest p up to the last one at or below its share of q."""
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    passed = np.flatnonzero(p[order] <= q * np.arange(1, len(p) + 1) / max(len(p), 1))
    out = np.zeros(len(p), bool)
    if len(passed):
        out[order[: passed[-1] + 1]] = True
    return out


def with_discoveries(df: DataFrame, p: str = "p", q: float = 0.05, tie: str = "feature") -> DataFrame:
    """``df`` (a row a test) with ``significant`` by Benjamini-Hochberg, in DataFrame terms.

    Ranks are counted within ranges of p and added up by range, so no task has all tests; the largest p that passes then decides.
    """
    ranged = df.select(F.col(p).alias("p"), F.col(tie).alias("tie")).repartitionByRange("p", "tie").withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        before, total = [], 0
        for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # a row a range
            before.append((part, total))
            total += n
        placed = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("p", "tie")))
        placed = placed.join(F.broadcast(df.sparkSession.createDataFrame(before, "part int, before long")), "part")
        last = placed.filter(F.col("p") <= (F.col("before") + F.col("k")) * q / total).agg(F.max("p")).first()[0] if total else None
    finally:
        ranged.unpersist()
    return df.withColumn("significant", F.coalesce(F.col(p) <= F.lit(last).cast("double"), F.lit(False)))


def random_tables(rows: np.ndarray, columns: np.ndarray, times: int, seed: int) -> np.ndarray:
    """Tables with these margins as a random permutation of one variable would give them."""
    rng = np.random.default_rng(seed)
    out = np.zeros((times, len(rows), len(columns)), np.int64)
    for t in range(times):
        left = columns.copy()
        for i, r in enumerate(rows[:-1]):
            out[t, i] = rng.multivariate_hypergeometric(left, int(r))
            left = left - out[t, i]
        out[t, -1] = left
    return out


def permutation_pvalues(cells: DataFrame, times: int, seed: int) -> DataFrame:
    """(feature, p) from cells (feature, x, y, n): the null needs only the margins, so no data pass; one task a feature."""

    def test(g: pd.DataFrame) -> pd.DataFrame:
        t = g.pivot_table(index="x", columns="y", values="n", aggfunc="sum", fill_value=0).to_numpy().astype(np.int64)
        observed = mutual_information(t)
        mix = abs(hash(tuple(map(ord, g.feature.iloc[0])))) % (1 << 31)
        null = [mutual_information(x) for x in random_tables(t.sum(1), t.sum(0), times, seed * 7919 + mix)]
        return pd.DataFrame({"feature": [g.feature.iloc[0]], "p": [permutation_pvalue(observed, null)]})

    return cells.groupBy("feature").applyInPandas(test, "feature string, p double")


@dataclass
class Verdict:
    """p-values and which of the features are significant, in the features' order."""

    p: np.ndarray
    significant: np.ndarray


@dataclass
class Screened:
    """What a test may ask of stage 1: informations, rows, degrees of freedom, and cells of some features of a sample."""

    mi: np.ndarray
    n: int
    freedom: np.ndarray
    names: list[str]
    cells: Callable[[list[str], int], DataFrame] | None = None


class SignificanceTest(Protocol):
    """Any object with this method can be given as a selector's ``significance``."""

    def test(self, data: Screened) -> Verdict: ...


@dataclass
class GTest:
    """G = 2 n MI of every feature, false discoveries controlled over all."""

    q: float = 0.05

    def test(self, data: Screened) -> Verdict:
        p = np.array([g_pvalue(data.n, m, int(f)) for m, f in zip(data.mi, data.freedom, strict=True)])
        return Verdict(p, false_discovery_mask(p, self.q))


@dataclass
class PermutationTest:
    """Permutations for the ``tested`` features of most information, on about ``rows`` rows; p = 1 for the others."""

    q: float = 0.05
    times: int = 100
    rows: int = 50_000
    tested: int = 100
    seed: int = 42

    def test(self, data: Screened) -> Verdict:
        best = np.argsort(-data.mi, kind="stable")[: self.tested]
        p, significant = np.ones(len(data.mi)), np.zeros(len(data.mi), bool)
        if len(best):
            some = [data.names[i] for i in best]
            found = {r["feature"]: r["p"] for r in permutation_pvalues(data.cells(some, self.rows), self.times, self.seed).collect()}
            p[best] = [found.get(n, 1.0) for n in some]
            significant[best] = false_discovery_mask(p[best], self.q)
        return Verdict(p, significant)


class NoTest:
    """Every feature is significant."""

    def test(self, data: Screened) -> Verdict:
        return Verdict(np.ones(len(data.mi)), np.ones(len(data.mi), bool))


def make_significance_test(config: SelectorConfig) -> SignificanceTest:
    if config.significance is None:
        return NoTest()
    if config.significance == "chi2":
        return GTest(config.fdr_q)
    if config.significance == "permutation":
        return PermutationTest(config.fdr_q, config.n_permutations, config.permutation_rows, config.screen_top_k, config.seed)
    return config.significance
