"""Stage 1: the information of every feature about the target, what of it is significant, and the candidates left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import SelectorConfig
from gleaner.functions.measures import mi_of_cells
from gleaner.operators import cells as C
from gleaner.operators import greedy
from gleaner.operators import profile as P
from gleaner.operators import significance as S


@dataclass
class Screening:
    """By feature, in their order; ``candidates`` are places by falling information."""

    names: list[str]
    mi: np.ndarray
    p: np.ndarray
    significant: np.ndarray
    candidates: list[int]
    n_rows: int

    def ranking(self) -> list[tuple[str, float]]:
        """All features with their information, most first."""
        return [(self.names[i], float(self.mi[i])) for i in greedy.ranked(self.mi)]

    def table(self, spark: SparkSession) -> DataFrame:
        """feature, mi, p, significant, rank (from 1)."""
        rank = {i: k + 1 for k, i in enumerate(greedy.ranked(self.mi))}
        rows = [(n, float(self.mi[i]), float(self.p[i]), bool(self.significant[i]), rank[i]) for i, n in enumerate(self.names)]
        return spark.createDataFrame(rows, "feature string, mi double, p double, significant boolean, rank int")


def screen(codes: DataFrame, features: list[P.Coding], target: P.Coding, config: SelectorConfig, n_rows: int) -> Screening:
    """Screens coded columns: one pass over them, a second over a sample for permutations."""
    names = [f.name for f in features]
    if not names:
        return Screening([], np.zeros(0), np.zeros(0), np.zeros(0, bool), [], n_rows)
    cells = C.feature_cells(codes, names, target.name).cache()
    try:
        return screen_cells(cells, features, target, config, n_rows, lambda some, rows: C.feature_cells(P.sampled(codes, n_rows, rows, config.seed), some, target.name))
    finally:
        cells.unpersist()


def screen_cells(cells: DataFrame, features: list[P.Coding], target: P.Coding, config: SelectorConfig, n_rows: int, of_sample: Callable[[list[str], int], DataFrame]) -> Screening:
    """Screens features by their cells (feature, x, y, n); ``of_sample`` gives the cells of some of them over about so many rows."""
    names = [f.name for f in features]
    found = {r["feature"]: r["mi"] for r in mi_of_cells(cells, ["feature"]).collect()}
    mi = np.array([found.get(n, 0.0) for n in names])
    if config.freedom == "table":
        freedom = np.array([(f.n_codes - 1) * (target.n_codes - 1) for f in features])
    else:
        there = {r["feature"]: (r["x"] - 1) * (r["y"] - 1) for r in cells.groupBy("feature").agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).collect()}
        freedom = np.array([there.get(n, 0) for n in names])
    verdict = S.make_significance_test(config).test(S.Screened(mi, n_rows, freedom, names, of_sample))
    return Screening(names, mi, verdict.p, verdict.significant, greedy.shortlist(mi, verdict.significant, config.screen_top_k), n_rows)
