"""fit -> model: from a DataFrame to an ordered, non-redundant set of features."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import SelectorConfig
from gleaner.functions.measures import cmi_of_cells
from gleaner.operators import cells as C
from gleaner.operators import evaluate, greedy, neighbours
from gleaner.operators import profile as P
from gleaner.operators.screening import screen

#: Names of the stages in ``timings_``.
STAGES = ("etapa0", "etapa1", "etapa2", "etapa3")


@dataclass
class SelectorModel:
    selected_features: list[str]
    scores_: list[float]
    ranking_: list[tuple[str, float]]
    criterion: str
    n_rows: int
    target: str
    task: str
    timings_: dict[str, float] = field(default_factory=dict)
    #: How the selected columns were coded (not of nearest neighbours, which take numbers as they are).
    codings_: dict[str, P.Coding] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.selected_features) != len(self.scores_):
            raise ValueError(f"{len(self.selected_features)} features, but {len(self.scores_)} scores")

    def transform(self, df: DataFrame) -> DataFrame:
        """The selected columns and the target."""
        return df.select(*[f"`{c}`" for c in (*self.selected_features, self.target)])

    def report(self, df: DataFrame, model: Any = "gbt", task: str | None = None) -> evaluate.EvaluationReport:
        return evaluate.report(df, self.selected_features, [name for name, _ in self.ranking_], self.target, model, task or self.task)


class _Clock:
    def __init__(self) -> None:
        self.first = self.last = time.time()
        self.found: dict[str, float] = {}

    def lap(self, name: str) -> None:
        now = time.time()
        self.found[name], self.last = now - self.last, now
        self.found["total"] = now - self.first


class InfoSelector:
    """Selects features of a DataFrame by information about a target."""

    def __init__(self, criterion: str = "jmim", **config: Any):
        if criterion not in greedy.CRITERIA:
            raise ValueError(f"criterion must be one of {greedy.CRITERIA}, not {criterion!r}")
        self.criterion, self.config = criterion, SelectorConfig(**config)

    def fit(self, df: DataFrame) -> SelectorModel:
        return self._by_neighbours(df) if self.config.estimator == "ksg" else self._by_cells(df)

    def _search(self, info: greedy.Informations) -> greedy.Chosen:
        c = self.config
        return greedy.choose(info, self.criterion, c.max_features, c.min_score, c.cmim_m, c.cmim_approx)

    def _by_cells(self, df: DataFrame) -> SelectorModel:
        c, clock = self.config, _Clock()
        task = P.task_of(df, c.target, c.task)
        features, target, n_before = P.codings(df, P.kinds_of(df, c), c, task)
        codes = P.encoded(df, features, target, c.missing).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n_rows = codes.count() if c.missing == "drop" else n_before
            clock.lap(STAGES[0])
            screening = screen(codes, features, target, c, n_rows)
            short = list(screening.candidates)
            while len(short) > 1 and C.budget([features[i].n_codes for i in short], target.n_codes) > c.max_cache_cells:
                short.pop()
            clock.lap(STAGES[1])
            if not short:
                return SelectorModel([], [], screening.ranking(), self.criterion, n_rows, c.target, task, clock.found)
            picked = [features[i] for i in short]
            most = n_rows if c.subsample is None else min(n_rows, c.subsample)
            sample = P.sampled(codes, n_rows, most, c.seed)
            info = self._matrices(sample, picked, target, screening.mi[short], most)
            clock.lap(STAGES[2])
            chosen = self._search(info)
            clock.lap(STAGES[3])
            coded = {picked[i].name: picked[i] for i in chosen.places}
            return SelectorModel(list(coded), chosen.scores, screening.ranking(), self.criterion, n_rows, c.target, task, clock.found, coded)
        finally:
            codes.unpersist()

    def _matrices(self, sample: DataFrame, codings: list[P.Coding], target: P.Coding, mi: np.ndarray, rows: int) -> greedy.Matrices:
        picked, k = [c.name for c in codings], len(codings)
        pair, cmi = np.zeros((k, k)), np.zeros((k, k))
        if k > 1 and self.criterion != "cmim" or self.config.cmim_approx:
            sizes = [c.n_codes for c in codings]
            for r in C.pair_informations(sample, picked, target.name, sizes, target.n_codes, rows).collect():
                i, j = r["i"], r["j"]
                pair[i, j] = pair[j, i] = r["mi"]
                cmi[i, j], cmi[j, i] = r["gain_i"], r["gain_j"]

        def fixed(some: list[int]) -> np.ndarray:
            return self.fixed_gains(sample, picked, [picked[i] for i in some])

        return greedy.Matrices(mi, pair, cmi, fixed)

    def fixed_gains(self, codes: DataFrame, features: list[str], given: list[str]) -> np.ndarray:
        """I(x; y | given without x): one pass for all features outside ``given``, one for each inside."""
        out = dict.fromkeys(features, 0.0)
        groups = [([f for f in features if f not in given], given)] + [([g], [o for o in given if o != g]) for g in given]
        for some, z in groups:
            if some:
                found = C.given_cells(codes, some, self.config.target, z)
                out |= {r["feature"]: r["cmi"] for r in cmi_of_cells(found, ["feature"], "x", "y", [f"z{i}" for i in range(len(z))]).collect()}
        return np.array([out[f] for f in features])

    def _by_neighbours(self, df: DataFrame) -> SelectorModel:
        c, clock = self.config, _Clock()
        task = P.task_of(df, c.target, c.task)
        names = []
        for f in df.schema.fields:
            if f.name == c.target or f.name in c.exclude:
                continue
            if not isinstance(f.dataType, P.NUMBERS):
                raise ValueError(f"nearest neighbours need numbers; {f.name} is {f.dataType.simpleString()}")
            names.append(f.name)
        kind = df.schema[c.target].dataType
        if task == "continuous" and not isinstance(kind, P.NUMBERS) or not isinstance(kind, P.NUMBERS + P.CATEGORIES):
            raise ValueError(f"nearest neighbours can't use the target {c.target} of type {kind.simpleString()}")
        n_rows = df.count()
        clock.lap(STAGES[0])
        if not names:
            return SelectorModel([], [], [], self.criterion, n_rows, c.target, task, clock.found)
        sample = P.sampled(df.select(*[P._col(n) for n in (*names, c.target)]), n_rows, c.ksg_subsample, c.seed)
        with neighbours.KnnInformations(sample, names, c.target, task == "continuous", c.ksg_k) as info:
            mi = info.relevance()
            short = greedy.ranked(mi)[: c.screen_top_k]
            clock.lap(STAGES[1])
            chosen = self._search(info.only(short))
            clock.lap(STAGES[3])
        picked = [names[i] for i in short]
        return SelectorModel([picked[i] for i in chosen.places], chosen.scores, [(names[i], float(mi[i])) for i in greedy.ranked(mi)], self.criterion, n_rows, c.target, task, clock.found)


class JMIMSelector(InfoSelector):
    def __init__(self, **config: Any):
        super().__init__("jmim", **config)


class CMIMSelector(InfoSelector):
    def __init__(self, **config: Any):
        super().__init__("cmim", **config)


class MRMRSelector(InfoSelector):
    def __init__(self, **config: Any):
        super().__init__("mrmr", **config)


class MIMSelector(InfoSelector):
    def __init__(self, **config: Any):
        super().__init__("mim", **config)
