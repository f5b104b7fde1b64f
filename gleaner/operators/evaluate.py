"""What a selection is worth: a model trained on it, and on every prefix of the ranking."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any, Protocol

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.config import TASKS, SelectorConfig
from gleaner.functions.metrics import auc_of_rows, macro_auc_of_rows, r2_of_rows
from gleaner.operators.profile import NUMBERS, as_text, coded, codings_of, number_stats, task_of

#: Older names of the tasks.
_OLD_NAMES = {"classification": "classifier_multiclass", "regression": "continuous", None: "auto"}


#: Column of a counted table: for how many rows a row stands.
_ROWS = "rows that are so"


class ModelFactory(Protocol):
    """Trains on (features, label) and returns the rows with ``probability`` (a vector) or ``prediction``."""

    name: str

    def train(self, df_vec: DataFrame, task: str, label_col: str) -> DataFrame: ...


class GbtFactory:
    """Boosted trees; with more than two classes, which Spark's don't know, a random forest."""

    name = "gbt"
    #: Bins into which trees cut a number. Of two classes, rows in the same bins may come as one row with the column ``weight``.
    bins = 64

    def train(self, df_vec: DataFrame, task: str, label_col: str) -> DataFrame:
        from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
        from pyspark.ml.regression import GBTRegressor

        if task == "continuous":
            model = GBTRegressor(labelCol=label_col, maxBins=self.bins, seed=42)
        else:
            two = df_vec.agg(F.max(label_col)).first()[0] <= 1
            model = (GBTClassifier if two else RandomForestClassifier)(labelCol=label_col, maxBins=self.bins, seed=42)
        if "weight" in df_vec.columns:
            model = model.setWeightCol("weight")
        return model.fit(df_vec).transform(df_vec)


class _Optional:
    """A backend of another package, imported when used."""

    name, module, classes, label = "", "", ("", ""), ""

    def train(self, df_vec: DataFrame, task: str, label_col: str) -> DataFrame:
        import importlib

        kind = getattr(importlib.import_module(self.module), self.classes[task == "continuous"])
        return kind(**{self.label: label_col}).fit(df_vec).transform(df_vec)


class XgboostFactory(_Optional):
    name, module, classes, label = "xgboost", "xgboost.spark", ("SparkXGBClassifier", "SparkXGBRegressor"), "label_col"


class LightgbmFactory(_Optional):
    name, module, classes, label = "lightgbm", "synapse.ml.lightgbm", ("LightGBMClassifier", "LightGBMRegressor"), "labelCol"


def make_model_factory(name: str) -> ModelFactory:
    known = {f.name: f for f in (GbtFactory, XgboostFactory, LightgbmFactory)}
    if name not in known:
        raise ValueError(f"the model must be one of {sorted(known)}, not {name!r}")
    return known[name]()


def _task(df: DataFrame, target: str, task: str | None) -> str:
    task = _OLD_NAMES.get(task, task)
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}, not {task!r}")
    return task_of(df, target) if task == "auto" else task


def _vectors(df: DataFrame, features: list[str], target: str, task: str) -> DataFrame:
    """(features, label): texts, dates and times are indexed by frequency, a class label by its order; nulls are kept."""
    cols, words = [F.col(_ROWS).cast("double").alias("weight")] if _ROWS in df.columns else [], []
    for i, f in enumerate(features):
        kind = df.schema[f].dataType
        if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            words.append(f"f{i}")
            cols.append(as_text(df, f).alias(f"f{i}"))
        else:
            cols.append(F.col(f"`{f}`").cast("double").alias(f"f{i}"))
    y = F.col(f"`{target}`")
    out = df.select(*cols, (y.cast("double") if task == "continuous" else y.cast("string")).alias("y")).filter("y is not null")
    if task == "continuous":
        out = out.withColumnRenamed("y", "label")
    else:
        out = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(out).transform(out).drop("y")
    if words:
        out = StringIndexer(inputCols=words, outputCols=[f"{w}_code" for w in words], handleInvalid="keep").fit(out).transform(out)
    inputs = [f"f{i}_code" if f"f{i}" in words else f"f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(out).select("features", "label", *(["weight"] if _ROWS in df.columns else []))


#: Trainings that run side by side; combinations of bins up to which rows are counted before trees are trained.
PARALLEL, KINDS = 4, 1 << 18


def _counted(df: DataFrame, features: list[str], target: str, bins: int) -> DataFrame | None:
    """(features as bins, target, rows) by one grouped count, if all features are numbers with KINDS combinations at most and the target has two classes.

    Trees cut numbers into bins first and then use nothing but the bins, so rows in the same bins with one target are as good as one row with a weight.
    """
    if target in features or any(not isinstance(df.schema[f].dataType, NUMBERS) for f in features):
        return None
    stats, _ = number_stats(df.filter(F.col(f"`{target}`").isNotNull()), dict.fromkeys(features, bins))
    config = SelectorConfig(target=target, bins=bins, missing="drop")
    cuts, _ = codings_of(stats, {target: []}, dict.fromkeys(features, bins), dict.fromkeys(features, "numeric"), config, TASKS[2])
    if math.prod(c.n_codes + 1 for c in cuts) > KINDS:
        return None
    kinds = coded(df, cuts, (target,)).filter(F.col(f"`{target}`").isNotNull())
    counts = kinds.groupBy(*[f"`{c}`" for c in kinds.columns]).agg(F.count("*").alias(_ROWS)).persist(StorageLevel.MEMORY_AND_DISK)
    if len(counts.select(f"`{target}`").distinct().take(3)) == 2:
        return counts
    counts.unpersist()
    return None


class Trainings:
    """Models of some features of a table each. The table is indexed and assembled once, and kept by the executors until the end of the ``with`` block.

    Subsets are sliced from the vectors, in the order asked for. Up to ``parallel`` trainings run side by side, each in a thread of its own and in a
    pool of its own where the session schedules fairly.
    """

    def __init__(self, df: DataFrame, features: list[str], target: str, model: Any = "gbt", task: str | None = None, parallel: int = PARALLEL):
        self.task, self.parallel = _task(df, target, task), max(1, parallel)
        self.factory = make_model_factory(model) if isinstance(model, str) else model
        self.place = {f: i for i, f in enumerate(dict.fromkeys(features))}
        self.counts = None
        if self.task != "continuous" and self.place and isinstance(self.factory, GbtFactory):
            self.counts = _counted(df, list(self.place), target, self.factory.bins)
        vectors = _vectors(df if self.counts is None else self.counts, list(self.place), target, self.task)
        self.vectors = (vectors if self.counts is None else vectors.coalesce(1)).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> Trainings:
        return self

    def __exit__(self, *_) -> None:
        self.vectors.unpersist()
        if self.counts is not None:
            self.counts.unpersist()

    def worth(self, features: list[str]) -> float:
        """AUC (macro for more classes) or R2 of a model on its training rows. Metrics are aggregates: no rows reach the driver."""
        sliced = self.vectors
        if (at := [self.place[f] for f in features]) != list(range(len(self.place))):
            sliced = VectorSlicer(inputCol="features", outputCol="some", indices=at).transform(self.vectors).drop("features").withColumnRenamed("some", "features")
        rows = self.factory.train(sliced, self.task, "label")
        if self.task == "continuous":
            return float(r2_of_rows(rows, F.col("label"), F.col("prediction")).first()[0])
        weight = F.lit(1) if self.counts is None else F.col("weight")
        rows = rows.select("label", vector_to_array("probability").alias("p"), weight.alias("weight")).cache()
        try:
            width = rows.select(F.max(F.size("p"))).first()[0] or 0
            found = auc_of_rows(rows, F.col("label") == 1, F.col("p")[1], F.col("weight")) if width == 2 else macro_auc_of_rows(rows, F.col("label"), F.col("p"))
            value = found.first()[0]
            return 0.5 if value is None else float(value)
        finally:
            rows.unpersist()

    def all_of(self, subsets: list[list[str]]) -> list[float]:
        """The worth of each subset; equal ones are trained once."""
        kinds = list(dict.fromkeys(map(tuple, subsets)))
        spark = self.vectors.sparkSession

        def task(k: int) -> float:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"training {k % self.parallel}")
            return self.worth(list(kinds[k]))

        with ThreadPool(min(self.parallel, max(1, len(kinds)))) as pool:
            found = dict(zip(kinds, pool.map(inheritable_thread_target(spark)(task), range(len(kinds)), chunksize=1), strict=True))
        return [found[tuple(s)] for s in subsets]


def train_and_evaluate(df: DataFrame, feature_cols: list[str], target_col: str, model: Any = "gbt", task: str | None = None) -> float:
    """AUC (macro for more classes) or R2 of a model on its training rows."""
    with Trainings(df, list(feature_cols), target_col, model, task) as trainings:
        return trainings.worth(list(feature_cols))


def efficiency_curve(df: DataFrame, feature_order: list[str], target_col: str, model: Any = "gbt", task: str | None = None, parallel: int = PARALLEL) -> list[tuple[int, float]]:
    """(k, the metric of the first k features) for every prefix of ``feature_order``."""
    order = list(feature_order)
    if not order:
        return []
    with Trainings(df, order, target_col, model, task, parallel) as trainings:
        found = trainings.all_of([order[:k] for k in range(1, len(order) + 1)])
    return list(enumerate(found, 1))


@dataclass
class EvaluationReport:
    model_name: str
    task: str
    metric_selected: float
    metric_all: float
    selected_features: list[str]
    efficiency_curve: list[tuple[int, float]] = field(default_factory=list)

    def summary(self) -> dict[str, Any]:
        # fixed values: the keys
        return {
            "model": self.model_name,
            "task": self.task,
            "metric_selected": self.metric_selected,
            "metric_all": self.metric_all,
            "n_selected": len(self.selected_features),
            "efficiency_curve": list(self.efficiency_curve),
        }


def report(df: DataFrame, selected_features: list[str], ranking: list[str], target_col: str, model: Any = "gbt", task: str | None = None, all_features: list[str] | None = None, parallel: int = PARALLEL) -> EvaluationReport:
    """Selected against all features (of the table, unless named), and the curve along the ranking: all from one assembled table."""
    every = [c for c in df.columns if c != target_col] if all_features is None else list(all_features)
    chosen, order = list(selected_features), list(ranking)
    with Trainings(df, [*every, *chosen, *order], target_col, model, task, parallel) as t:
        selected, whole, *curve = t.all_of([chosen, every, *(order[:k] for k in range(1, len(order) + 1))])
        return EvaluationReport(getattr(t.factory, "name", type(t.factory).__name__), t.task, selected, whole, chosen, list(enumerate(curve, 1)))
