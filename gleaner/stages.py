"""Selectors as stages of ``pyspark.ml`` pipelines: parameters, fitting, a model that saves and loads.

    Pipeline(stages=[FeatureSelector(labelCol="y", maxFeatures=5), LogisticRegression(labelCol="y")]).fit(df)

The model adds ``outputCol``, a vector of the selected columns: numbers as they are, categories by the codes they had when the selector was fitted, where a
missing or unknown category has a code of its own (their number) and a missing number is NaN.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.estimator import InfoSelector
from gleaner.operators import profile as P


class _Shared(Params):
    labelCol = Param(Params._dummy(), "labelCol", "the target", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "the vector of the selected columns", TypeConverters.toString)

    def getLabelCol(self) -> str:
        return self.getOrDefault(self.labelCol)

    def getOutputCol(self) -> str:
        return self.getOrDefault(self.outputCol)


class FeatureSelector(_Shared, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Selects columns by information about the label. ``inputCols``: the candidates (all columns but the label, if not given)."""

    inputCols = Param(Params._dummy(), "inputCols", "candidates", TypeConverters.toListString)
    criterion = Param(Params._dummy(), "criterion", "jmim, cmim, mrmr, mim or jmi", TypeConverters.toString)
    estimator = Param(Params._dummy(), "estimator", "histogram or ksg", TypeConverters.toString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "features to select at most", TypeConverters.toInt)
    screenTopK = Param(Params._dummy(), "screenTopK", "candidates after screening at most", TypeConverters.toInt)
    minScore = Param(Params._dummy(), "minScore", "least score", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of samples", TypeConverters.toInt)
    options = Param(Params._dummy(), "options", "further options of SelectorConfig, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol=None, outputCol=None, inputCols=None, criterion=None, estimator=None, maxFeatures=None, screenTopK=None, minScore=None, seed=None, options=None):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="features", criterion="jmim", estimator="histogram", maxFeatures=50, screenTopK=100, minScore=1e-4, seed=42, options="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FeatureSelectorModel:
        get, label = self.getOrDefault, self.getLabelCol()
        columns = get(self.inputCols) if self.isDefined(self.inputCols) else [c for c in dataset.columns if c != label]
        most = get(self.maxFeatures)
        options: dict[str, Any] = {"target": label, "estimator": get(self.estimator), "max_features": most, "screen_top_k": max(most, get(self.screenTopK)), "min_score": get(self.minScore), "seed": get(self.seed)} | json.loads(get(self.options))
        found = InfoSelector(get(self.criterion), **options).fit(dataset.select(*[P._col(c) for c in dict.fromkeys([*columns, label])]))
        model = FeatureSelectorModel()
        codes = {n: [v for v, _ in sorted(c.codes.items(), key=lambda kv: kv[1])] for n, c in found.codings_.items() if c.kind == "categorical"}
        model._set(selectedFeatures=found.selected_features, scores=found.scores_, ranking=json.dumps(found.ranking_), codes=json.dumps(codes))
        return self._copyValues(model)


class FeatureSelectorModel(_Shared, Model, DefaultParamsReadable, DefaultParamsWritable):
    """What was selected; all of it is saved with the parameters."""

    selectedFeatures = Param(Params._dummy(), "selectedFeatures", "selected columns, best first", TypeConverters.toListString)
    scores = Param(Params._dummy(), "scores", "their scores", TypeConverters.toListFloat)
    ranking = Param(Params._dummy(), "ranking", "all candidates with their information, as JSON", TypeConverters.toString)
    codes = Param(Params._dummy(), "codes", "values of selected categories by code, as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="features", selectedFeatures=[], scores=[], ranking="[]", codes="{}")

    @property
    def selected_features(self) -> list[str]:
        return list(self.getOrDefault(self.selectedFeatures))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        codes, inputs = json.loads(self.getOrDefault(self.codes)), []
        out, mark = dataset, "__selected"
        while any(c.startswith(mark) for c in dataset.columns):
            mark += "_"
        for i, name in enumerate(self.selected_features):
            if name in codes:
                known = F.create_map(*[F.lit(v) for k, value in enumerate(codes[name]) for v in (value, float(k))]) if codes[name] else F.lit(None).cast("map<string, double>")
                x = F.coalesce(F.try_element_at(known, P.as_text(dataset, name)), F.lit(float(len(codes[name]))))
            else:
                x = P.as_number(dataset, name)
            out = out.withColumn(f"{mark}{i}", x)
            inputs.append(f"{mark}{i}")
        return VectorAssembler(inputCols=inputs, outputCol=self.getOutputCol(), handleInvalid="keep").transform(out).drop(*inputs)
