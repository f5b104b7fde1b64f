import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from gleaner import InfoSelector
from gleaner.stages import FeatureSelector, FeatureSelectorModel


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.standard_normal((3, 1500))
    w = rng.integers(0, 3, 1500)
    y = (a + (w == 1) + 0.3 * b > 0.5).astype(int)
    return spark.createDataFrame(list(zip(a.tolist(), b.tolist(), c.tolist(), ["uvw"[v] for v in w], y.tolist())), "a double, b double, c double, w string, y long").cache()


def test_same_selection_as_the_plain_selector(table):
    model = FeatureSelector(labelCol="y", outputCol="v", maxFeatures=2).fit(table)
    plain = InfoSelector(target="y", max_features=2).fit(table)
    assert model.selected_features == plain.selected_features and set(plain.selected_features) == {"a", "w"}
    assert model.getOrDefault("scores") == plain.scores_
    rows = model.transform(table.withColumn("__selected0", F.lit(1))).collect()
    codes = plain.codings_["w"].codes
    at = {n: i for i, n in enumerate(model.selected_features)}
    assert all(r["v"][at["a"]] == r["a"] and r["v"][at["w"]] == codes[r["w"]] and r["__selected0"] == 1 for r in rows)
    new = table.limit(1).withColumn("w", F.lit("unknown")).unionByName(table.limit(1).withColumn("w", F.lit(None).cast("string")))
    assert [r["v"][at["w"]] for r in model.transform(new).collect()] == [3.0, 3.0]
    only = FeatureSelector(labelCol="y", inputCols=["b", "c"], criterion="mrmr", options='{"significance": null}').fit(table)
    assert "a" not in only.selected_features and only.selected_features[0] == "b"


def test_saved_and_loaded(table, tmp_path):
    stage = FeatureSelector(labelCol="y", maxFeatures=3, criterion="mim", options='{"bins": 5}')
    stage.save(str(tmp_path / "stage"))
    again = FeatureSelector.load(str(tmp_path / "stage"))
    assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in stage.extractParamMap().items()}
    model = stage.fit(table)
    model.save(str(tmp_path / "model"))
    loaded = FeatureSelectorModel.load(str(tmp_path / "model"))
    assert loaded.selected_features == model.selected_features and loaded.transform(table).collect() == model.transform(table).collect()


def test_in_a_pipeline_and_in_cross_validation(table, tmp_path):
    selector = FeatureSelector(labelCol="y", maxFeatures=2)
    pipeline = Pipeline(stages=[selector, LogisticRegression(labelCol="y", maxIter=5)])
    fitted = pipeline.fit(table)
    score = BinaryClassificationEvaluator(labelCol="y")
    assert score.evaluate(fitted.transform(table)) > 0.8
    fitted.write().overwrite().save(str(tmp_path / "pipeline"))
    again = PipelineModel.load(str(tmp_path / "pipeline"))
    assert again.stages[0].selected_features == fitted.stages[0].selected_features
    assert again.transform(table).select("prediction").collect() == fitted.transform(table).select("prediction").collect()
    grid = ParamGridBuilder().addGrid(selector.maxFeatures, [1, 2]).build()
    best = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=score, numFolds=2, seed=1).fit(table)
    assert len(best.bestModel.stages[0].selected_features) == 2 and len(best.avgMetrics) == 2
