import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import InfoSelector
from gleaner.sources.planted import BLOCK, planted_rows

FEATURES = [{"name": "x0", "role": "informative", "levels": 0}, {"name": "x1", "role": "informative", "levels": 0}, {"name": "r", "role": "redundant", "of": "x0", "noise": 0.1}, {"name": "z", "role": "independent", "levels": 5}]
LINEAR = {"kind": "linear", "weights": {"x0": 1, "x1": 2}, "noise": 0.5, "thresholds": [-1.0, 1.0]}


def test_rows_do_not_depend_on_partitions(spark):
    n = 2 * BLOCK + 1000
    one, many = (planted_rows(spark, n, 7, FEATURES, LINEAR, parts) for parts in (1, 32))
    assert one.columns == ["x0", "x1", "r", "z", "y"] and many.rdd.getNumPartitions() == 32
    a, b = one.toPandas(), many.toPandas()
    assert len(a) == n and (a == b).all().all()
    assert not (a["x0"] == planted_rows(spark, n, 8, FEATURES, LINEAR).toPandas()["x0"]).any()
    assert np.std(a["r"] - a["x0"]) == pytest.approx(0.1, rel=0.02) and abs(np.corrcoef(a["x0"], a["x1"])[0, 1]) < 0.02 and abs(np.corrcoef(a["x0"][:BLOCK], a["x0"][BLOCK : 2 * BLOCK])[0, 1]) < 0.02
    assert sorted(a["z"].unique()) == [0, 1, 2, 3, 4] and sorted(a["y"].unique()) == [0, 1, 2]
    assert (a["y"] == (a["x0"] + 2 * a["x1"] > -1).astype(int) + (a["x0"] + 2 * a["x1"] > 1)).mean() > 0.8


def test_other_targets(spark):
    both = [{"name": "a", "role": "informative"}, {"name": "b", "role": "informative"}, {"name": "c", "role": "redundant", "of": "a"}, {"name": "n", "role": "independent"}]
    df = planted_rows(spark, 20_000, 1, both, {"kind": "and", "noise": 0.1})
    assert df.filter("y = a * b").count() / 20_000 == pytest.approx(0.9, abs=0.01) and df.filter("a <> c").count() == 0
    assert set(InfoSelector(target="y", max_features=2).fit(df).selected_features) == {"a", "b"}
    flip = planted_rows(spark, 20_000, 1, [{"name": "k", "role": "correlated", "agree": 0.8}], {"kind": "flip"})
    assert flip.filter("k = y").count() / 20_000 == pytest.approx(0.8, abs=0.01)
    with pytest.raises(ValueError):
        planted_rows(spark, 0, 1, both, {"kind": "and"})


def test_ten_million_rows_stay_on_the_executors(spark):
    got = planted_rows(spark, 10_000_000, 3, [{"name": "a", "role": "informative"}], {"kind": "and"}, 64).agg(F.count("*"), F.sum("a"), F.sum((F.col("a") != F.col("y")).cast("int"))).first()
    assert got[0] == 10_000_000 and got[1] / 1e7 == pytest.approx(0.5, abs=0.001) and got[2] == 0
