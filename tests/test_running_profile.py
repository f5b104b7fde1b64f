import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import SelectorConfig
from gleaner.operators import profile as P
from gleaner.operators import running_profile as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 12_000
    rows = list(zip(range(n), rng.gamma(2, size=n).tolist(), [float(v) for v in rng.integers(0, 4, n)], [None if v == 0 else f"w{v % 70}" for v in rng.zipf(1.4, n).tolist()], [int(v) for v in rng.integers(0, 3, n)], [None if i % 4 else float(i) for i in range(n)]))
    return spark.createDataFrame(rows, "id long, x double, steps double, w string, y long, gaps double").withColumn("none", F.lit(None).cast("double")).cache()


@pytest.mark.parametrize(("task", "target"), [("classifier_multiclass", "y"), ("continuous", "x")])
def test_parts_add_up_to_the_whole(spark, table, tmp_path, task, target):
    config = SelectorConfig(target=target, exclude=("id",), max_categories=20)
    kinds = P.kinds_of(table, config)
    stored = R.StoredProfile(spark, str(tmp_path / "p"), kinds, config, task)
    parts = {"a/1": table.filter("id < 100"), "b": table.filter("id >= 100 AND id < 9000"), "c d": table.filter("id >= 9000"), "empty": table.filter("id < 0")}
    for name, rows in parts.items():
        stored.add(rows, name)
    stored.add(parts["b"], "b")  # comes again
    features, y, n = stored.codings()
    want, want_y, want_n = P.codings(table, kinds, config, task, exact=True)
    assert n == want_n == 12_000 and [c.name for c in features] == [c.name for c in want]
    for got, exact in zip([*features, y], [*want, want_y]):
        assert (got.codes, got.n_codes, got.missing_code, got.other_code) == (exact.codes, exact.n_codes, exact.missing_code, exact.other_code)
        if got.name in ("x", "gaps"):
            values = np.sort([r[0] for r in table.select(got.name).dropna().collect()])
            ranks = np.searchsorted(values, got.edges, "right") / len(values)
            assert np.abs(ranks - np.arange(1, 10) / 10).max() <= 2 * R.rank_error() + 1 / len(values)
        else:
            assert got.edges == exact.edges


def test_error_shrinks_with_the_sketch():
    assert R.rank_error(200) == pytest.approx(0.0193, abs=2e-4) and R.rank_error() < 7e-4
