import datetime
import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types

import gleaner
from gleaner import InfoSelector, SelectorConfig, conditional_mi, mutual_information
from gleaner.functions.measures import cmi_of_cells, mi_of_cells
from gleaner.operators import cells as C
from gleaner.operators import greedy
from gleaner.operators import pair_tables as T
from gleaner.operators import profile as P
from gleaner.operators.sampling import bottom_k
from gleaner.operators.screening import screen
from gleaner.operators.significance import Verdict
from gleaner.plans import catalogue
from gleaner.sources.tables import benchmark_rows, planted, read_json, read_points, rows, write_csv, write_json

AND = [{"name": "x0", "role": "informative"}, {"name": "x1", "role": "informative"}, {"name": "x2", "role": "independent"}, {"name": "x3", "role": "redundant", "of": "x0"}]


@pytest.fixture(scope="module")
def conjunction(spark):
    return rows(spark, planted(4000, 0, AND, {"kind": "and", "of": ["x0", "x1"], "noise": 0.1}), as_strings=True).cache()


@pytest.mark.parametrize(("criterion", "more"), [("jmim", {}), ("mrmr", {}), ("mim", {}), ("cmim", {}), ("cmim", {"cmim_approx": "max_min"})])
def test_planted_conjunction(conjunction, criterion, more):
    model = InfoSelector(criterion, target="y", **more).fit(conjunction)
    got = set(model.selected_features)
    assert {"x0", "x1"} <= got | ({"x0"} if "x3" in got else set()) and "x2" not in got
    assert len(got & {"x0", "x3"}) == 1 and len(model.ranking_) == 4 and model.n_rows == 4000
    assert model.transform(conjunction).columns == [*model.selected_features, "y"]


def test_jmi_takes_both(conjunction):
    got = InfoSelector("jmi", target="y", max_features=3).fit(conjunction).selected_features
    assert "x1" in got and "x2" not in got[:2]


def test_nothing_significant(spark):
    rng = np.random.default_rng(3)
    df = rows(spark, {"a": rng.integers(0, 2, 500).tolist(), "y": rng.integers(0, 2, 500).tolist()})
    model = InfoSelector(target="y").fit(df)
    assert model.selected_features == [] and [n for n, _ in model.ranking_] == ["a"] and "etapa2" not in model.timings_


@pytest.mark.parametrize("significance", ["permutation", None])
def test_other_tests(conjunction, significance):
    model = InfoSelector(target="y", significance=significance, n_permutations=40, max_features=2).fit(conjunction)
    assert set(model.selected_features) <= {"x0", "x1", "x3"} and len(model.selected_features) == 2


def test_cells_and_measures_equal_dense(spark):
    rng = np.random.default_rng(7)
    data = {"a": rng.integers(0, 3, 200), "b": rng.integers(0, 2, 200), "c": rng.integers(0, 4, 200), "y": rng.integers(0, 2, 200)}
    df = rows(spark, {k: v.tolist() for k, v in data.items()})
    count = lambda *names: np.histogramdd(np.c_[*[data[n] for n in names]], [np.arange(data[n].max() + 2) for n in names])[0]
    uni = C.feature_cells(df, ["a", "b", "c"], "y")
    assert (C.dense(uni.filter("feature = 'c'"), (4, 2), ["x", "y"]) == count("c", "y")).all()
    mi = {r["feature"]: r["mi"] for r in mi_of_cells(uni, ["feature"]).collect()}
    assert all(mi[f] == pytest.approx(mutual_information(count(f, "y")), abs=1e-12) for f in "abc")
    pairs = C.pair_cells(df, ["a", "b", "c"], "y")
    assert pairs.agg(F.sum("n")).first()[0] == 600
    cmi = {(r["i"], r["j"]): r["cmi"] for r in cmi_of_cells(C.both_ways(pairs), ["i", "j"], "xi", "y", ["xj"]).collect()}
    names = "abc"
    for (i, j), v in cmi.items():
        assert v == pytest.approx(conditional_mi(count(names[i], "y", names[j])), abs=1e-12)
    fixed = InfoSelector("cmim", target="y").fixed_gains(df, ["a", "b", "c"], ["a", "b"])
    assert fixed == pytest.approx([conditional_mi(count("a", "y", "b")), conditional_mi(count("b", "y", "a")), conditional_mi(count("c", "y", "a", "b"))], abs=1e-12)
    assert C.budget([3, 2, 4], 2) == 26 * 3


def _coding(df, **config):
    c = SelectorConfig(target="y", **config)
    task = P.task_of(df, "y", c.task)
    features, target, n = P.codings(df, P.kinds_of(df, c), c, task)
    return features, target, P.encoded(df, features, target, c.missing)


def test_bins_missing_and_constants(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, F.rand(1)).alias("x"), F.lit(5.0).alias("k"), F.lit(None).cast("double").alias("e"), (F.col("id") % 2).alias("y"))
    (x, k, e), _, coded = _coding(df)
    assert x.missing_code == 10 and x.n_codes == 11 and k.edges == () and k.n_codes == 2 and e.n_codes == 2 and e.missing_code == 1
    sizes = {r["x"]: r["count"] for r in coded.groupBy("x").count().collect()}
    assert sizes[10] == 500 and all(400 <= sizes[i] <= 500 for i in range(10))
    assert _coding(df.drop("e"), missing="drop")[2].count() == 4500


@pytest.mark.parametrize(("low", "high", "quantiles", "edges"), [(0, 2, [1] * 5 + [2] * 4, (0.5, 1.5)), (0, 1, [0] * 5 + [1] * 4, (0.5,)), (None, None, [], ()), (3, 3, [3] * 9, ()), (0, 1, [i / 10 for i in range(1, 10)], tuple(i / 10 for i in range(1, 10)))])
def test_edge_rule(low, high, quantiles, edges):
    assert P.cut_points(low, high, quantiles, 10) == edges


def test_categories(spark):
    values = [str(i) for i in range(60) for _ in range(61 - i)]
    df = rows(spark, {"x": values, "y": [i % 2 for i in range(len(values))]})
    (x,), _, coded = _coding(df)
    assert x.codes["0"] == 0 and len(x.codes) == 50 and x.other_code == 50 and x.missing_code == 51
    assert coded.filter("x = 50").count() == sum(61 - i for i in range(50, 60))
    when = datetime.datetime(2020, 1, 2, 3, 4, 5)
    kinds = types.StructType([types.StructField("d", types.DateType()), types.StructField("t", types.TimestampType()), types.StructField("n", types.TimestampNTZType()), types.StructField("b", types.BooleanType()), types.StructField("y", types.LongType())])
    df = spark.createDataFrame([(when.date(), when, when, True, 0), (None, None, None, None, 1)], kinds)
    assert [list(c.codes) for c in _coding(df)[0]] == [["2020-01-02"], ["2020-01-02 03:04:05"], ["2020-01-02 03:04:05"], ["true"]]


def test_nan_and_numeric_text_are_handled(spark):
    df = spark.createDataFrame([("1", float("nan"), 0), ("x", 1.0, 1), (None, 2.0, 1), ("3", 3.0, 0)], "s string, v double, y long")
    (s, v), _, coded = _coding(df, numeric_features=["s"])
    assert [r["s"] for r in coded.collect()][1:3] == [s.missing_code] * 2 and coded.first()["v"] == v.missing_code


def test_task_rule(spark):
    df = spark.range(25).select(F.col("id").alias("k"), (F.col("id") % 20).alias("few"), (F.col("id") % 2).cast("string").alias("s"), F.rand().alias("r"), F.when(F.col("id") > 3, F.col("id") % 2).alias("n"))
    assert [P.task_of(df, c) for c in ("k", "few", "s", "r")] == ["continuous", "classifier_multiclass", "classifier_multiclass", "continuous"]
    assert P.task_of(df, "s", "classifier_binary") == "classifier_binary"
    for target, task in (("n", "classifier_binary"), ("s", "continuous")):
        with pytest.raises(ValueError):
            P.task_of(df, target, task)
    with pytest.raises(TypeError):
        P.kinds_of(df.select(F.array("k").alias("a"), "s"), SelectorConfig(target="s"))


@pytest.mark.parametrize("wrong", [{"task": "x"}, {"max_features": 0}, {"screen_top_k": 10}, {"bins": 1}, {"bins": "many"}, {"fdr_q": 1}, {"missing": "x"}, {"ksg_k": 3}, {"estimator": "ksg", "bins": 5}, {"subsample": 10}, {"numeric_features": ["a"], "categorical_features": ["a"]}, {"significance": "fdr"}])
def test_config_errors(wrong):
    with pytest.raises(ValueError):
        SelectorConfig(target="y", **wrong)


def test_config_names_all_offenders():
    with pytest.raises(ValueError, match="bins, fdr_q"):
        SelectorConfig(target="y", estimator="ksg", fdr_q=0.1, bins=4)


def test_search_stops_and_breaks_ties():
    m = greedy.Matrices(np.array([0.5, 0.5, 0.2]), np.zeros((3, 3)), np.array([[0, 0.1, 0.1], [0.01, 0, 0.1], [0.01, 0.1, 0]]))
    assert greedy.choose(m, "jmim", 3, 0.05).places == [0]
    assert greedy.choose(m, "jmim", 2, 0.01).places == [0, 1]
    with pytest.raises(ValueError):
        greedy.choose(m, "other", 2)
    with pytest.raises(ValueError):
        InfoSelector("other", target="y")


def test_neighbour_estimator(spark):
    features = [{"name": f"x{i}", "role": "informative", "levels": 0} for i in range(3)] + [{"name": "x3", "role": "redundant", "of": "x0", "levels": 0}]
    df = rows(spark, planted(1500, 0, features, {"kind": "linear", "weights": {"x0": 1, "x1": 1}, "noise": 0.1}))
    got = InfoSelector(target="y", estimator="ksg", max_features=2).fit(df)
    assert set(got.selected_features) in ({"x0", "x1"}, {"x3", "x1"}) and "etapa2" not in got.timings_
    with pytest.raises(ValueError, match="s"):
        InfoSelector(target="y", estimator="ksg").fit(df.withColumn("s", F.lit("a")))


class Trivial:
    name = "trivial"

    def train(self, df, task, label):
        if task == "continuous":
            return df.crossJoin(df.agg(F.avg(label).alias("prediction")))
        from pyspark.ml.functions import array_to_vector

        k = int(df.agg(F.max(label)).first()[0]) + 1
        return df.withColumn("probability", array_to_vector(F.array(*[F.lit(1 / k)] * k)))


def test_evaluation(spark, conjunction):
    df = benchmark_rows(spark, 1500, 16).withColumn("three", F.when(F.col("x0") > 0.5, "c").when(F.col("x0") > -0.5, "b").otherwise("a"))
    assert gleaner.train_and_evaluate(df, ["x0"], "y", Trivial()) == 0.5
    assert gleaner.train_and_evaluate(df, ["x0"], "three", Trivial()) == 0.5
    assert gleaner.train_and_evaluate(df, ["x1"], "x0", Trivial(), "regression") == pytest.approx(0, abs=1e-9)
    report = gleaner.SelectorModel(["x0"], [1.0], [("x0", 0.5), ("x1", 0.4)], "jmim", 1500, "y", "classifier_binary").report(df.select("x0", "x1", "y"), Trivial())
    assert report.summary()["efficiency_curve"] == [(1, 0.5), (2, 0.5)] and report.model_name == "trivial"
    assert gleaner.efficiency_curve(df, ["x0", "x1", "x2"], "x3", Trivial(), "continuous") == [(k, pytest.approx(0, abs=1e-9)) for k in (1, 2, 3)]
    some = gleaner.report(df, selected_features=["x0"], ranking=["x0"], target_col="y", model=Trivial(), all_features=["x0", "x1"])
    assert (some.task, some.metric_selected, some.metric_all, len(some.efficiency_curve)) == ("classifier_multiclass", 0.5, 0.5, 1)
    with pytest.raises(ValueError):
        gleaner.train_and_evaluate(df, ["x0"], "y", Trivial(), "bogus")
    with pytest.raises(ValueError):
        gleaner.SelectorModel(["x0"], [], [], "jmim", 0, "y", "auto")
    assert gleaner.train_and_evaluate(df.select("x0", "three"), ["x0"], "three") > 0.9
    assert gleaner.train_and_evaluate(conjunction, ["x0", "x1"], "y") > 0.8
    with pytest.raises(ValueError):
        gleaner.make_model_factory("other")
    for name in ("xgboost", "lightgbm"):
        with pytest.raises(ImportError):
            gleaner.make_model_factory(name).train(df, "continuous", "y")


def test_sliced_trainings_equal_trainings_of_their_own(spark, monkeypatch):
    """Numbers, texts and a date; the table is assembled once, models are the same."""
    from pyspark.ml.classification import GBTClassifier

    from gleaner.operators import evaluate as E

    class Small:
        def train(self, df, task, label):
            return GBTClassifier(labelCol=label, maxBins=64, maxIter=2, seed=42).fit(df).transform(df)

    rng = np.random.default_rng(4)
    data = [(float(a), "uvw"[int(b)], datetime.date(2020, 1, 1 + int(c)), float(d), int(a + b + 0.3 * d > 1)) for a, b, c, d in zip(rng.standard_normal(600), rng.integers(0, 3, 600), rng.integers(0, 5, 600), rng.standard_normal(600))]
    df = spark.createDataFrame(data, "a double, b string, c date, d double, y int").repartition(3).cache()
    assembled = []
    real = E._vectors
    monkeypatch.setattr(E, "_vectors", lambda df, features, *rest: assembled.append(list(features)) or real(df, features, *rest))
    found = gleaner.report(df, ["b", "a"], ["a", "b", "d"], "y", Small(), parallel=3)
    assert assembled == [["a", "b", "c", "d"]]
    alone = [gleaner.train_and_evaluate(df, some, "y", Small()) for some in (["b", "a"], ["a", "b", "c", "d"], ["a"], ["a", "b"], ["a", "b", "d"])]
    assert [found.metric_selected, found.metric_all, *(v for _, v in found.efficiency_curve)] == pytest.approx(alone, abs=1e-12)
    assert [k for k, _ in found.efficiency_curve] == [1, 2, 3] and alone[4] > alone[2]
    assert gleaner.efficiency_curve(df, [], "y") == []


def test_sinks(spark, tmp_path):
    write_json(str(tmp_path / "a.json"), {"v": 2})
    assert read_json(str(tmp_path / "a.json"), {}) == {"v": 2} and read_json(str(tmp_path / "b.json"), {"v": 0}) == {"v": 0}
    write_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    write_json(str(tmp_path / "old.json"), [{"n": 1}])
    assert read_points(str(tmp_path / "old.json")) == {"meta": {}, "points": [{"n": 1}]} and read_points(str(tmp_path / "none.json")) == {"meta": {}, "points": []}


GOOD = {"name": "g", "role": "informative"}


@pytest.mark.parametrize(
    ("features", "target"),
    [
        ([{"name": "y", "role": "informative"}], {"kind": "and"}),
        ([GOOD, GOOD], {"kind": "and"}),
        ([GOOD, {"name": "a", "role": "x"}], {"kind": "and"}),
        ([GOOD, {"name": "a", "role": "redundant", "of": "b"}], {"kind": "and"}),
        ([GOOD, {"name": "a", "role": "redundant", "of": "g", "noise": -1}], {"kind": "and"}),
        ([GOOD, {"name": "a", "role": "correlated", "agree": 0.5}], {"kind": "and"}),
        ([{"name": "a", "role": "correlated", "agree": 1}], {"kind": "flip"}),
        ([GOOD], {"kind": "flip"}),
        ([GOOD], {"kind": "and", "noise": -0.1}),
        ([GOOD | {"levels": 0}], {"kind": "and"}),
        ([{"name": "a", "role": "independent"}], {"kind": "linear"}),
        ([GOOD], {"kind": "other"}),
    ],
)
def test_what_cannot_be_planted(features, target):
    with pytest.raises(ValueError):
        planted(10, 0, features, target)
    with pytest.raises(ValueError):
        planted(0, 0, [GOOD], {"kind": "and"})


def test_planted_targets():
    normal = [{"name": f"x{i}", "role": "informative", "levels": 0} for i in range(2)]
    data = planted(5000, 1, [*normal, {"name": "r", "role": "redundant", "of": "x0", "noise": 0.1}], {"kind": "linear", "thresholds": (-1.0, 1.0)})
    x0, x1, r = (np.array(data[k]) for k in ("x0", "x1", "r"))
    assert data["y"] == ((x0 + x1 > -1).astype(int) + (x0 + x1 > 1)).tolist()
    assert np.std(r - x0) == pytest.approx(0.1, rel=0.1)
    data = planted(5000, 1, [{"name": "c", "role": "correlated", "agree": 0.8}, {"name": "r", "role": "redundant", "of": "c"}], {"kind": "flip"})
    assert np.mean(np.array(data["c"]) == data["y"]) == pytest.approx(0.8, abs=0.03) and data["r"] == data["c"]


def test_benchmark_copies_go_round(spark):
    df = benchmark_rows(spark, 200, 8, informative=2, redundant=5)
    assert df.columns == ["x0", "x1", "r0", "r1", "r2", "r3", "r4", "n0", "y"]
    assert df.select(F.corr("r2", "x0"), F.corr("r3", "x1")).first() == pytest.approx((1, 1), abs=0.01)


def _plain_cells(data, names):
    """Counts by (i, j, xi, xj, y) of rows given as columns."""
    found = Counter()
    for i, j in itertools.combinations(range(len(names)), 2):
        found.update(zip(itertools.repeat(i), itertools.repeat(j), data[names[i]], data[names[j]], data["y"]))
    return sorted(((*k, n) for k, n in found.items()), key=repr)


@pytest.mark.parametrize("cells", [None, 200, 60, 1])
@pytest.mark.parametrize("shard", [1 << 22, 100])
def test_tiled_pairs_equal_plain_counts(spark, monkeypatch, cells, shard):
    monkeypatch.setattr(T, "SHARD_ROWS", shard)
    monkeypatch.setattr(T, "BATCH", 64)
    rng = np.random.default_rng(5)
    data = {k: [None if v == n - 1 and k != "c" else int(v) for v in rng.integers(0, n, 300)] for k, n in (("a", 4), ("b", 3), ("c", 5), ("d", 300), ("y", 3))}
    df, names = rows(spark, data).repartition(3), ["a", "b", "c", "d"]
    took = lambda t: sorted(map(tuple, t.select("i", "j", "xi", "xj", "y", "n").collect()), key=repr)
    want = _plain_cells(data, names)
    assert took(C.pair_cells(df, names, "y", [3, 2, 5, 299], 2, block_cells=cells)) == want == took(C.pair_cells(df, names, "y", block_cells=cells))
    assert C.pair_cells(df.limit(0), names, "y", [3, 2, 5, 299], 2).count() == 0 == C.pair_cells(df, ["a"], "y").count()
    found = C.pair_informations(df, names, "y", [3, 2, 5, 299], 2, block_cells=cells).collect()
    pairs = C.both_ways(C.pair_cells(df, names, "y")).cache()
    cmi = {(r["i"], r["j"]): r["cmi"] for r in cmi_of_cells(pairs, ["i", "j"], "xi", "y", ["xj"]).collect()}
    mi = {(r["i"], r["j"]): r["mi"] for r in mi_of_cells(pairs.groupBy("i", "j", "xi", "xj").agg(F.sum("n").alias("n")), ["i", "j"], "xi", "xj").collect()}
    assert len(found) == 6
    for r in found:
        assert (r["mi"], r["gain_i"], r["gain_j"]) == pytest.approx((mi[r["i"], r["j"]], cmi[r["i"], r["j"]], cmi[r["j"], r["i"]]), abs=1e-12)


@pytest.mark.parametrize(("k", "target_size", "tasks"), [(2, 2, 8), (5, 2, 8), (100, 11, 8), (200, 11, 64), (30, 3, 1)])
def test_blocks_hold_every_pair_once_within_their_cells(k, target_size, tasks):
    rng = np.random.default_rng(k)
    sizes = rng.integers(2, 52, k).tolist()
    tiles = T.Tiles(sizes, target_size, tasks, T.BLOCK_CELLS)
    pairs = [p for a, b in tiles.blocks for p in tiles.pairs(a, b)]
    assert sorted(pairs) == list(itertools.combinations(range(k), 2))
    assert all(sum(tiles.cells(*p) for p in tiles.pairs(a, b)) <= T.BLOCK_CELLS for a, b in tiles.blocks)
    assert len(tiles.blocks) >= min(tasks, k * (k - 1) // 2)


@pytest.mark.parametrize("k", [100, 200])
def test_many_candidates_with_a_binned_target(spark, k):
    """More than 8 million cells; no row is repeated for a pair."""
    n = 3000
    df = spark.range(n).select(*[(F.xxhash64("id", F.lit(i)) % 11 + 11).cast("int").alias(f"f{i}") for i in range(k)], (F.col("id") % 11).cast("int").alias("y"))
    df = df.select(*[(F.col(f"f{i}") % 11).alias(f"f{i}") for i in range(k)], "y").cache()
    names = [f"f{i}" for i in range(k)]
    assert sum(12 * 12 * 12 for _ in itertools.combinations(range(k), 2)) > 8_000_000
    found = C.pair_informations(df, names, "y", [11] * k, 11, n)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["i"], r["j"]): r for r in found.collect()}
    assert len(got) == k * (k - 1) // 2
    p = df.toPandas()
    for i, j in [(0, 1), (3, k - 1), (k // 2, k // 2 + 1), (k - 2, k - 1)]:
        table = np.histogramdd(p[[f"f{i}", "y", f"f{j}"]].to_numpy(), [np.arange(12)] * 3)[0]
        assert got[i, j]["gain_i"] == pytest.approx(conditional_mi(table), abs=1e-12)
        assert got[i, j]["gain_j"] == pytest.approx(conditional_mi(table.transpose(2, 1, 0)), abs=1e-12)
        assert got[i, j]["mi"] == pytest.approx(mutual_information(table.sum(axis=1)), abs=1e-12)


def test_trees_are_trained_on_counts(spark, monkeypatch):
    """Two classes of numbers: rows in the same bins come as one with a weight; the worth is that of the rows."""
    evaluate = catalogue.evaluate
    df = spark.range(6000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).alias("b"), ((F.col("id") % 7 + F.col("id") % 5 + F.hash("id") % 4) > 5).cast("int").alias("y"))
    with evaluate.Trainings(df, ["a", "b"], "y") as t:
        counted = t.all_of([["b"], ["b", "a"]])
        assert t.vectors.count() <= 7 * 5 * 2 and t.vectors.agg(F.sum("weight")).first()[0] == 6000
    monkeypatch.setattr(evaluate, "KINDS", 0)
    with evaluate.Trainings(df, ["a", "b"], "y") as t:
        assert t.vectors.count() == 6000
        assert counted == pytest.approx(t.all_of([["b"], ["b", "a"]]), abs=1e-9) and counted[0] < counted[1]


@pytest.mark.parametrize("query", ["planted_recovery", "fit_mrmr", "fit_cmim"])
def test_fits_count_all_rows(spark, monkeypatch, query):
    """The fits that have SQL count joint tables over all rows, also where there are more than the selector's default sample."""
    folder = "/root/testdata/sf0.001"
    whole = catalogue.QUERIES[query](spark, folder).collect()
    start = SelectorConfig.__init__
    monkeypatch.setattr(start, "__defaults__", tuple(1000 if v == 1_000_000 else v for v in start.__defaults__))
    assert SelectorConfig(target="y").subsample == 1000
    assert catalogue.QUERIES[query](spark, folder).collect() == whole


def test_exact_quantiles_of_close_and_tied_numbers(spark, monkeypatch):
    """Numbers that differ in their last bits, both signs, zeros of both signs, infinities and ties, with several batches held."""
    rng = np.random.default_rng(5)
    near = 1 + np.arange(3000) * 2.0**-52
    ends = np.concatenate([rng.standard_normal(2990) * 10.0 ** rng.integers(-300, 300, 2990), [0.0, -0.0, np.inf, np.inf, -np.inf, 5e-324, -5e-324, 1.0, 1.0, 1.0]])
    tied = np.where(rng.random(3000) < 0.9, 7.0, rng.standard_normal(3000))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(rng.permutation(near), rng.permutation(ends), tied, strict=True)], "near double, ends double, tied double")
    monkeypatch.setattr(P, "_HELD", 100)
    got = P.exact_quantiles(df.repartition(5), {"near": 1000, "ends": 7, "tied": 20})
    for name, values, b in (("near", near, 1000), ("ends", ends, 7), ("tied", tied, 20)):
        order, at = np.sort(values), [2999 * k / b for k in range(1, b)]
        assert got[name] == [order[int(x)] + (order[int(np.ceil(x))] - order[int(x)]) * (x - int(x)) for x in at]


def test_codes_and_quantiles_by_lookup(spark):
    """Codes are no expressions of hundreds of comparisons, quantiles shuffle no values: the plans grow with the columns only."""
    df = spark.range(500).select(*[(F.col("id") * (i + 3) % 101).cast("double").alias(f"x{i}") for i in range(12)], (F.col("id") % 2).alias("y"))
    config = SelectorConfig(target="y", exact_quantiles=True, missing="drop")
    features, target, _ = P.codings(df, P.kinds_of(df, config), config, "classifier_multiclass")
    codes = P.encoded(df, features, target, "drop")
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert plan.count(">=") < 12 and "MapInArrow" in plan
    plain = df.select(*[P.code_of(df, c).alias(c.name) for c in (*features, target)])
    assert sorted(codes.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("missing", ["category", "drop"])
def test_codes_of_odd_values(spark, missing):
    """Null, NaN, infinities, texts that are no numbers, values beyond the first, dates: as the expressions say."""
    day = datetime.date(2020, 1, 1)
    data = [(None, "a", "1.5", None, 0), (float("nan"), "b", "x", day, 1), (float("inf"), None, None, day, 0), (-1.0, "c", "2", day, 1), (2.0, "a", "NaN", None, None), (2.0, "b", "3", datetime.date(2021, 5, 6), 1)]
    df = spark.createDataFrame(data * 3, "n double, c string, t string, `d.y` date, y int")
    config = SelectorConfig(target="y", max_categories=2, missing=missing, numeric_features=["t"], exact_quantiles=True)
    features, target, _ = P.codings(df, P.kinds_of(df, config), config, "classifier_multiclass")
    plain = df.select(*[P.code_of(df, c).alias(c.name) for c in (*features, target)])
    wanted = [r for r in map(tuple, plain.collect()) if missing == "category" or None not in r]
    assert Counter(map(tuple, P.encoded(df, features, target, missing).collect())) == Counter(wanted)


def test_exact_quantiles(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("few"), F.rand(3).alias("many"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") < 1, 2.5).alias("one"))
    got = P.exact_quantiles(df.repartition(4), {"few": 10, "many": 4, "none": 3, "one": 2})
    p = df.toPandas()
    assert got["few"] == pytest.approx(np.quantile(p["few"], np.arange(1, 10) / 10)) and got["many"] == pytest.approx(np.quantile(p["many"], [0.25, 0.5, 0.75]), abs=1e-12)
    assert got["none"] == [] and got["one"] == [2.5]


def test_screening_and_own_tests(spark, conjunction):
    config = SelectorConfig(target="y")
    features, target, n = P.codings(conjunction, P.kinds_of(conjunction, config), config, P.task_of(conjunction, "y"))
    codes = P.encoded(conjunction, features, target)
    found = screen(codes, features, target, config, n)
    rows_of = {r["feature"]: r for r in found.table(spark).collect()}
    assert sorted(r["rank"] for r in rows_of.values()) == [1, 2, 3, 4] and not rows_of["x2"]["significant"] and rows_of["x0"]["p"] < 1e-6
    assert [found.names[i] for i in found.candidates] == [n for n, _ in found.ranking() if rows_of[n]["significant"]]
    assert screen(codes, [], target, config, n).candidates == []

    class OnlyX2:
        def test(self, data):
            return Verdict(np.full(len(data.mi), 0.5), np.array([n == "x2" for n in data.names]))

    assert InfoSelector(target="y", significance=OnlyX2(), min_score=0).fit(conjunction).selected_features == ["x2"]


def test_candidates_are_trimmed_to_the_budget(conjunction):
    # numbers 0 and 1 have two bins and a code for missing; so has y: a pair takes 3 * 3 * (1 + 3) cells
    config = {"target": "y", "significance": None, "min_score": 0.0, "screen_top_k": 400, "max_features": 4}
    assert len(InfoSelector("jmim", **config).fit(conjunction).selected_features) == 4
    c = SelectorConfig(target="y")
    features, target, _ = P.codings(conjunction, P.kinds_of(conjunction, c), c, P.task_of(conjunction, "y"))
    sizes = [f.n_codes for f in features]
    many = conjunction.select("*", *[F.col("x2").alias(f"copy{i}") for i in range(8)])
    k = next(k for k in range(12, 1, -1) if C.budget([sizes[0]] * k, target.n_codes) <= 1000)
    assert 1 < k < 12 and len(InfoSelector("jmim", max_cache_cells=1000, **(config | {"max_features": 12})).fit(many).selected_features) == k


def test_equal_columns_have_equal_informations(spark):
    rng = np.random.default_rng(12)
    data = {"a": rng.integers(0, 9, 3000).tolist(), "b": rng.integers(0, 9, 3000).tolist()}
    data |= {"c": data["a"], "d": data["b"], "y": ((np.array(data["a"]) + np.array(data["b"])) % 5).tolist()}
    df = rows(spark, data).repartition(7)
    cmi = {(r["i"], r["j"]): r["cmi"] for r in cmi_of_cells(C.both_ways(C.pair_cells(df, list("abcd"), "y")), ["i", "j"], "xi", "y", ["xj"]).collect()}
    assert cmi[0, 2] == cmi[2, 0] == cmi[1, 3] == 0 and cmi[0, 1] == cmi[0, 3] == cmi[2, 1] == cmi[2, 3]
    for r in C.pair_informations(df, list("abcd"), "y").collect():
        cmi[r["i"], r["j"]], cmi[r["j"], r["i"]] = r["gain_i"], r["gain_j"]
    assert cmi[0, 2] == cmi[2, 0] == cmi[1, 3] == 0 and cmi[0, 1] == cmi[0, 3] == cmi[2, 1] == cmi[2, 3]


def test_subsample(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    assert P.sampled(df, 5000, 5000, 1) is df
    took = lambda d, seed=1: sorted(map(tuple, P.sampled(d, 5000, 1000, seed).collect()))
    assert len(took(df)) == 1000 and took(df) == took(df.repartition(7)) == took(df.repartitionByRange(3, F.desc("id"))) != took(df, 2)


@pytest.mark.parametrize(("k", "key"), [(0, "a"), (7, "a"), (334, "-a"), (600, "xxhash64(a, b)"), (999, "5"), (2000, "a")])
def test_bottom_k_equals_sorting(spark, k, key):
    """A third of the rows are one row, nulls and repeated rows among the others."""
    data = [(7, "same")] * 334 + [(i % 50, None if i % 3 else f"b{i % 20}") for i in range(666)]
    df = spark.createDataFrame(data, "a int, b string")
    keyed = df.select("a", "b", F.expr(key).cast("long").alias("k")).collect()
    want = sorted(((r["a"], r["b"]) for r in sorted(keyed, key=lambda r: (r["k"], r["a"], r["b"] is not None, r["b"] or ""))[:k]), key=repr)
    for some in (df.repartition(6), df.coalesce(1)):
        assert sorted(map(tuple, bottom_k(some, F.expr(key), k).collect()), key=repr) == want


def test_efficiency_prefix_uses_every_line(spark, monkeypatch):
    from gleaner.plans import catalogue

    seen = []
    monkeypatch.setattr(catalogue.evaluate, "efficiency_curve", lambda df, order, target: seen.append(df.count()) or [(k + 1, 0.5) for k in range(len(order))])
    assert catalogue.QUERIES["efficiency_prefix"](spark, "/root/testdata/sf0.001").count() == 2
    assert seen == [spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()] and seen[0] > 5000


def _sent_to_tasks(df) -> list[str]:
    """Names of the columns that go to the first step of ``mapInArrow`` in a plan."""
    node = df._jdf.queryExecution().optimizedPlan()
    found = None
    while True:
        if node.nodeName() == "MapInArrow":
            found = node.children().apply(0)
        if not node.children().size():
            break
        node = node.children().apply(0)
    return [found.output().apply(i).name() for i in range(found.output().size())]


def test_joint_tables_take_one_column_to_the_tasks(spark):
    """For each row, Spark sums up the buffers of every column that goes to a task: codes go as one array. Null is a code of its own."""
    df = spark.createDataFrame([(0, None, 1), (1, 2, None), (0, None, 1), (None, 0, 0)], "a int, b int, y int")
    cells = T.pair_cells(df.repartition(3), ["a", "b"], "y", [2, 3], 2, 4)
    assert sorted(map(tuple, cells.collect()), key=str) == sorted([(0, 1, 0, None, 1, 2), (0, 1, 1, 2, None, 1), (0, 1, None, 0, 0, 1)], key=str)
    assert _sent_to_tasks(cells) == ["codes"]


def test_numbers_go_to_the_tasks_as_one_column(spark):
    """As in joint tables; numbers and texts by turns, missing ones among them, a column without numbers, and no numbers at all."""
    rows_ = [(float(i) if i % 5 else None, "ab"[i % 2] if i % 3 else None, i, float("nan") if i % 4 else 0.5, None, i) for i in range(60)]
    df = spark.createDataFrame(rows_, "u double, t string, v int, w double, e double, more long")
    config = SelectorConfig(target="t", exact_quantiles=True)
    features, target, _ = P.codings(df, {"u": "numeric", "v": "numeric", "w": "numeric", "e": "numeric"}, config, "classifier_multiclass")
    every = [features[0], target, *features[1:]]
    got = P.coded(df.repartition(3), every, ("more",))
    plain = df.select(*[P.code_of(df, c).alias(c.name) for c in every], "more")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == sorted(map(tuple, plain.collect()), key=lambda r: r[-1])
    assert _sent_to_tasks(got) == ["numbers", "c1", "more"]
    assert sorted(r[0] for r in P.coded(df, [target]).collect()) == sorted(r["t"] for r in plain.collect())
