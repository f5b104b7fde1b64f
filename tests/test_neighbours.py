import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import InfoSelector, ksg_cmi, ksg_mi
from gleaner.functions.special import digamma, digamma_table
from gleaner.operators import neighbours
from gleaner.operators.kdtree import Tree
from gleaner.operators.knn import kth_distance, within


def table_of(a, b):
    return np.sqrt(sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(a.shape[1])))


def shaped(kind, rng, n, d):
    p = rng.standard_normal((n, d))
    if kind == "ties":
        p = np.round(p)
    if kind == "copies" and d > 1:
        p[:, 1] = p[:, 0]
    if kind == "one":
        p[:] = 3.0
    return p


@pytest.mark.parametrize("d", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("kind", ["plain", "ties", "copies", "one"])
def test_tree_equals_all_distances(d, kind):
    rng = np.random.default_rng(d)
    for n in (1, 2, 33, 400, 1500):
        p, q, k = shaped(kind, rng, n, d), shaped("plain", rng, 60, d), min(7, n)
        tree, far = Tree(p), table_of(p, p)
        assert (tree.nearest(k) == np.sort(far, axis=1)[:, :k]).all()
        r = np.sort(far, axis=1)[:, k - 1]
        assert (tree.count(r) == (far <= r[:, None]).sum(axis=1)).all() and (within(p, r) == tree.count(r)).all() and (kth_distance(p, k - 1) == r).all()
        bound, far = rng.random(60) * 2, table_of(q, p)
        got, want = tree.nearest(k, Tree(q), bound), np.sort(far, axis=1)[:, :k]
        assert (got[want <= bound[:, None]] == want[want <= bound[:, None]]).all()
        assert (tree.count(bound, Tree(q)) == (far <= bound[:, None]).sum(axis=1)).all()


@pytest.mark.parametrize("d", [2, 3, 4, 5])
def test_tree_takes_few_distances(d):
    p = np.random.default_rng(1).random((50_000, d))
    tree = Tree(p)
    r = tree.nearest(11)[:, -1]
    assert tree.distances * 5 < 50_000**2
    tree.distances = 0
    tree.count(r)
    assert tree.distances * 5 < 50_000**2


def test_digamma_of_whole_numbers():
    assert digamma(np.arange(1, 3000)) == pytest.approx(digamma_table(2999)[1:], abs=1e-13)


def data_of(n, seed=3):
    rng = np.random.default_rng(seed)
    x = {f"x{i}": rng.standard_normal(n) for i in range(3)}
    x["copy"], x["steps"] = x["x0"], np.round(x["x1"] * 2)
    x["same"] = np.where(np.arange(n) % 3 == 0, 0.0, x["x2"])  # a third of all rows has one value
    x["y"] = x["x0"] + 0.5 * x["x1"] + 0.3 * rng.standard_normal(n)
    return x


REQUESTS = [(("x0",), ("y",)), (("copy",), ("y",)), (("x0",), ("copy",)), (("steps",), ("y",)), (("same",), ("steps",)), (("x1", "x0"), ("y",)), (("same", "x2", "steps"), ("y",)), (("same",), ("same",))]


@pytest.mark.parametrize("cell", [1 << 18, 150])
def test_tables_equal_arrays(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    x = data_of(700)
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in x.values()])), ", ".join(f"{c} double" for c in x)).repartition(5)
    got = neighbours.informations(df, 700, REQUESTS, 7)
    want = [ksg_mi(np.stack([x[c] for c in a], 1), np.stack([x[c] for c in b], 1), 7) for a, b in REQUESTS]
    assert got == pytest.approx(want, abs=1e-12) and got[0] == got[1] > 0.3
    assert neighbours.informations(df.limit(5), 5, REQUESTS[:2], 7) == [0.0, 0.0] and neighbours.informations(df, 700, [], 7) == []


def test_radii_and_counts_of_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    x = data_of(400, 5)
    points = {0: np.stack([x["x0"], x["y"]], 1), 1: np.stack([x["same"], x["steps"]], 1)}
    rows = [(g, i, [float(v) for v in p]) for g, some in points.items() for i, p in enumerate(some)]
    df = spark.createDataFrame(rows, "g int, id long, p array<double>").repartition(3)
    radii = neighbours._radii(df, 400, {0: 2, 1: 2}, 5)
    got = {(r["g"], r["id"]): r["r"] for r in radii.collect()}
    for g, p in points.items():
        assert [got[g, i] for i in range(400)] == np.sort(table_of(p, p), axis=1)[:, 5].tolist()
    margins = neighbours._counts(radii.withColumn("p", F.slice("p", 1, 1)), 400, {0: 1, 1: 1})
    got_n = {(r["g"], r["id"]): r["n"] for r in margins.collect()}
    for g, p in points.items():
        assert [got_n[g, i] for i in range(400)] == [int((np.abs(p[:, 0] - v) <= got[g, i]).sum()) for i, v in enumerate(p[:, 0].tolist())]


def test_informations_of_a_table(spark):
    x = data_of(500)
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in x.values()])), ", ".join(f"{c} double" for c in x)).withColumn("k", F.when(F.col("y") > 0, "b").otherwise("a"))
    df = df.unionByName(df.limit(1).withColumn("x0", F.lit(None).cast("double")))
    with neighbours.KnnInformations(df, ["x0", "x1", "copy"], "k", False, 5) as info:
        k, z = (x["y"] > 0).astype(float), x["x0"]
        assert info.rows == 500
        assert info.relevance() == pytest.approx([ksg_mi(x[c], k, 5) for c in ("x0", "x1", "copy")], abs=1e-12)
        assert info.redundancy(0) == pytest.approx([ksg_mi(x[c], z, 5) for c in ("x0", "x1", "copy")], abs=1e-12)
        assert info.gain(0) == pytest.approx([ksg_cmi(x[c], k, z, 5) for c in ("x0", "x1", "copy")], abs=1e-12)
        assert info.gain_given([0, 1]) == pytest.approx([ksg_cmi(x["x0"], k, x["x1"], 5), ksg_cmi(x["x1"], k, z, 5), ksg_cmi(z, k, np.stack([z, x["x1"]], 1), 5)], abs=1e-12)
        assert info.gain_given([0])[0] == pytest.approx(ksg_mi(z, k, 5), abs=1e-12)
        assert info.only([2, 1]).relevance().tolist() == info.relevance()[[2, 1]].tolist()


def test_search_is_the_same_by_cells(spark, monkeypatch):
    x = data_of(1200)
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in x.values()])), ", ".join(f"{c} double" for c in x)).select("x0", "x1", "x2", "y")
    found = []
    for cell in (1 << 18, 500):
        monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
        found.append(InfoSelector(target="y", estimator="ksg", max_features=2, screen_top_k=3).fit(df))
    assert found[0].selected_features == found[1].selected_features == ["x0", "x1"]
    assert found[0].scores_ == pytest.approx(found[1].scores_, abs=1e-12)
