import math

import numpy as np
import pytest

from gleaner import auc_binary, auc_macro, conditional_mi, entropy_from_counts, joint_entropy_from_counts, ksg_cmi, ksg_mi, mutual_information, r2_score
from gleaner.functions.special import chi2_tail, digamma_table
from gleaner.operators import knn
from gleaner.operators import significance as S


def test_entropy_closed_forms():
    assert entropy_from_counts([5, 5, 5, 5]) == pytest.approx(math.log(4), abs=1e-12)
    assert entropy_from_counts([0, 7]) == 0 and entropy_from_counts([]) == 0
    assert joint_entropy_from_counts([[1, 1], [1, 1]]) == pytest.approx(math.log(4), abs=1e-12)


def test_mutual_information_closed_form():
    want = 0.1 * math.log(5 / 6) + 0.2 * math.log(10 / 9) + 0.3 * math.log(15 / 14) + 0.4 * math.log(20 / 21)
    assert mutual_information([[10, 20], [30, 40]]) == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        mutual_information([1, 2])
    with pytest.raises(ValueError):
        conditional_mi([1, 2])
    assert conditional_mi(np.zeros((2, 2))) == 0


def test_conditional_information_from_entropies():
    t = np.random.default_rng(1).integers(0, 40, (3, 2, 4, 2))
    h = entropy_from_counts
    assert conditional_mi(t) == pytest.approx(h(t.sum(1)) + h(t.sum(0)) - h(t.sum((0, 1))) - h(t), abs=1e-12)
    z_tells_all = np.zeros((2, 2, 2))
    z_tells_all[0, 0, 0] = z_tells_all[1, 1, 1] = 5
    assert conditional_mi(z_tells_all) == pytest.approx(0, abs=1e-12)


def test_chi2_tail():
    for x in (0.01, 1.0, 5.0, 40.0, 600.0):
        assert chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-11)
    assert chi2_tail(3, 0) == 1


def test_digamma():
    d = digamma_table(1000)
    assert d[1] == pytest.approx(-0.5772156649015329, abs=1e-14)
    assert d[1000] == pytest.approx(math.log(1000) - 1 / 2000 - 1 / 12e6, abs=1e-12)


def test_g_test_and_permutation_p():
    assert S.g_pvalue(200, math.log(2), 1) < 1e-50
    assert S.g_pvalue(0, 1, 1) == S.g_pvalue(10, 1, 0) == 1
    assert S.permutation_pvalue(1.0, [2.0]) == 1.0 and S.permutation_pvalue(1.0, [0.5]) == 0.5
    assert S.permutation_pvalue(1.0, [0.1, 0.2, 0.3]) == 0.25 and S.permutation_pvalue(1.0, []) == 1


def test_false_discoveries(spark):
    assert S.false_discovery_mask([0.01, 0.03, 0.04, 0.9], 0.05).tolist() == [True, False, False, False]
    assert S.false_discovery_mask([], 0.05).tolist() == []
    p = np.random.default_rng(0).random(60) ** 4
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "feature int, p double")
    got = {r["feature"]: r["significant"] for r in S.with_discoveries(df, q=0.1).collect()}
    assert [got[i] for i in range(60)] == S.false_discovery_mask(p, 0.1).tolist()


def test_random_tables_keep_margins():
    t = S.random_tables(np.array([30, 20]), np.array([25, 15, 10]), 50, 3)
    assert (t.sum(2) == [30, 20]).all() and (t.sum(1) == [25, 15, 10]).all()


def test_metrics(spark):
    assert auc_binary([0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4]) == 1 and auc_binary([1, 0], [0.5, 0.5]) == 0.5 and auc_binary([1, 1], [0, 1]) == 0.5
    assert auc_macro([0, 1, 2], np.eye(3)) == 1
    assert r2_score([1, 2, 3], [1, 2, 3]) == 1 and r2_score([2, 2], [1, 3]) == 0


def test_auc_of_rows_equals_arrays(spark):
    from pyspark.sql import functions as F

    from gleaner.functions.metrics import auc_of_rows

    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    assert auc_of_rows(df, F.col("y") == 1, F.col("s")).first()[0] == pytest.approx(auc_binary(y, s), abs=1e-12)


def _slow_ksg(a, b, k):
    a, b = (v[:, None] if v.ndim == 1 else v for v in (a, b))
    d = lambda v: np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    r = np.sort(d(np.hstack([a, b])), axis=1)[:, k]
    psi = digamma_table(len(a))
    return max(0.0, psi[k] + math.log(len(a)) - np.mean(psi[(d(a) <= r[:, None]).sum(1)] + psi[(d(b) <= r[:, None]).sum(1)]))


def test_neighbours_equal_brute_force():
    rng = np.random.default_rng(2)
    a, b, z = rng.standard_normal((3, 900))
    b = b + a
    assert ksg_mi(a, b, 7) == pytest.approx(_slow_ksg(a, b, 7), abs=1e-9)
    assert ksg_mi(np.c_[a, z], b, 7) == pytest.approx(_slow_ksg(np.c_[a, z], b, 7), abs=1e-9)
    assert ksg_cmi(a, b, z, 7) == pytest.approx(_slow_ksg(np.c_[a, z], b, 7) - _slow_ksg(z, b, 7), abs=1e-9)
    assert ksg_cmi(a, b, np.zeros((900, 0)), 7) == ksg_mi(a, b, 7)
    assert ksg_mi(a[:5], b[:5], 7) == 0 and ksg_mi(z, a) < 0.05 < ksg_mi(a, b)
    assert (knn.kth_distance(np.zeros((300, 2)), 3) == 0).all()
