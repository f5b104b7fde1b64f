from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import SelectorConfig
from gleaner.operators import categories as K
from gleaner.operators import profile as P


def plain(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda v: (-v[1], v[0].encode()))[:k]


def columns():
    rng = np.random.default_rng(1)
    n = 4000
    zipf = [str(v) for v in rng.zipf(1.3, n)]
    return {
        "zipf": zipf,
        "different": [f"id{i:05d}" for i in rng.permutation(n)],
        "pairs": [f"p{i // 2}" for i in rng.permutation(n)],
        "few": [None if v == 0 else "?abc é日"[v] for v in rng.integers(0, 7, n)],
        "nearly": [f"n{i}" if i % 100 else "often" if i % 200 else "second" for i in range(n)],
        "nothing": [None] * n,
        "even": [f"e{i % 600}" for i in range(n)],
        "one": ["same"] * n,
    }


@pytest.fixture(scope="module")
def wide(spark):
    data = columns()
    return spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} string" for c in data)).repartition(6).cache(), data


@pytest.mark.parametrize(("k", "counters", "survivors"), [(5, 16, 3), (51, 100, 100), (51, 1000, 2000), (1, 2, 1), (700, 50, 10), (5000, 1000, 2000)])
def test_first_values_are_exact(wide, k, counters, survivors):
    df, data = wide
    got = K.top_values(df, k, counters, survivors)
    assert {n: got[n] for n in data} == {n: plain(v, k) for n, v in data.items()}


def test_values_that_share_hashes(wide, monkeypatch):
    df, data = wide
    monkeypatch.setattr(K, "_hash", lambda text: F.when(text.isNotNull(), F.pmod(F.xxhash64(text), F.lit(300))))
    for k, counters, survivors in ((5, 16, 3), (40, 1000, 2000)):
        assert K.top_values(df, k, counters, survivors) == {n: plain(v, k) for n, v in data.items()}
    two = df.select(F.when(F.col("different") < "id00002", F.lit("id00001")).otherwise(F.col("different")).alias("d"))
    monkeypatch.setattr(K, "_hash", lambda text: F.when(text.isin("id00003", "id00004"), 7).when(text.isNotNull(), F.xxhash64(text)))
    assert K.top_values(two, 4, 10, 1)["d"] == [("id00001", 2), ("id00002", 1), ("id00003", 1), ("id00004", 1)]


def test_empty_and_no_columns(wide):
    df, data = wide
    assert K.top_values(df.limit(0), 3) == {n: [] for n in data} and K.top_values(df.select(), 3) == {}


def test_bounds_of_summaries_hold_and_add_up():
    rng = np.random.default_rng(2)
    parts = [rng.zipf(1.2, 3000) for _ in range(8)]
    true, whole = Counter(np.concatenate(parts).tolist()), K.Summary(40)
    for part in parts:
        mine = K.Summary(40)
        for at in range(0, len(part), 500):
            mine.add(part[at : at + 500])
        whole.merge(mine)
    held = dict(zip(whole.keys.tolist(), whole.counts.tolist()))
    assert len(held) <= 40 and whole.error <= 24_000 / 41
    assert all(held.get(v, 0) <= n <= held.get(v, 0) + whole.error for v, n in true.items())


def test_what_moves_is_bounded(wide, monkeypatch):
    """Of columns whose first values stand out, COUNTERS rows a task and column; of others numbers, and k values a task; never all values."""
    df, _ = wide
    sent = []
    real = K._counted
    monkeypatch.setattr(K, "_counted", lambda texts, hashes: sent.append(sum(map(len, hashes.values()))) or real(texts, hashes))
    monkeypatch.setattr(K, "_by_value", lambda *_: pytest.fail("values were counted as they are"))
    got = K.top_values(df.select("different", "zipf", "few"), 10, 100, 50)
    assert got["different"] == [(f"id{i:05d}", 1) for i in range(10)] and max(sent) <= 200
    plan = K._placed(K._long(df, ["different"]), ["value"], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_codes_of_wide_columns(wide):
    df, data = wide
    config = SelectorConfig(target="few", missing="category")
    features, target, _ = P.codings(df, {n: "categorical" for n in data if n != "few"}, config, "classifier_multiclass")
    for c in features:
        want = plain(data[c.name], 50)
        assert c.codes == {v: i for i, (v, _) in enumerate(want)} and (c.other_code == 50) == (len(set(data[c.name])) > 50)
    assert target.codes == {v: i for i, (v, _) in enumerate(plain(data["few"], 100))}
