"""Registered queries of the selection engine and their SQL twins, on the TPC-H-like tables.

The running example is ``lineitem``: five numbers in decile bins, and the target l_extendedprice * (1 - l_discount) > 50000.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import estimator
from gleaner.config import SelectorConfig
from gleaner.functions.measures import cmi_of_cells, entropy_of_cells, mi_of_cells
from gleaner.functions.metrics import auc_of_cells, auc_of_rows, r2_of_rows
from gleaner.operators import cells as C
from gleaner.operators import evaluate, greedy, neighbours
from gleaner.operators import profile as P
from gleaner.operators import significance as S
from gleaner.operators.categories import top_values
from gleaner.operators.sampling import bottom_k
from gleaner.operators.screening import screen
from gleaner.sources.tables import table
from gleaner.streaming.counts import StoredCounts

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
#: Least score of a feature in the searches.
_LEAST = 0.001
_TARGET = "CAST(l_extendedprice * (1 - l_discount) > 50000 AS INT)"
_BINS = 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- the example in Spark


def _lines(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*FEATURES, *more, F.expr(_TARGET).alias("y"))


def _plan(df: DataFrame, missing: str = "drop"):
    config = SelectorConfig(target="y", task="classifier_multiclass", missing=missing)
    features, target, n = P.codings(df.select(*FEATURES, "y"), {f: "numeric" for f in FEATURES}, config, config.task, exact=True)
    return features, target, n


def _coded(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return _coded_with_sizes(spark, d, *more)[0]


def _coded_with_sizes(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, list[int]]:
    """The example's codes, and the number of codes of each feature; the target has two."""
    df = _lines(spark, d, *more)
    features, _, _ = _plan(df)
    return P.coded(df, features, ("y", *more)), [c.n_codes for c in features]


def _mi_of(coded: DataFrame) -> DataFrame:
    return mi_of_cells(C.feature_cells(coded, FEATURES, "y"), ["feature"])


def _mi(spark: SparkSession, d: str) -> DataFrame:
    return _mi_of(_coded(spark, d))


def _names(column: str) -> Column:
    return F.array(*[F.lit(f) for f in FEATURES])[F.col(column)]


def _pairs(coded: DataFrame, sizes: list[int]) -> DataFrame:
    return C.pair_cells(coded, FEATURES, "y", sizes, 2)


def _cmi_of(coded: DataFrame, sizes: list[int]) -> DataFrame:
    return cmi_of_cells(C.both_ways(_pairs(coded, sizes)), ["i", "j"], "xi", "y", ["xj"]).select(_names("i").alias("fi"), _names("j").alias("fj"), "cmi")


def _pair_mi_of(coded: DataFrame, sizes: list[int]) -> DataFrame:
    pairs = C.both_ways(_pairs(coded, sizes)).groupBy("i", "j", "xi", "xj").agg(F.sum("n").alias("n"))
    return mi_of_cells(pairs, ["i", "j"], "xi", "xj").select(_names("i").alias("fi"), _names("j").alias("fj"), "mi")


# --- the example in SQL

_LEVELS = ", ".join(str(k / _BINS) for k in range(1, _BINS))
_RULE = "CASE WHEN len(m) < 2 THEN [] WHEN len(m) <= {b} THEN list_transform(range(1, len(m)), lambda i: (m[i] + m[i + 1]) / 2) ELSE list_sort(list_distinct(q)) END"
_CODES = f"""base AS (SELECT row_number() OVER () AS rid, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)}, {_TARGET} AS y, l_returnflag, l_linestatus, l_discount AS d FROM lineitem),
long AS (SELECT rid, y, feature, v FROM base UNPIVOT (v FOR feature IN ({", ".join(FEATURES)}))),
marks AS (SELECT feature, q, list_sort(list_distinct(list_concat([lo, hi], q))) AS m FROM
  (SELECT feature, min(v) AS lo, max(v) AS hi, quantile_cont(v, [{_LEVELS}]) AS q FROM long GROUP BY feature)),
edges AS (SELECT feature, {_RULE.format(b=_BINS)} AS e FROM marks),
codes AS (SELECT rid, y, feature, len(list_filter(e, lambda t: v >= t)) AS x FROM long JOIN edges USING (feature))"""
_CELLS = _CODES + ",\ncells AS (SELECT feature, x, y, count(*)::DOUBLE AS n FROM codes GROUP BY ALL)"
_MI = (
    _CELLS
    + """,
mi AS (SELECT feature, sum(n / nt * ln(n * nt / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx,
  sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nt FROM cells) GROUP BY feature)"""
)
_PLACE = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATURES)) + " END"
_PAIRS = """,
pairs AS (SELECT a.feature AS fi, b.feature AS fj, a.x AS xi, b.x AS xj, a.y AS y, count(*)::DOUBLE AS n
  FROM codes a JOIN codes b ON a.rid = b.rid AND a.feature <> b.feature GROUP BY ALL),
cmi AS (SELECT fi, fj, sum(n / nt * ln(n * nz / (nxz * nyz))) AS cmi FROM (SELECT *, sum(n) OVER (PARTITION BY fi, fj, xj) AS nz,
  sum(n) OVER (PARTITION BY fi, fj, xi, xj) AS nxz, sum(n) OVER (PARTITION BY fi, fj, xj, y) AS nyz,
  sum(n) OVER (PARTITION BY fi, fj) AS nt FROM pairs) GROUP BY fi, fj),
two AS (SELECT fi, fj, xi, xj, sum(n) AS n FROM pairs GROUP BY ALL),
pmi AS (SELECT fi, fj, sum(n / nt * ln(n * nt / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY fi, fj, xi) AS nx,
  sum(n) OVER (PARTITION BY fi, fj, xj) AS ny, sum(n) OVER (PARTITION BY fi, fj) AS nt FROM two) GROUP BY fi, fj)"""
_FULL = _MI + _PAIRS


# --- informations


@_query("WITH c AS (SELECT l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS nt FROM c) SELECT round(-sum(n / nt * ln(n / nt)), 9) AS entropy FROM t")
def entropy_returnflag(spark, d):
    return entropy_of_cells(table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))).select(F.round("entropy", 9).alias("entropy"))


@_query("WITH c AS (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag, l_linestatus), t AS (SELECT *, sum(n) OVER () AS nt FROM c) SELECT round(-sum(n / nt * ln(n / nt)), 9) AS entropy FROM t")
def joint_entropy(spark, d):
    cells = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return entropy_of_cells(cells).select(F.round("entropy", 9).alias("entropy"))


@_query("WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS nt FROM c) SELECT round(sum(n / nt * ln(n * nt / (nx * ny))), 9) AS mi FROM w")
def mi_pair(spark, d):
    cells = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y")).agg(F.count("*").alias("n"))
    return mi_of_cells(cells, []).select(F.round("mi", 9).alias("mi"))


@_query(f"WITH {_MI} SELECT feature, round(mi, 9) AS mi FROM mi")
def mi_all_features(spark, d):
    return _mi(spark, d).select("feature", F.round("mi", 9).alias("mi"))


@_query(f"WITH {_FULL} SELECT fi, fj, round(cmi, 9) AS cmi FROM cmi")
def cmi_one_conditioner(spark, d):
    return _cmi_of(*_coded_with_sizes(spark, d)).select("fi", "fj", F.round("cmi", 9).alias("cmi"))


@_query(
    f"""WITH {_CODES}, c AS (SELECT c.feature, x, c.y, l_linestatus AS z0, floor(d * 20) AS z1, count(*)::DOUBLE AS n FROM codes c JOIN base USING (rid) GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, z0, z1) AS nz, sum(n) OVER (PARTITION BY feature, x, z0, z1) AS nxz,
  sum(n) OVER (PARTITION BY feature, y, z0, z1) AS nyz, sum(n) OVER (PARTITION BY feature) AS nt FROM c)
SELECT feature, round(sum(n / nt * ln(n * nz / (nxz * nyz))), 9) AS cmi FROM w GROUP BY feature"""
)
def cmi_two_conditioners(spark, d):
    df = _lines(spark, d, "l_linestatus").withColumn("z", F.floor(F.col("l_discount") * 20))
    features, _, _ = _plan(df)
    codes = P.coded(df, features, ("y", "l_linestatus", "z"))
    cells = C.given_cells(codes, FEATURES, "y", ["l_linestatus", "z"])
    return cmi_of_cells(cells, ["feature"], "x", "y", ["z0", "z1"]).select("feature", F.round("cmi", 9).alias("cmi"))


# --- counts


@_query(f"WITH {_CELLS} SELECT feature, x::INT AS x, y, n::BIGINT AS n FROM cells")
def crosstab_cells(spark, d):
    return C.feature_cells(_coded(spark, d), FEATURES, "y")


@_query(f"WITH {_FULL} SELECT fi, fj, xi::INT AS xi, xj::INT AS xj, y, n::BIGINT AS n FROM pairs WHERE {_PLACE.replace('feature', 'fi')} < {_PLACE.replace('feature', 'fj')}")
def joint_cells(spark, d):
    return _pairs(*_coded_with_sizes(spark, d)).select(_names("i").alias("fi"), _names("j").alias("fj"), "xi", "xj", "y", "n")


@_query(f"WITH {_FULL} SELECT fi, fj, xi::INT AS xi, xj::INT AS xj, n::BIGINT AS n FROM two WHERE {_PLACE.replace('feature', 'fi')} < {_PLACE.replace('feature', 'fj')}")
def pair_marginal(spark, d):
    pairs = _pairs(*_coded_with_sizes(spark, d)).groupBy("i", "j", "xi", "xj").agg(F.sum("n").alias("n"))
    return pairs.select(_names("i").alias("fi"), _names("j").alias("fj"), "xi", "xj", "n")


_WIDER = [*FEATURES, "l_suppkey", "l_partkey", "l_orderkey"]
_REVENUE = "l_extendedprice * (1 - l_discount)"
_WIDER_PAIRS = f"""base AS (SELECT row_number() OVER () AS rid, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in _WIDER)}, {_REVENUE} AS y FROM lineitem),
long AS (SELECT rid, feature, v FROM base UNPIVOT (v FOR feature IN ({", ".join(_WIDER)}, y))),
marks AS (SELECT feature, q, list_sort(list_distinct(list_concat([lo, hi], q))) AS m FROM (SELECT feature, min(v) AS lo, max(v) AS hi, quantile_cont(v, [{_LEVELS}]) AS q FROM long GROUP BY feature)),
edges AS (SELECT feature, {_RULE.format(b=_BINS)} AS e FROM marks),
codes AS (SELECT rid, feature, len(list_filter(e, lambda t: v >= t))::INT AS x FROM long JOIN edges USING (feature)),
pairs AS (SELECT a.feature AS fi, b.feature AS fj, a.x AS xi, b.x AS xj, y.x AS y, count(*) AS n FROM codes a JOIN codes b USING (rid) JOIN codes y USING (rid)
  WHERE y.feature = 'y' AND list_position({_WIDER}, a.feature) < list_position({_WIDER}, b.feature) GROUP BY ALL)"""


def _wider(spark: SparkSession, d: str) -> tuple[DataFrame, list[int], int, int]:
    """Codes of eight features and of a continuous target in ten bins, their numbers of codes, and the number of rows."""
    df = table(spark, d, "lineitem").select(*_WIDER, F.expr(_REVENUE).alias("y"))
    config = SelectorConfig(target="y", task="continuous", missing="drop")
    features, target, n = P.codings(df, dict.fromkeys(_WIDER, "numeric"), config, config.task, exact=True)
    return P.encoded(df, features, target, "drop"), [c.n_codes for c in features], target.n_codes, n


def _wider_name(column: str) -> Column:
    return F.array(*map(F.lit, _WIDER))[F.col(column)]


@_query(f"WITH {_WIDER_PAIRS} SELECT fi, fj, xi, xj, y, n FROM pairs")
def joint_cells_many(spark, d):
    """Joint tables of more features and a binned target, in tiles."""
    codes, sizes, target_size, n = _wider(spark, d)
    cells = C.pair_cells(codes, _WIDER, "y", sizes, target_size, n)
    return cells.select(_wider_name("i").alias("fi"), _wider_name("j").alias("fj"), "xi", "xj", "y", "n")


@_query(
    f"""WITH {_WIDER_PAIRS}, w AS (SELECT fi, fj, n::DOUBLE AS n, sum(n) OVER (PARTITION BY fi, fj) AS nt, sum(n) OVER (PARTITION BY fi, fj, xi) AS ni, sum(n) OVER (PARTITION BY fi, fj, xj) AS nj, sum(n) OVER (PARTITION BY fi, fj, xi, xj) AS nij,
  sum(n) OVER (PARTITION BY fi, fj, xi, y) AS niy, sum(n) OVER (PARTITION BY fi, fj, xj, y) AS njy FROM pairs)
SELECT fi, fj, round(sum(n / nt * ln(nij * nt / (ni * nj))), 9) AS mi, round(sum(n / nt * ln(n * nj / (nij * njy))), 9) AS gain_i, round(sum(n / nt * ln(n * ni / (nij * niy))), 9) AS gain_j FROM w GROUP BY fi, fj"""
)
def joint_informations_many(spark, d):
    """Informations of the same pairs, from the tables in the tasks."""
    codes, sizes, target_size, n = _wider(spark, d)
    found = C.pair_informations(codes, _WIDER, "y", sizes, target_size, n)
    return found.select(_wider_name("i").alias("fi"), _wider_name("j").alias("fj"), *[F.round(c, 9).alias(c) for c in ("mi", "gain_i", "gain_j")])


@_query("SELECT count(DISTINCT m) + max(CASE WHEN m IS NULL THEN 1 ELSE 0 END) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS m FROM orders)")
def distinct_target(spark, d):
    df = table(spark, d, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("m"))
    return spark.createDataFrame([(P.distinct_values(df, "m"),)], "n long")


# --- profile and codes


@_query(f"WITH {_CODES} SELECT feature, unnest(list_transform(e, lambda t: round(t, 6))) AS edge FROM edges")
def quantile_edges(spark, d):
    features, _, _ = _plan(_lines(spark, d))
    return spark.createDataFrame([(c.name, round(e, 6)) for c in features for e in c.edges], "feature string, edge double")


@_query(f"WITH {_CODES} SELECT feature, x::INT AS x, count(*) AS n FROM codes GROUP BY ALL")
def bin_codes(spark, d):
    return _coded(spark, d).unpivot([], FEATURES, "feature", "x").groupBy("feature", "x").agg(F.count("*").alias("n"))


def _gaps(spark, d):
    return table(spark, d, "lineitem").select(F.expr("nullif(l_quantity, 13)").alias("q"), "l_linestatus")


@_query(
    f"""WITH b AS (SELECT CAST(nullif(l_quantity, 13) AS DOUBLE) AS v FROM lineitem), marks AS (SELECT q, list_sort(list_distinct(list_concat([lo, hi], q))) AS m
FROM (SELECT min(v) AS lo, max(v) AS hi, quantile_cont(v, [{_LEVELS}]) AS q FROM b)), edges AS (SELECT {_RULE.format(b=_BINS)} AS e FROM marks)
SELECT (CASE WHEN v IS NULL THEN len(e) + 1 ELSE len(list_filter(e, lambda t: v >= t)) END)::INT AS code, count(*) AS n FROM b, edges GROUP BY 1"""
)
def bin_histogram_with_missing(spark, d):
    df = _gaps(spark, d)
    (c,), _, _ = P.codings(df, {"q": "numeric"}, SelectorConfig(target="l_linestatus"), "classifier_multiclass", exact=True)
    return df.select(P.code_of(df, c).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS n FROM lineitem WHERE nullif(l_quantity, 13) IS NOT NULL")
def missing_drop_count(spark, d):
    df = _gaps(spark, d)
    config = SelectorConfig(target="l_linestatus", missing="drop")
    features, target, _ = P.codings(df, {"q": "numeric"}, config, "classifier_multiclass", exact=True)
    return P.encoded(df, features, target, "drop").agg(F.count("*").alias("n"))


@_query("WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) - 1 AS k FROM c) SELECT least(k, 5)::INT AS code, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def category_codes_topc_other(spark, d):
    df = table(spark, d, "part").select("p_brand", "p_size")
    config = SelectorConfig(target="p_size", task="continuous", max_categories=5)
    (c,), _, _ = P.codings(df, {"p_brand": "categorical"}, config, "continuous")
    return df.select(P.code_of(df, c).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@_query("WITH c AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1) SELECT value, n, (row_number() OVER (ORDER BY n DESC, value) - 1)::INT AS code FROM c")
def string_index(spark, d):
    counts = P.category_counts(table(spark, d, "events"), ["event_type"])
    return counts.select("value", "n", (F.col("place") - 1).alias("code"))


_WIDE = ("text", "source", "lang", "doc_id", "passage")


@_query(
    f"""WITH d AS (SELECT text, source, lang, doc_id::VARCHAR AS doc_id, split_part(text, '.', 1) AS passage FROM documents), l AS (SELECT feature, v FROM d UNPIVOT (v FOR feature IN ({", ".join(_WIDE)}))),
c AS (SELECT feature, v, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS place FROM c) SELECT feature, place::INT AS place, md5(v) AS value, n FROM r WHERE place <= 51"""
)
def wide_categories(spark, d):
    """The 51 first values of columns of which some have a value a row: whole texts, ids, first sentences."""
    df = table(spark, d, "documents").select("text", "source", "lang", F.col("doc_id").cast("string").alias("doc_id"), F.substring_index("text", ".", 1).alias("passage"))
    found = top_values(df, 51)
    return spark.createDataFrame([(c, k + 1, hashlib.md5(v.encode()).hexdigest(), n) for c in _WIDE for k, (v, n) in enumerate(found[c])], "feature string, place int, value string, n long")


@_query("SELECT greatest(4, least(20, round(log2(count(*)))))::INT AS bins FROM lineitem")
def auto_bins(spark, d):
    return spark.createDataFrame([(P.bins_for(table(spark, d, "lineitem").count(), "auto"),)], "bins int")


@_query(
    """WITH h AS (SELECT l_orderkey, l_linenumber, l_quantity, ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_quantity::BIGINT), 1, 15))::BIGINT AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity FROM h ORDER BY k, l_orderkey, l_linenumber, l_quantity LIMIT (SELECT count(*) // 7 FROM lineitem)"""
)
def subsample(spark, d):
    """A seventh of the rows, exactly, by a keyed hash that SQL has too."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long"))), 1, 15), 16, 10)
    return bottom_k(df, key, df.count() // 7)


_TASKS = (("lineitem", "l_linenumber"), ("lineitem", "l_returnflag"), ("lineitem", "l_quantity"), ("lineitem", "l_orderkey"), ("lineitem", "l_shipdate"), ("customer", "c_nationkey"), ("embeddings", "label"))


@_query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, CASE WHEN any_value(typeof({c})) IN ('VARCHAR', 'TIMESTAMP') THEN 'classifier_multiclass' WHEN any_value(typeof({c})) IN ('INTEGER', 'BIGINT') AND count(DISTINCT {c}) <= 20 THEN 'classifier_multiclass' ELSE 'continuous' END AS task FROM {t}"
        for t, c in _TASKS
    )
)
def task_rule(spark, d):
    return spark.createDataFrame([(c, P.task_of(table(spark, d, t), c)) for t, c in _TASKS], "name string, task string")


# --- significance


@_query(f"WITH {_MI} SELECT feature, round(2 * nt * mi, 5) AS g, (len(e) * 1)::INT AS freedom FROM mi JOIN edges USING (feature), (SELECT count(*) AS nt FROM lineitem)")
def g_statistic(spark, d):
    df = _lines(spark, d)
    features, target, n = _plan(df)
    free = F.create_map(*[F.lit(v) for c in features for v in (c.name, (c.n_codes - 1) * (target.n_codes - 1))])
    return _mi(spark, d).select("feature", F.round(2 * n * F.col("mi"), 5).alias("g"), free[F.col("feature")].alias("freedom"))


@_query(
    """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS nt FROM c)
SELECT round(exp(-sum(n * ln(n * nt / (nx * ny)))), 9) AS p FROM w"""
)
def g_pvalue_two_degrees(spark, d):
    """Three flags by two states: two degrees of freedom, for which p is exp(-G / 2)."""
    cells = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y")).agg(F.count("*").alias("n")).cache()
    mi, n = mi_of_cells(cells, []).first()[0], cells.agg(F.sum("n")).first()[0]
    return spark.createDataFrame([(round(S.g_pvalue(n, mi, 2), 9),)], "p double")


_CHANCE = "pow((p_partkey * 7919 % 10007 + 1) / 10008.0{double}, 4)"


@_query(
    f"""WITH v AS (SELECT p_partkey AS feature, {_CHANCE.format(double="::DOUBLE")} AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS rk, count(*) OVER () AS m FROM v),
k AS (SELECT *, max(CASE WHEN p <= rk * 0.05::DOUBLE / m THEN rk ELSE 0 END) OVER () AS last FROM r) SELECT feature, round(p, 9) AS p, rk <= last AS significant FROM k"""
)
def bh_mask(spark, d):
    """False discoveries among as many p-values as there are parts, spread by the parts' keys."""
    chances = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.expr(_CHANCE.format(double="D")).alias("p"))
    return S.with_discoveries(chances).select("feature", F.round("p", 9).alias("p"), "significant")


@_query(f"WITH {_CELLS}, o AS (SELECT max(n) AS observed FROM cells) SELECT round((1 + sum(CASE WHEN n >= (SELECT observed FROM o) / 2 THEN 1 ELSE 0 END)) / (1 + count(*))::DOUBLE, 9) AS p FROM cells")
def perm_pvalue_from_null(spark, d):
    null = np.array([r["n"] for r in crosstab_cells(spark, d).select("n").collect()], float)
    return spark.createDataFrame([(round(S.permutation_pvalue(null.max() / 2, null), 9),)], "p double")


@_query()
def permutation_test(spark, d):
    return S.permutation_pvalues(C.feature_cells(_coded(spark, d), FEATURES, "y"), 50, 42)


# --- ranking, scores, search


@_query(f"WITH {_MI} SELECT feature, (row_number() OVER (ORDER BY mi DESC, {_PLACE}))::INT AS rank FROM mi")
def ranking(spark, d):
    mi = {r["feature"]: r["mi"] for r in _mi(spark, d).collect()}
    order = greedy.ranked(np.array([mi[f] for f in FEATURES]))
    return spark.createDataFrame([(FEATURES[i], k + 1) for k, i in enumerate(order)], "feature string, rank int")


@_query(f"WITH {_MI} SELECT feature, round(mi, 9) AS mi FROM mi WHERE feature <> 'l_quantity' ORDER BY mi DESC LIMIT 2")
def topk_candidates(spark, d):
    mi = {r["feature"]: r["mi"] for r in _mi(spark, d).collect()}
    v = np.array([mi[f] for f in FEATURES])
    short = greedy.shortlist(v, np.array([f != "l_quantity" for f in FEATURES]), 2)
    return spark.createDataFrame([(FEATURES[i], round(float(v[i]), 9)) for i in short], "feature string, mi double")


@_query(f"WITH {_CODES}, n AS (SELECT feature, len(e) + 1 AS k FROM edges) SELECT (sum(a.k * b.k) * 3)::BIGINT AS cells FROM n a JOIN n b ON a.feature < b.feature")
def cell_budget(spark, d):
    features, target, _ = _plan(_lines(spark, d))
    return spark.createDataFrame([(C.budget([c.n_codes for c in features], target.n_codes),)], "cells long")


_CHOSEN = ("l_extendedprice", "l_discount")
_REST = "feature NOT IN ('l_extendedprice', 'l_discount')"


def _scores(spark, d, criterion: str) -> DataFrame:
    """Scores of the features outside _CHOSEN, once these have been chosen: joins of the small tables of informations."""
    coded, sizes = _coded_with_sizes(spark, d)
    mi = _mi_of(coded)
    if criterion in ("mrmr", "mim"):
        with_chosen = _pair_mi_of(coded, sizes).filter(F.col("fj").isin(*_CHOSEN)).groupBy(F.col("fi").alias("feature"))
        loss = with_chosen.agg((F.avg("mi") if criterion == "mrmr" else F.sum("mi")).alias("loss"))
        out = mi.join(loss, "feature").select("feature", (F.col("mi") - F.col("loss")).alias("score"))
    else:
        gains = _cmi_of(coded, sizes).filter(F.col("fj").isin(*_CHOSEN)).groupBy(F.col("fi").alias("feature"))
        out = gains.agg((F.sum("cmi") if criterion == "jmi" else F.min("cmi")).alias("score"))
    return out.filter(~F.col("feature").isin(*_CHOSEN)).select("feature", F.round("score", 9).alias("score"))


_LOSS = "SELECT feature, round(mi - (SELECT {f}(p.mi) FROM pmi p WHERE p.fi = feature AND p.fj IN ('l_extendedprice', 'l_discount')), 9) AS score FROM mi WHERE " + _REST
_GAIN = "SELECT fi AS feature, round({f}(cmi), 9) AS score FROM cmi WHERE fj IN ('l_extendedprice', 'l_discount') AND fi NOT IN ('l_extendedprice', 'l_discount') GROUP BY 1"


@_query(f"WITH {_FULL} " + _LOSS.format(f="avg"))
def score_mrmr(spark, d):
    return _scores(spark, d, "mrmr")


@_query(f"WITH {_FULL} " + _LOSS.format(f="sum"))
def score_mim(spark, d):
    return _scores(spark, d, "mim")


@_query(f"WITH {_FULL} " + _GAIN.format(f="sum"))
def score_jmi(spark, d):
    return _scores(spark, d, "jmi")


@_query(f"WITH {_FULL} " + _GAIN.format(f="min"))
def score_jmim(spark, d):
    return _scores(spark, d, "jmim")


@_query(
    f"""WITH {_CODES}, s AS (SELECT a.rid, a.x AS z0, b.x AS z1 FROM codes a JOIN codes b USING (rid) WHERE a.feature = 'l_extendedprice' AND b.feature = 'l_discount'),
c AS (SELECT feature, x, y, CASE WHEN feature = 'l_extendedprice' THEN -1 ELSE z0 END AS z0, CASE WHEN feature = 'l_discount' THEN -1 ELSE z1 END AS z1, count(*)::DOUBLE AS n FROM codes JOIN s USING (rid) GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, z0, z1) AS nz, sum(n) OVER (PARTITION BY feature, x, z0, z1) AS nxz, sum(n) OVER (PARTITION BY feature, y, z0, z1) AS nyz, sum(n) OVER (PARTITION BY feature) AS nt FROM c)
SELECT feature, round(sum(n / nt * ln(n * nz / (nxz * nyz))), 9) AS score FROM w GROUP BY feature"""
)
def score_cmim(spark, d):
    found = estimator.CMIMSelector(target="y").fixed_gains(_coded(spark, d), FEATURES, list(_CHOSEN))
    return spark.createDataFrame([(f, round(float(v), 9)) for f, v in zip(FEATURES, found, strict=True)], "feature string, score double")


@_query(
    f"""WITH {_FULL}, r1 AS (SELECT feature AS f, mi AS s FROM mi ORDER BY mi DESC, {_PLACE} LIMIT 1),
g2 AS (SELECT fi AS feature, cmi AS s FROM cmi WHERE fj IN (SELECT f FROM r1)), r2 AS (SELECT feature AS f, s FROM g2 ORDER BY s DESC, {_PLACE} LIMIT 1),
g3 AS (SELECT fi AS feature, min(cmi) AS s FROM cmi WHERE fj IN (SELECT f FROM r1 UNION SELECT f FROM r2) AND fi NOT IN (SELECT f FROM r1 UNION SELECT f FROM r2) GROUP BY 1),
r3 AS (SELECT feature AS f, s FROM g3 ORDER BY s DESC, {_PLACE} LIMIT 1),
every AS (SELECT 1 AS round, * FROM r1 UNION ALL SELECT 2, * FROM r2 UNION ALL SELECT 3, * FROM r3)
SELECT round, f AS feature, round(s, 9) AS score FROM every e WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.round <= e.round AND o.s < 0.001)"""
)
def greedy_jmim(spark, d):
    """The search on the example's informations, at most three features, least score 0.001."""
    return _searched(spark, d, "jmim")


def _searched(spark: SparkSession, d: str, criterion: str, least: float = _LEAST) -> DataFrame:
    coded, sizes = _coded_with_sizes(spark, d)
    at = {f: i for i, f in enumerate(FEATURES)}
    mi, pair, cmi = np.zeros(len(at)), np.zeros((len(at), len(at))), np.zeros((len(at), len(at)))
    for r in _mi_of(coded).collect():
        mi[at[r["feature"]]] = r["mi"]
    if criterion in ("mrmr", "mim"):
        for r in _pair_mi_of(coded, sizes).collect():
            pair[at[r["fi"]], at[r["fj"]]] = r["mi"]
    elif criterion != "cmim":
        for r in _cmi_of(coded, sizes).collect():
            cmi[at[r["fi"]], at[r["fj"]]] = r["cmi"]

    def fixed(some: list[int]) -> np.ndarray:
        return estimator.CMIMSelector(target="y").fixed_gains(coded, FEATURES, [FEATURES[i] for i in some])

    return _chosen_rows(spark, greedy.choose(greedy.Matrices(mi, pair, cmi, fixed), criterion, 3, least))


def _chosen_rows(spark: SparkSession, got: greedy.Chosen) -> DataFrame:
    return spark.createDataFrame([(k + 1, FEATURES[i], round(s, 9)) for k, (i, s) in enumerate(zip(got.places, got.scores, strict=True))], "round int, feature string, score double")


#: Score of later rounds: {chosen} are the rounds before; ``feature`` and ``s`` come out.
_ROUND = {
    "mrmr": "SELECT m.feature, m.mi - (SELECT avg(p.mi) FROM pmi p WHERE p.fi = m.feature AND p.fj IN ({chosen})) AS s FROM mi m",
    "mim": "SELECT m.feature, m.mi - (SELECT sum(p.mi) FROM pmi p WHERE p.fi = m.feature AND p.fj IN ({chosen})) AS s FROM mi m",
    "jmi": "SELECT fi AS feature, sum(cmi) AS s FROM cmi WHERE fj IN ({chosen}) GROUP BY 1",
    "cmim": "SELECT feature, s FROM fixed",
}


def _search_sql(criterion: str, least: float = _LEAST) -> str:
    """Three rounds of a search; the best score first, the earliest feature of equals, none below the least score."""
    chosen = ["SELECT f FROM r1", "SELECT f FROM r1 UNION SELECT f FROM r2"]
    later = ", ".join(f"g{k + 2} AS ({_ROUND[criterion].format(chosen=c)}), r{k + 2} AS (SELECT feature AS f, s FROM g{k + 2} WHERE feature NOT IN ({c}) ORDER BY s DESC, {_PLACE} LIMIT 1)" for k, c in enumerate(chosen))
    return f"""WITH {_FULL}, top AS (SELECT feature, row_number() OVER (ORDER BY mi DESC, {_PLACE}) AS k FROM mi),
z AS (SELECT a.rid, a.x AS z0, b.x AS z1, a.feature AS f0, b.feature AS f1 FROM codes a JOIN codes b USING (rid) WHERE a.feature = (SELECT feature FROM top WHERE k = 1) AND b.feature = (SELECT feature FROM top WHERE k = 2)),
zc AS (SELECT feature, x, y, CASE WHEN feature = f0 THEN -1 ELSE z0 END AS z0, CASE WHEN feature = f1 THEN -1 ELSE z1 END AS z1, count(*)::DOUBLE AS n FROM codes JOIN z USING (rid) GROUP BY ALL),
fixed AS (SELECT feature, sum(n / nt * ln(n * nz / (nxz * nyz))) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY feature, z0, z1) AS nz, sum(n) OVER (PARTITION BY feature, x, z0, z1) AS nxz,
  sum(n) OVER (PARTITION BY feature, y, z0, z1) AS nyz, sum(n) OVER (PARTITION BY feature) AS nt FROM zc) GROUP BY feature),
r1 AS (SELECT feature AS f, mi AS s FROM mi ORDER BY mi DESC, {_PLACE} LIMIT 1), {later},
every AS (SELECT 1 AS round, * FROM r1 UNION ALL SELECT 2, * FROM r2 UNION ALL SELECT 3, * FROM r3)
SELECT round, f AS feature, round(s, 9) AS score FROM every e WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.round <= e.round AND o.s < {least})"""


@_query(_search_sql("mrmr", -1))
def greedy_mrmr(spark, d):
    """Three rounds, whatever the scores."""
    return _searched(spark, d, "mrmr", -1)


@_query(_search_sql("mim", -1))
def greedy_mim(spark, d):
    """Three rounds, whatever the scores."""
    return _searched(spark, d, "mim", -1)


@_query(_search_sql("jmi"))
def greedy_jmi(spark, d):
    return _searched(spark, d, "jmi")


@_query(_search_sql("cmim"))
def greedy_cmim(spark, d):
    """S_m is found by the search: the two features of most information."""
    return _searched(spark, d, "cmim")


def _fitted_example(spark: SparkSession, d: str, criterion: str) -> DataFrame:
    """The whole of ``fit`` on the example: profile, codes, screening, joint tables, search."""
    m = estimator.InfoSelector(criterion, target="y", max_features=3, screen_top_k=5, missing="drop", significance=None, min_score=_LEAST, exact_quantiles=True, subsample=None).fit(_lines(spark, d))
    return spark.createDataFrame([(k + 1, f, round(s, 9)) for k, (f, s) in enumerate(zip(m.selected_features, m.scores_, strict=True))], "round int, feature string, score double")


@_query(ORACLE["greedy_jmim"])
def fit_jmim(spark, d):
    return _fitted_example(spark, d, "jmim")


@_query(ORACLE["greedy_jmim"])
def fit_stream(spark, d):
    """The same search from counts that a stream of the lines has stored."""
    df = _lines(spark, d)
    config = {"max_features": 3, "screen_top_k": 5, "missing": "drop", "significance": None, "min_score": _LEAST}
    features, target, _ = _plan(df)
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gleaner-")
    folder = f"{base.rstrip('/')}/counts-{uuid.uuid4().hex}"
    counts = StoredCounts(spark, f"{folder}/cells", features, target, **config)
    lines = spark.readStream.schema(table(spark, d, "lineitem").schema).parquet(f"{d}/lineitem*.parquet")
    counts.start(lines.select(*FEATURES, F.expr(_TARGET).alias("y")), f"{folder}/progress", availableNow=True).awaitTermination()
    m = counts.model()
    return spark.createDataFrame([(k + 1, f, round(s, 9)) for k, (f, s) in enumerate(zip(m.selected_features, m.scores_, strict=True))], "round int, feature string, score double")


@_query(_search_sql("mrmr"))
def fit_mrmr(spark, d):
    return _fitted_example(spark, d, "mrmr")


@_query(_search_sql("cmim"))
def fit_cmim(spark, d):
    return _fitted_example(spark, d, "cmim")


@_query(
    f"""WITH {_MI}, g AS (SELECT feature, mi, (SELECT count(*) FROM lineitem) * mi AS h, len(e) + 1 AS m FROM mi JOIN edges USING (feature)),
p AS (SELECT feature, mi, list_sum(list_transform(range(0, m), lambda i: exp(i * ln(h) - h - lgamma(i + 1)))) AS p FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY p, {_PLACE}) AS rk, count(*) OVER () AS all_of FROM p), l AS (SELECT *, max(CASE WHEN p <= rk * 0.05::DOUBLE / all_of THEN rk ELSE 0 END) OVER () AS last FROM r)
SELECT feature, round(mi, 9) AS mi, round(p, 6) AS p, rk <= last AS significant, (row_number() OVER (ORDER BY mi DESC, {_PLACE}))::INT AS rank FROM l"""
)
def screening_table(spark, d):
    """Stage 1 as a table. With a code for missing values the target has three codes: as many pairs of degrees as bins."""
    df = _lines(spark, d)
    config = SelectorConfig(target="y", exact_quantiles=True)
    task = P.task_of(df, "y", config.task)
    features, target, n = P.codings(df, P.kinds_of(df, config), config, task)
    found = screen(P.encoded(df, features, target), features, target, config, n)
    return found.table(spark).select("feature", F.round("mi", 9).alias("mi"), F.round("p", 6).alias("p"), "significant", "rank")


# --- model, metrics


@_query(f"SELECT l_extendedprice, l_discount, {_TARGET} AS y FROM lineitem")
def transform_projection(spark, d):
    return estimator.SelectorModel(list(_CHOSEN), [0.0, 0.0], [], "jmim", 0, "y", "auto").transform(_lines(spark, d))


@_query(
    f"""WITH b AS (SELECT l_quantity AS s, {_TARGET} AS y FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM b)
SELECT round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r"""
)
def auc_binary(spark, d):
    return auc_of_rows(_lines(spark, d), F.col("y") == 1, F.col("l_quantity")).select(F.round("auc", 9).alias("auc"))


@_query(
    """WITH b AS (SELECT l_quantity AS s, l_returnflag AS c FROM lineitem), k AS (SELECT DISTINCT c AS k FROM b),
r AS (SELECT k, c = k AS y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS rk FROM b, k),
a AS (SELECT k, (sum(CASE WHEN y THEN rk ELSE 0 END) - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT) * (count(*) - sum(y::INT))) AS auc FROM r GROUP BY k) SELECT round(avg(auc), 9) AS auc FROM a"""
)
def auc_macro(spark, d):
    """One pass: rows are counted by score and flag; only these counts are repeated for each flag against the rest."""
    counts = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("s"), "l_returnflag").agg(F.count("*").alias("n"))
    flags = counts.agg(F.sort_array(F.collect_set("l_returnflag"))).first()[0]
    each = counts.withColumn("k", F.explode(F.array(*map(F.lit, flags))))
    cells = each.groupBy("k", "s").agg(F.sum(F.when(F.col("l_returnflag") == F.col("k"), F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("n"))
    return auc_of_cells(cells, ["k"]).agg(F.round(F.avg("auc"), 9).alias("auc"))


@_query("WITH b AS (SELECT l_extendedprice AS y, 0.9 * l_extendedprice + 10 AS p FROM lineitem), m AS (SELECT avg(y) AS my FROM b) SELECT round(1 - sum((y - p) ** 2) / sum((y - my) ** 2), 9) AS r2 FROM b, m")
def r2(spark, d):
    return r2_of_rows(table(spark, d, "lineitem"), F.col("l_extendedprice"), 0.9 * F.col("l_extendedprice") + 10).select(F.round("r2", 9).alias("r2"))


# --- whole fits: no SQL can express these


def _fitted(spark: SparkSession, df: DataFrame, criterion: str = "jmim", **config) -> DataFrame:
    m = estimator.InfoSelector(criterion, target="y", **config).fit(df)
    return spark.createDataFrame([(i + 1, f, float(s)) for i, (f, s) in enumerate(zip(m.selected_features, m.scores_, strict=True))], "place int, feature string, score double")


@_query()
def fit_lineitem(spark, d):
    return _fitted(spark, table(spark, d, "lineitem").drop("l_orderkey").withColumn("y", F.expr(_TARGET)), max_features=5, screen_top_k=10, subsample=None)


_PLANTED = {"x0": "l_partkey % 2", "x1": "l_suppkey % 2", "x2": "l_linenumber % 2", "x3": "l_partkey % 2"}
#: x0 and x1, turned over in a tenth of the rows.
_BOTH = "CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 = 0 THEN 1 - (l_partkey % 2) * (l_suppkey % 2) ELSE (l_partkey % 2) * (l_suppkey % 2) END"


@_query(
    f"""WITH base AS (SELECT row_number() OVER () AS rid, {_BOTH} AS y, {", ".join(f"{e} AS {n}" for n, e in _PLANTED.items())} FROM lineitem),
long AS (SELECT rid, y, feature, x FROM base UNPIVOT (x FOR feature IN ({", ".join(_PLANTED)}))), cells AS (SELECT feature, x, y, count(*)::DOUBLE AS n FROM long GROUP BY ALL),
one AS (SELECT feature, sum(n / nt * ln(n * nt / (nx * ny))) AS v FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS nt, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM cells) GROUP BY feature ORDER BY round(v, 12) DESC, feature LIMIT 1),
three AS (SELECT a.feature, a.x, a.y, z.x AS z, count(*)::DOUBLE AS n FROM long a JOIN long z USING (rid) WHERE z.feature = (SELECT feature FROM one) AND a.feature <> z.feature GROUP BY ALL),
two AS (SELECT feature, sum(n / nt * ln(n * nz / (nx * ny))) AS v FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS nt, sum(n) OVER (PARTITION BY feature, z) AS nz, sum(n) OVER (PARTITION BY feature, x, z) AS nx, sum(n) OVER (PARTITION BY feature, y, z) AS ny FROM three) GROUP BY feature ORDER BY round(v, 12) DESC, feature LIMIT 1)
SELECT 1 AS place, feature, round(v, 9) AS score FROM one UNION ALL SELECT 2, feature, round(v, 9) FROM two"""
)
def planted_recovery(spark, d):
    """Two parts of a conjunction among a copy and an independent feature, planted in the lines."""
    df = table(spark, d, "lineitem").select(*[F.expr(e).alias(n) for n, e in _PLANTED.items()], F.expr(_BOTH).alias("y"))
    return _fitted(spark, df, max_features=2, screen_top_k=4, subsample=None).withColumn("score", F.round("score", 9))


@_query()
def benchmark_recovery(spark, d):
    """Five informative axes of the embeddings, copies of two of them, and twenty others; the target is the five's sum with noise."""
    axis = lambda i: F.col("embedding")[i].cast("double")
    good, others = [axis(i).alias(f"x{i}") for i in range(5)], [axis(i).alias(f"n{i}") for i in range(5, 25)]
    copies = [(axis(i) + 0.01 * axis(30 + i)).alias(f"r{i}") for i in range(2)]
    y = (sum(axis(i) for i in range(5)) + 0.5 * axis(40) > 0).cast("long").alias("y")
    return _fitted(spark, table(spark, d, "embeddings").select(*good, *copies, *others, y), max_features=20, screen_top_k=200)


_AXES, _NEAR = [f"x{i}" for i in range(6)], 10


def _ksg_sql(requests: dict[str, tuple[list[str], list[str]]]) -> str:
    """Tables ``pts`` and ``ksg`` (name, v) of the informations of some columns of ``pts``: every distance is taken."""
    far = lambda columns: "sqrt(" + " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in columns) + ")"
    each = [
        f"""SELECT '{name}' AS name, rid, count(*) FILTER (da <= r) AS na, count(*) FILTER (db <= r) AS nb FROM (SELECT *, max(CASE WHEN rk = {_NEAR} + 1 THEN dj END) OVER (PARTITION BY rid) AS r
  FROM (SELECT p.rid, {far(a)} AS da, {far(b)} AS db, {far([*a, *b])} AS dj, row_number() OVER (PARTITION BY p.rid ORDER BY {far([*a, *b])}) AS rk FROM pts p, pts q)) GROUP BY rid"""
        for name, (a, b) in requests.items()
    ]
    return f"""pts AS (SELECT row_number() OVER () AS rid, {", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(len(_AXES)))}, embedding[1]::DOUBLE + 0.5::DOUBLE * embedding[2]::DOUBLE + 0.3::DOUBLE * embedding[7]::DOUBLE AS y FROM embeddings),
psi AS (SELECT n, -0.57721566490153286061 + coalesce(sum(1.0::DOUBLE / (n - 1)) FILTER (n > 1) OVER (ORDER BY n), 0) AS psi FROM range(1, (SELECT count(*) + 1 FROM embeddings)) t(n)),
counts AS ({" UNION ALL ".join(each)}),
ksg AS (SELECT name, greatest(0, (SELECT psi FROM psi WHERE n = {_NEAR}) + ln(count(*)) - avg(a.psi + b.psi)) AS v FROM counts JOIN psi a ON na = a.n JOIN psi b ON nb = b.n GROUP BY name)"""


def _axes(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings")
    x = [F.col("embedding")[i].cast("double") for i in range(7)]
    return df.select(*[c.alias(n) for c, n in zip(x, _AXES, strict=False)], (x[0] + 0.5 * x[1] + 0.3 * x[6]).alias("y"))


_GAINS = {f"{x}+{z}": ([x, z], ["y"]) for x in _AXES for z in _AXES if x != z}


@_query(f"WITH {_ksg_sql({x: ([x], ['y']) for x in _AXES} | {'x0+x1': (['x0', 'x1'], ['y']), 'x2, x3': (['x2'], ['x3'])})} SELECT name, round(v, 9) AS information FROM ksg")
def ksg_informations(spark, d):
    """By nearest neighbours: each axis and a sum of three, two axes and that sum, two axes of one another."""
    df = _axes(spark, d).persist()
    requests = {x: ((x,), ("y",)) for x in _AXES} | {"x0+x1": (("x0", "x1"), ("y",)), "x2, x3": (("x2",), ("x3",))}
    found = neighbours.informations(df, df.count(), list(requests.values()), _NEAR)
    df.unpersist()
    return spark.createDataFrame([(n, round(v, 9)) for n, v in zip(requests, found, strict=True)], "name string, information double")


@_query(
    f"""WITH {_ksg_sql({x: ([x], ["y"]) for x in _AXES} | _GAINS)}, one AS (SELECT name, v FROM ksg WHERE name NOT LIKE '%+%' ORDER BY v DESC, name LIMIT 1),
two AS (SELECT split_part(k.name, '+', 1) AS name, k.v - one.v AS v FROM ksg k, one WHERE split_part(k.name, '+', 2) = one.name ORDER BY v DESC, name LIMIT 1)
SELECT 1 AS place, name AS feature, round(v, 9) AS score FROM one WHERE v >= 0.0001 UNION ALL SELECT 2, name, round(v, 9) FROM two WHERE v >= 0.0001 AND (SELECT v FROM one) >= 0.0001"""
)
def ksg_selection(spark, d):
    """A whole search by nearest neighbours: the axis that tells most of a sum of three, and the one that adds most to it."""
    found = _fitted(spark, _axes(spark, d), estimator="ksg", max_features=2, screen_top_k=6)
    return found.withColumn("score", F.round("score", 9))


@_query()
def efficiency_prefix(spark, d):
    curve = evaluate.efficiency_curve(_lines(spark, d), ["l_extendedprice", "l_discount"], "y")
    return spark.createDataFrame([(k, float(v)) for k, v in curve], "features int, auc double")
