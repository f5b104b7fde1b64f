"""The most frequent values of wide columns, exactly: by falling count, then value.

1. Values are hashed to 64 bits where they are read, so only numbers move. Each task keeps a Misra-Gries summary of COUNTERS hashes a column:
   a hash's true number of rows lies between its counter and that plus the summary's error (what was taken from all counters when there
   were too many). Summaries add up: so do counters, and so do errors.
2. Hashes that may be among the ``k`` first are counted by value, in one pass. If all others are known to be rarer than the k-th
   value so found, the column is settled. COUNTERS rows a column and task are the most that moves.
3. What is left (no value stands out of the error) is counted by hash: (hash, number) for each different value, never the value. If the k-th number is
   reached by SURVIVORS hashes at most, these are counted by value, as above. If it is 1, all but fewer than k values occur once, and each task sends its
   k least values besides. Else, and where different values share a hash, values themselves are counted; each task then sends its k first.

No column's values are sorted in one task, and what reaches the driver is bounded by COUNTERS or SURVIVORS a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counters of a summary (1000 rows of a group are the most that Spark cuts before it sends them); hashes of a column that are counted by value.
COUNTERS, SURVIVORS = 1000, 2000
#: Values that a task holds before it adds them to its summary.
_HELD = 1 << 16


class Summary:
    """Misra-Gries counters of whole numbers."""

    def __init__(self, counters: int = COUNTERS):
        self.counters, self.error = counters, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, weights: np.ndarray | None = None) -> None:
        keys, back = np.unique(np.concatenate([self.keys, values]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([self.counts, np.ones(len(values)) if weights is None else weights]), len(keys)).astype(np.int64)
        if len(keys) > self.counters:
            cut = int(np.partition(counts, -self.counters - 1)[-self.counters - 1])
            self.error += cut
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
        self.keys, self.counts = keys, counts

    def merge(self, other: Summary) -> None:
        self.error += other.error
        self.add(other.keys, other.counts)


def _hash(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def _summed(batches: Iterator[pa.RecordBatch], columns: int, counters: int) -> Iterator[pa.RecordBatch]:
    """(column, hash, n) of a task's summaries; their errors with a null hash."""
    found = [Summary(counters) for _ in range(columns)]
    held: list[list[np.ndarray]] = [[] for _ in range(columns)]
    rows = 0

    def take() -> None:
        for s, values in zip(found, held, strict=True):
            if values:
                s.add(np.concatenate(values))
                values.clear()

    for b in batches:
        for values, c in zip(held, b.columns, strict=True):
            values.append(c.drop_null().to_numpy())
        rows += b.num_rows
        if rows >= _HELD:
            take()
            rows = 0
    take()
    for i, s in enumerate(found):
        keys = pa.array([*s.keys.tolist(), None], pa.int64())
        yield pa.record_batch([pa.array(np.full(len(keys), i, np.int32)), keys, pa.array([*s.counts.tolist(), s.error], pa.int64())], ["column", "hash", "n"])


def summaries(texts: DataFrame, counters: int = COUNTERS) -> dict[str, tuple[dict[int, int], int]]:
    """({hash: counter} of the ``counters`` largest counters, error) of each column of texts. One pass."""
    names = texts.columns
    hashes = texts.select(*[_hash(F.col(_q(n))).alias(f"h{i}") for i, n in enumerate(names)])
    parts = hashes.mapInArrow(lambda it: _summed(it, len(names), counters), "column int, hash long, n long")
    sums = parts.groupBy("column", "hash").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("column", F.isnull("hash")).orderBy(F.desc("n"), "hash")
    out: dict[str, tuple[dict[int, int], int]] = {n: ({}, 0) for n in names}
    for r in sums.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= counters).collect():
        counts, error = out[names[r["column"]]]
        if r["hash"] is None:
            out[names[r["column"]]] = (counts, r["n"])
        else:
            counts[r["hash"]] = r["n"]
    return out


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _long(texts: DataFrame, names: list[str]) -> DataFrame:
    """(i, value) of the columns; nulls are left out."""
    some = texts.select(*[F.col(_q(n)).alias(f"f{i}") for i, n in enumerate(names)])
    return some.unpivot([], some.columns, "i", "value").filter("value is not null")


def _counted(texts: DataFrame, hashes: dict[str, list[int]]) -> dict[str, list[tuple[str, int]]]:
    """(value, number of rows) of the values with one of their column's hashes."""
    names = [n for n, some in hashes.items() if some]
    out: dict[str, list[tuple[str, int]]] = {n: [] for n in hashes}
    if not names:
        return out
    spark = texts.sparkSession
    wanted = spark.createDataFrame([(f"f{i}", h) for i, n in enumerate(names) for h in hashes[n]], "i string, hash long")
    long = _long(texts, names).withColumn("hash", _hash(F.col("value")))
    for r in long.join(F.broadcast(wanted), ["i", "hash"], "left_semi").groupBy("i", "value").agg(F.count("*").alias("n")).collect():
        out[names[int(r["i"][1:])]].append((r["value"], r["n"]))
    return out


def _first(found: list[tuple[str, int]], k: int) -> list[tuple[str, int]]:
    return sorted(found, key=lambda v: (-v[1], v[0].encode("utf-8", "surrogatepass")))[:k]


def _settled(found: list[tuple[str, int]], k: int, others: int) -> bool:
    """Whether the ``k`` first of all are among those found, if no other value has more than ``others`` rows."""
    return others == 0 or len(found) >= k and sorted((n for _, n in found), reverse=True)[k - 1] > others


def _by_hash(texts: DataFrame, k: int, survivors: int) -> dict[str, list[tuple[str, int]]]:
    names, spark = texts.columns, texts.sparkSession
    hashes = texts.select(*[_hash(F.col(_q(n))).alias(f"f{i}") for i, n in enumerate(names)])
    numbers = hashes.unpivot([], hashes.columns, "i", "hash").filter("hash is not null").groupBy("i", "hash").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        top = numbers.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "hash"))).filter(F.col("place") <= k)
        kth = {n: 1 for n in names}
        several: dict[str, list[int]] = {n: [] for n in names}
        for r in top.collect():
            name = names[int(r["i"][1:])]
            if r["place"] == k:
                kth[name] = r["n"]
            if r["n"] > 1:
                several[name].append(r["hash"])
        reach = spark.createDataFrame([(f"f{i}", kth[n]) for i, n in enumerate(names)], "i string, least long")
        reaching = numbers.join(F.broadcast(reach), "i").filter("n >= least")
        sizes = {names[int(r["i"][1:])]: r["m"] for r in reaching.groupBy("i").agg(F.count("*").alias("m")).collect()}
        few = [n for n in names if sizes.get(n, 0) <= survivors]
        asked: dict[str, list[int]] = {n: [] for n in few}
        for r in reaching.filter(F.col("i").isin([f"f{names.index(n)}" for n in few])).collect():
            asked[names[int(r["i"][1:])]].append(r["hash"])
        once = [n for n in names if n not in few and kth[n] == 1]
        found = _counted(texts, asked | {n: several[n] for n in once})
        least = _least_values(texts, once, k, several)
    finally:
        numbers.unpersist()
    out = {n: _first(found[n], k) for n in few if _settled(found[n], k, kth[n] - 1)}
    # a hash that several values share hides that they, or it, occur once
    out |= {n: _first(found[n] + [(v, 1) for v in least[n]], k) for n in once if len(found[n]) == len(several[n])}
    left = [n for n in names if n not in out]
    return out | (_by_value(texts, left, k) if left else {})


def _least_values(texts: DataFrame, names: list[str], k: int, but: dict[str, list[int]]) -> dict[str, list[str]]:
    """The ``k`` least values of columns whose values occur once, but for those with some hashes."""
    out: dict[str, list[str]] = {n: [] for n in names}
    if not names:
        return out
    gone = texts.sparkSession.createDataFrame([(f"f{i}", h) for i, n in enumerate(names) for h in but[n]], "i string, hash long")
    long = _long(texts, names).withColumn("hash", _hash(F.col("value"))).join(F.broadcast(gone), ["i", "hash"], "left_anti")
    for r in _placed(long.select("i", "value"), ["value"], k).collect():
        out[names[int(r["i"][1:])]].append(r["value"])
    return out


def _placed(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The ``k`` first rows of each column. Only the place is asked for, so that each task sends its ``k`` first and no more."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy(*order))).filter(F.col("place") <= k)


def _by_value(texts: DataFrame, names: list[str], k: int) -> dict[str, list[tuple[str, int]]]:
    out: dict[str, list[tuple[str, int]]] = {n: [] for n in names}
    counts = _long(texts, names).groupBy("i", "value").agg(F.count("*").alias("n"))
    for r in _placed(counts, [F.desc("n"), "value"], k).collect():
        out[names[int(r["i"][1:])]].append((r["value"], r["n"]))
    return {n: _first(v, k) for n, v in out.items()}


def top_values(texts: DataFrame, k: int, counters: int = COUNTERS, survivors: int = SURVIVORS) -> dict[str, list[tuple[str, int]]]:
    """The ``k`` first (value, number of rows) of each column (all are texts; nulls don't count)."""
    if not texts.columns:
        return {}
    asked, others, least = {}, {}, {}
    for name, (counts, error) in summaries(texts, counters).items():
        order = sorted(counts.values(), reverse=True)
        least[name] = order[k - 1] if len(order) >= k else 1
        asked[name] = [h for h, n in counts.items() if n + error >= least[name]]
        # the most rows that a value may have that isn't counted below
        rest = [n + error for n in counts.values() if n + error < least[name]]
        unseen = order[-1] + error if len(order) == counters else error
        others[name] = max([*rest, unseen])
    # a column is counted only if it can be settled: no value outside may have as many rows as the k-th counter
    found = _counted(texts, {n: some for n, some in asked.items() if others[n] < least[n]})
    out = {n: _first(v, k) for n, v in found.items() if _settled(v, k, others[n])}
    left = [n for n in texts.columns if n not in out]
    if left:
        out |= _by_hash(texts.select(*map(_q, left)), k, survivors)
    return {n: out[n] for n in texts.columns}
