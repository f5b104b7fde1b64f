"""What the operators of this folder share: the shared work folder and joins that hot keys don't slow."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1e-3
#: Parts of a hot key's rows.
SALTS = 256
#: Bytes of an Arrow batch: rows may hold long texts or whole sets.
BATCH_BYTES = 16 << 20
#: Hold while a table is staged: bounded batches, and shuffle files that go when the table is written.
_WHILE_STAGED = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, deleted when the session's JVM ends.

    Only a local master may leave that setting out (tests, notebooks); then a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/gleaner-{uuid.uuid4().hex}"
    path, system = _hadoop(spark, folder)
    system.deleteOnExit(path)
    return folder


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Folders of the tables staged in each scope that is open, innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = []


def staged(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage that survives lost executors."""
    spark = df.sparkSession
    folder = f"{work_folder(spark)}/{name}"
    with _settings(spark, _WHILE_STAGED):
        df.write.options(**options).parquet(folder)
    if _scopes:
        _scopes[-1].append((spark, folder))
    table = spark.read.schema(df.schema).parquet(folder)
    table.staged_in = folder
    return table


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Tables staged within are deleted at its end, but for those that it was told to keep."""
    mine: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()
    _scopes.append(mine)
    try:
        yield lambda *tables: kept.update(t.staged_in for t in tables)
    finally:
        _scopes.remove(mine)
        for spark, folder in mine:
            if folder not in kept:
                _deleted(spark, folder)
            elif _scopes:
                _scopes[-1].append((spark, folder))


def _deleted(spark: SparkSession, folder: str) -> None:
    path, system = _hadoop(spark, folder)
    system.delete(path.getParent(), True)


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        _deleted(t.sparkSession, t.staged_in)


#: What a Python worker keeps from task to task of a stage: (stage, thing) by name.
_kept: dict[tuple, tuple[int, Any]] = {}


def _stage() -> int:
    task = TaskContext.get()
    return task.stageId() if task else -1


def kept_in_worker(name: tuple, make: Callable[[], Any]) -> Any:
    """A thing that is dear to make, such as a tokenizer with its memo, made once for all tasks of a stage in a worker."""
    _kept[name] = (_stage(), _kept[name][1] if name in _kept else make())
    return _kept[name][1]


def freed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches in a worker that is kept for other tasks: what it kept for other stages goes before,
    and free memory is given back after."""

    def run(batches: Iterator) -> Iterator:
        if others := [n for n, (stage, _) in _kept.items() if stage != _stage()]:
            for name in others:
                del _kept[name]
            _give_back()
        yield from work(batches)
        _give_back()

    return run


def _give_back() -> None:
    """Free memory to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def collected(spark: SparkSession) -> None:
    """Collects the executors' heaps, so that what earlier work left of them, and of native buffers, goes back to the system.

    A heap grows with the garbage of what ran in it and is given back by a full collection only. One task a core, which all
    begin at once on idle executors; a task that comes twice to one executor, or never, changes no result.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def in_stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First place and end of stretches of items that have ``most`` together at most, or are one item."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with their ``groups`` (one row a key; ``size`` counts the key's rows) that no key can skew.

    Keys holding over HOT_SHARE of all rows number at most 1 / HOT_SHARE, whatever the input; hashes of these alone reach
    the driver. Their rows are dealt to SALTS parts, and each part has a copy of the key's group. Both inputs should be staged.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    name, hot = F.xxhash64(*keys), [0]  # never empty: the plan is the same whatever the data
    if total >= 1 / HOT_SHARE:
        hot += [r[0] for r in groups.filter(F.col(size) > total * HOT_SHARE).select(name).distinct().collect()]
    (salt,) = unused(rows, "salt")
    dealt = rows.withColumn(salt, F.when(name.isin(hot), F.monotonically_increasing_id() % SALTS).otherwise(F.lit(0)).cast("int"))
    copies = F.when(name.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(groups.withColumn(salt, F.explode(copies)), [*keys, salt], how).drop(salt)
