"""Planted tables of any size, drawn by the executors: a data source whose rows don't depend on its partitions.

A column's values of BLOCK rows come from a counter-based generator keyed by the seed and the column, whose counter is the block's number. So any task can
draw any rows, and a row is the same for every number of partitions. Roles and targets are those of ``tables.planted`` (the draws differ).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.sources.tables import checked

BLOCK = 1 << 16


class Rows(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class PlantedReader(DataSourceReader):
    def __init__(self, spec: dict[str, Any]):
        self.n, self.seed, self.features, self.target, self.parts = (spec[k] for k in ("n", "seed", "features", "target", "partitions"))

    def partitions(self) -> list[Rows]:
        edge = [self.n * i // self.parts for i in range(self.parts + 1)]
        return [Rows(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        at = partition.first
        while at < partition.end:
            block, end = at // BLOCK, min(partition.end, (at // BLOCK + 1) * BLOCK)
            yield self._rows(block, at - block * BLOCK, end - block * BLOCK)
            at = end

    def _rows(self, block: int, first: int, end: int) -> pa.RecordBatch:
        def drawn(column: int) -> np.random.Generator:
            return np.random.Generator(np.random.Philox(key=[self.seed, column], counter=[0, 0, 0, block]))

        kind, noise = self.target["kind"], self.target.get("noise", 0)
        last = len(self.features)
        y = drawn(last).integers(0, 2, BLOCK) if kind == "flip" else None
        x: dict[str, np.ndarray] = {}
        for k, f in enumerate(self.features):
            g = drawn(k)
            if f["role"] == "redundant":
                x[f["name"]] = x[f["of"]] + (f["noise"] * g.standard_normal(BLOCK) if f.get("noise") else 0)
            elif f["role"] == "correlated":
                x[f["name"]] = np.where(g.random(BLOCK) < f["agree"], y, 1 - y)
            else:
                levels = f.get("levels", 2)
                x[f["name"]] = g.integers(0, levels, BLOCK) if levels else g.standard_normal(BLOCK)
        good = [f["name"] for f in self.features if f["role"] == "informative"]
        if kind == "and":
            y = np.logical_and.reduce([x[k] == 1 for k in good]).astype(np.int64)
            y = np.where(drawn(last).random(BLOCK) < noise, 1 - y, y)
        elif kind == "linear":
            weights = self.target.get("weights") or dict.fromkeys(good, 1)
            y = sum(w * x[k] for k, w in weights.items()) + noise * drawn(last).standard_normal(BLOCK)
            if self.target.get("thresholds"):
                y = sum((y > t).astype(np.int64) for t in self.target["thresholds"])
        columns = [*x.values(), y]
        return pa.record_batch([pa.array(c[first:end]) for c in columns], [*x, "y"])


class PlantedSource(DataSource):
    """The option ``spec``: n, seed, features, target and partitions as JSON."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_planted"

    def schema(self) -> str:
        batch = PlantedReader(json.loads(self.options["spec"]))._rows(0, 0, 0)
        return ", ".join(f"`{f.name}` {'double' if f.type == pa.float64() else 'long'}" for f in batch.schema)

    def reader(self, schema: Any) -> PlantedReader:
        return PlantedReader(json.loads(self.options["spec"]))


def planted_rows(spark: SparkSession, n: int, seed: int, features: list[dict[str, Any]], target: dict[str, Any], partitions: int | None = None) -> DataFrame:
    """``n`` rows of features with known roles and the target ``y`` (see ``tables.planted``), drawn where they are read."""
    checked(n, features, target)
    spark.dataSource.register(PlantedSource)
    spec = {"n": n, "seed": seed, "features": features, "target": target, "partitions": partitions or spark.sparkContext.defaultParallelism}
    return spark.read.format("gleaner_planted").option("spec", json.dumps(spec)).load()
