"""Where rows come from and go to: tables, generators with planted structure, result files."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(spark: SparkSession, data: dict[str, list], target: str = "y", as_strings: bool = False) -> DataFrame:
    """Columns of Python values as a DataFrame; with ``as_strings`` the target becomes text."""
    columns = {k: [str(v) for v in vs] if as_strings and k == target else list(vs) for k, vs in data.items()}
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


ROLES, TARGETS = ("informative", "independent", "redundant", "correlated"), ("and", "linear", "flip")


def checked(n: int, features: list[dict[str, Any]], target: dict[str, Any]) -> list[str]:
    """Refuses structures that can't be planted; gives the names of the informative features."""
    names = [f["name"] for f in features]
    kind, good = target["kind"], [f for f in features if f["role"] == "informative"]
    rules = [
        (n > 0, "n must be positive"),
        (len(set(names)) == len(names) and "y" not in names, f"names must differ from each other and from y: {names}"),
        (kind in TARGETS, f"the target must be one of {TARGETS}, not {kind!r}"),
        (target.get("noise", 0) >= 0, "the target's noise must not be negative"),
        (bool(good) == (kind != "flip"), "targets but flip, and only they, have informative features"),
        (kind != "and" or all(f.get("levels", 2) == 2 for f in good), "the target and needs features of two levels"),
    ]
    for k, f in enumerate(features):
        role = f["role"]
        rules += [
            (role in ROLES, f"the role of {f['name']} must be one of {ROLES}, not {role!r}"),
            (f.get("levels", 2) >= 0, f"{f['name']} needs levels, or 0 for normal values"),
            (role != "redundant" or f.get("of") in names[:k], f"{f['name']} copies {f.get('of')}, which doesn't stand before it"),
            (f.get("noise", 0) >= 0, f"the noise of {f['name']} must not be negative"),
            (role != "correlated" or kind == "flip", f"{f['name']} is correlated, which only a target of kind flip allows"),
            (role != "correlated" or 0 < (f.get("agree") or 0) < 1, f"{f['name']} must agree with a chance between 0 and 1"),
        ]
    if wrong := [message for holds, message in rules if not holds]:
        raise ValueError("; ".join(wrong))
    return [f["name"] for f in good]


def planted(n: int, seed: int, features: list[dict[str, Any]], target: dict[str, Any]) -> dict[str, list]:
    """Columns with known roles, and a target ``y``.

    A feature has a name and a role: informative or independent (codes 0 .. levels - 1, or normal if ``levels`` is 0),
    redundant (a copy of ``of`` plus normal noise of the width ``noise``), correlated (agrees with the target with the
    chance ``agree``). Targets: and (of the informative features, a share ``noise`` flipped); linear (sum of the
    informative features, by ``weights`` if given, plus normal noise of the width ``noise``; with ``thresholds``, how many
    of them it exceeds); flip (0 or 1 at random).
    """
    good = checked(n, features, target)
    rng = np.random.default_rng(seed)
    noise = target.get("noise", 0)
    y = rng.integers(0, 2, n) if target["kind"] == "flip" else None
    x: dict[str, np.ndarray] = {}
    for f in features:
        if f["role"] == "redundant":
            x[f["name"]] = x[f["of"]] + (f["noise"] * rng.standard_normal(n) if f.get("noise") else 0)
        elif f["role"] == "correlated":
            x[f["name"]] = np.where(rng.random(n) < f["agree"], y, 1 - y)
        else:
            levels = f.get("levels", 2)
            x[f["name"]] = rng.integers(0, levels, n) if levels else rng.standard_normal(n)
    if target["kind"] == "and":
        y = np.logical_and.reduce([x[k] == 1 for k in good]).astype(int)
        y = np.where(rng.random(n) < noise, 1 - y, y)
    elif target["kind"] == "linear":
        weights = target.get("weights") or dict.fromkeys(good, 1)
        y = sum(w * x[k] for k, w in weights.items()) + noise * rng.standard_normal(n)
        if target.get("thresholds"):
            y = sum((y > t).astype(int) for t in target["thresholds"])
    return {k: v.tolist() for k, v in x.items()} | {"y": np.asarray(y).tolist()}


def benchmark_rows(spark: SparkSession, n: int, features: int, informative: int = 10, redundant: int = 5, seed: int = 42, task: str = "binary") -> DataFrame:
    """Generated on the executors: x* carry the target, r* are noisy copies of them in turn, n* are noise."""
    if informative + redundant > features:
        raise ValueError(f"{informative} informative and {redundant} redundant are more than {features} features")
    others = features - informative - redundant
    df = spark.range(n).select(*[F.randn(seed + i).alias(f"x{i}") for i in range(informative)], F.randn(seed + 7919).alias("e"), *[F.randn(seed + 100_000 + i).alias(f"n{i}") for i in range(others)], *[F.randn(seed + 200_000 + i).alias(f"d{i}") for i in range(redundant)])
    total = sum(F.col(f"x{i}") for i in range(informative))
    copies = [(F.col(f"x{i % informative}") + 0.01 * F.col(f"d{i}")).alias(f"r{i}") for i in range(redundant)]
    y = (total + 0.5 * F.col("e") > 0).cast("long") if task == "binary" else total + 0.1 * F.col("e")
    return df.select(*[f"x{i}" for i in range(informative)], *copies, *[f"n{i}" for i in range(others)], y.alias("y"))


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(folder)


def write_json(path: str, document: dict) -> None:
    """Replaces a small file as a whole."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w") as f:
        json.dump(document, f, indent=1)
    os.replace(part, path)


def read_json(path: str, default: Any) -> Any:
    if not os.path.exists(path):
        return default
    with open(path) as f:
        return json.load(f)


def read_points(path: str) -> dict:
    """A grid's results so far: meta and points; an older file is a bare list of points."""
    found = read_json(path, {})
    return {"meta": {}, "points": found} if isinstance(found, list) else {"meta": found.get("meta", {}), "points": found.get("points", [])}
