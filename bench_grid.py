"""Fits over a grid of rows x features on generated tables: seconds of each stage, memory, features recovered.

    python bench_grid.py [--full | --points 10000x25,100000x200] [--task binary | continuous] [--out FILE] [--cpus N] [--memory 12g]

A table is generated on the executors, written as Parquet and read back. Each point has a session of its own, and memory is sampled
while it runs. Results go to a JSON file after each point; points that it holds already are not run again.
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import tempfile
import threading
import time

import psutil
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))  # for the workers
from gleaner.estimator import STAGES, JMIMSelector  # noqa: E402
from gleaner.sources.tables import benchmark_rows, read_points, write_json  # noqa: E402

# fixed values: the points of the published grid
QUICK = [(n, f) for n in (10_000, 100_000) for f in (25, 200)]
FULL = [(n, f) for n in (10_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000) for f in (25, 50, 100, 200, 500, 1000)]


class Memory:
    """Most MB that this process, its JVM and the JVM's Python workers held, sampled twice a second."""

    def __enter__(self) -> Memory:
        self.most, self._done = {"python_mb": 0, "jvm_mb": 0, "workers_mb": 0}, threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._done.set()
        self._thread.join()

    def _watch(self) -> None:
        me = psutil.Process()
        while not self._done.wait(0.5):
            now = {"python_mb": me.memory_info().rss >> 20, "jvm_mb": 0, "workers_mb": 0}
            for p in me.children(recursive=True):
                try:
                    now["jvm_mb" if "java" in p.name() else "workers_mb"] += p.memory_info().rss >> 20
                except psutil.Error:  # ended meanwhile
                    continue
            self.most = {k: max(v, now[k]) for k, v in self.most.items()}


def point(spark: SparkSession, n: int, features: int, task: str) -> dict:
    with tempfile.TemporaryDirectory() as folder, Memory() as memory:
        benchmark_rows(spark, n, features, task=task).write.parquet(f"{folder}/rows")
        df = spark.read.parquet(f"{folder}/rows")
        began = time.time()
        model = JMIMSelector(target="y", max_features=20, screen_top_k=200, seed=42).fit(df)
        took = time.time() - began
    stages = {s: round(model.timings_.get(s, 0.0), 3) for s in STAGES}
    return {"n": n, "features": features, "task": task, **stages, "total": round(took, 3), **memory.most, "selected": len(model.selected_features), "recovered": sum(f.startswith("x") for f in model.selected_features)}


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--full", action="store_true")
    args.add_argument("--points")
    args.add_argument("--out", default="grid.json")
    args.add_argument("--task", default="binary", choices=("binary", "continuous"))
    args.add_argument("--cpus", default=os.environ.get("BENCH_CPUS", "8"))
    args.add_argument("--memory", default=os.environ.get("BENCH_MEMORY", "12g"))
    args.add_argument("--here", action="store_true", help="run one point in this process and print it")
    args = args.parse_args()
    grid = [tuple(map(int, p.split("x"))) for p in args.points.split(",")] if args.points else FULL if args.full else QUICK
    if args.here:
        spark = SparkSession.builder.master(f"local[{args.cpus}]").config("spark.sql.shuffle.partitions", args.cpus).config("spark.driver.memory", args.memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        print(json.dumps(point(spark, *grid[0], args.task)), flush=True)
        spark.stop()
        return
    found = read_points(args.out)
    found["meta"] = {"cpus": args.cpus, "memory": args.memory}
    for n, features in grid:
        if not any((p["n"], p["features"], p.get("task", "binary")) == (n, features, args.task) for p in found["points"]):
            more = ["--points", f"{n}x{features}", "--task", args.task, "--cpus", args.cpus, "--memory", args.memory, "--here"]
            out = subprocess.run([sys.executable, os.path.abspath(__file__), *more], stdout=subprocess.PIPE, text=True, check=True).stdout
            found["points"].append(json.loads(out.splitlines()[-1]))
            write_json(args.out, found)
            print(found["points"][-1], flush=True)


if __name__ == "__main__":
    main()
