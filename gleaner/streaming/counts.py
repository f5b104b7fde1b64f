"""A selection that follows its input: counts are sums, so those of a stream's batches add up to those of the whole.

``StoredCounts`` keeps the cells of each micro-batch as files below a folder, under the batch's number: a batch that comes again after a
failure replaces what it wrote before, so that every row counts once. ``model`` searches from the stored cells alone; no row is read again, nothing
is held in memory between batches. ``compact`` adds batches up, so that the number of files stays small; what was added up is known by its name
(first and last batch), so a failure between writing the sum and deleting its parts changes nothing.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.config import SelectorConfig
from gleaner.estimator import SelectorModel
from gleaner.functions.measures import cmi_of_cells, mi_of_cells
from gleaner.operators import cells as C
from gleaner.operators import greedy
from gleaner.operators import profile as P
from gleaner.operators.screening import screen_cells

#: Cells of a batch: of pairs i < j, or with j = -1 of a feature alone.
_SCHEMA = "i int, j int, xi int, xj int, y int, n long"


class StoredCounts:
    """The running counts of coded features and a target, in files below ``folder`` (on storage that the driver and all executors share).

    ``features`` and ``target`` are codings (``profile.codings`` of what is there at first, say): what is counted must not change its codes later.
    """

    def __init__(self, spark: SparkSession, folder: str, features: list[P.Coding], target: P.Coding, criterion: str = "jmim", **config: Any):
        if criterion not in greedy.CRITERIA:
            raise ValueError(f"criterion must be one of {greedy.CRITERIA}, not {criterion!r}")
        self.config = SelectorConfig(target=target.name, **config)
        if criterion == "cmim" and self.config.cmim_approx is None:
            raise ValueError("counts of pairs don't tell what cmim asks for; cmim_approx='max_min' does with them")
        self.spark, self.folder, self.features, self.target, self.criterion = spark, folder.rstrip("/"), features, target, criterion

    # --- what is stored

    def _system(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> list[tuple[int, int]]:
        """(first, last) batch of each stored sum, without unfinished ones and those that another holds."""
        path, system = self._system(self.folder)
        if not system.exists(path):
            return []
        found = []
        for s in system.listStatus(path):
            first, _, last = s.getPath().getName().partition("-")
            if first.isdigit() and last.isdigit() and system.exists(self._system(f"{s.getPath()}/_SUCCESS")[0]):
                found.append((int(first), int(last)))
        return sorted(p for p in found if not any(o != p and o[0] <= p[0] and p[1] <= o[1] for o in found))

    def _path(self, part: tuple[int, int]) -> str:
        return f"{self.folder}/{part[0]}-{part[1]}"

    def cells(self) -> DataFrame:
        """The sums over all batches."""
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], _SCHEMA)
        every = self.spark.read.schema(_SCHEMA).parquet(*map(self._path, parts))
        return every.groupBy("i", "j", "xi", "xj", "y").agg(F.sum("n").alias("n"))

    # --- what arrives

    def add(self, rows: DataFrame, batch: int) -> None:
        """Counts a batch. The same number again replaces what it counted, unless the batch has been added up with others: then it changes nothing."""
        if any(a <= batch <= b and a < b for a, b in self.parts()):
            return
        codes = P.encoded(rows, self.features, self.target, self.config.missing).persist()
        try:
            names = [f.name for f in self.features]
            place = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, i)])
            one = C.feature_cells(codes, names, self.target.name).select(place[F.col("feature")].alias("i"), F.lit(-1).alias("j"), F.col("x").alias("xi"), F.lit(None).cast("int").alias("xj"), "y", "n")
            two = C.pair_cells(codes, names, self.target.name, [f.n_codes for f in self.features], self.target.n_codes)
            one.unionByName(two).write.mode("overwrite").parquet(self._path((batch, batch)))
        finally:
            codes.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """Counts the batches of a stream; ``trigger`` as of ``writeStream.trigger``."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def compact(self) -> None:
        """Adds all stored sums up to one."""
        parts = self.parts()
        if len(parts) > 1:
            self.cells().write.mode("overwrite").parquet(self._path((parts[0][0], parts[-1][1])))
        kept = set(self.parts())
        path, system = self._system(self.folder)
        for s in list(system.listStatus(path)) if system.exists(path) else []:
            first, _, last = s.getPath().getName().partition("-")
            if first.isdigit() and last.isdigit() and (int(first), int(last)) not in kept:
                system.delete(s.getPath(), True)

    # --- what follows from it

    def model(self) -> SelectorModel:
        """The selection from the counts so far."""
        c, names = self.config, [f.name for f in self.features]
        stored = self.cells().persist()
        try:
            name_of = F.array(*map(F.lit, names))[F.col("i")]
            one = stored.filter("j < 0").select(name_of.alias("feature"), F.col("xi").alias("x"), "y", "n")
            n_rows = stored.filter("j < 0 AND i = 0").agg(F.sum("n")).first()[0] or 0
            screening = screen_cells(one, self.features, self.target, c, n_rows, lambda some, _: one.filter(F.col("feature").isin(some)))
            short = list(screening.candidates)
            chosen = greedy.choose(self._matrices(stored.filter("j >= 0"), screening.mi, short), self.criterion, c.max_features, c.min_score, c.cmim_m, c.cmim_approx)
        finally:
            stored.unpersist()
        return SelectorModel([names[short[i]] for i in chosen.places], chosen.scores, screening.ranking(), self.criterion, n_rows, c.target, c.task)

    def _matrices(self, pairs: DataFrame, mi: np.ndarray, short: list[int]) -> greedy.Matrices:
        at, k = {f: i for i, f in enumerate(short)}, len(short)
        pair, cmi = np.zeros((k, k)), np.zeros((k, k))
        some = pairs.filter(F.col("i").isin(short) & F.col("j").isin(short))
        if k > 1 and self.criterion in ("mrmr", "mim"):
            for r in mi_of_cells(some.groupBy("i", "j", "xi", "xj").agg(F.sum("n").alias("n")), ["i", "j"], "xi", "xj").collect():
                i, j = at[r["i"]], at[r["j"]]
                pair[i, j] = pair[j, i] = r["mi"]
        elif k > 1:
            for r in cmi_of_cells(C.both_ways(some), ["i", "j"], "xi", "y", ["xj"]).collect():
                cmi[at[r["i"]], at[r["j"]]] = r["cmi"]
        return greedy.Matrices(mi[short], pair, cmi)
