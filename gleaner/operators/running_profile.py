"""A profile that grows with its input: parts are profiled once, and parts' profiles add up.

A part (a day's files, say) leaves, as files under its name: of each numeric column a KLL sketch with the number of values, the least and the largest; of each
categorical column its values with their numbers of rows. ``codings`` merges what is stored; no row is read again. A part that
comes again replaces what it left before.

Least, largest, numbers of rows and categories are those of all parts together. Quantiles come from merged sketches, which keep the error of one:
with a chance of 99 % the rank of a quantile is off by at most ``rank_error`` of all values, whatever the number of parts (merging doesn't add to it).
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import SelectorConfig
from gleaner.operators import profile as P

#: Size of sketches: about three times as many bytes times 8.
SKETCH = 8192


def rank_error(sketch: int = SKETCH) -> float:
    """Error of a rank as a share of all values, with a chance of 99 %; constants as published for this kind of sketch."""
    return 2.296 / sketch**0.9021


class StoredProfile:
    """Profiles of the parts of a table, in files below ``folder`` (on storage that the driver and all executors share)."""

    def __init__(self, spark: SparkSession, folder: str, kinds: dict[str, str], config: SelectorConfig, task: str, sketch: int = SKETCH):
        """``kinds`` as of ``profile.kinds_of``; ``task`` as of ``profile.task_of``, but not "auto"."""
        self.spark, self.folder, self.kinds, self.config, self.task, self.sketch = spark, folder.rstrip("/"), kinds, config, task, sketch
        self.numbers = list(P.bins_of(kinds, config, task, 0))
        self.words = P.words_of(kinds, config, task)

    def add(self, df: DataFrame, part: str) -> None:
        """Profiles a part; one of the same name is replaced."""
        wanted = [F.count("*").alias("rows")]
        for i, n in enumerate(self.numbers):
            x = P.as_number(df, n)
            wanted.append(F.struct(F.lit(n).alias("feature"), F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.kll_sketch_agg_double(x, self.sketch).alias("sketch")).alias(f"s{i}"))
        none = F.lit(None).cast("struct<feature: string, n: bigint, lo: double, hi: double, sketch: binary>")
        one = df.agg(*wanted).select("rows", F.explode(F.array(*[F.col(f"s{i}") for i in range(len(self.numbers))]) if self.numbers else F.array(none)).alias("s")).select("rows", "s.*")
        one.write.mode("overwrite").parquet(f"{self.folder}/numbers/part={quote(part, safe='')}")
        if self.words:
            texts = df.select(*[P.as_text(df, n).alias(f"f{i}") for i, n in enumerate(self.words)])
            long = texts.unpivot([], texts.columns, "i", "value").filter("value is not null")
            long.groupBy("i", "value").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/values/part={quote(part, safe='')}")

    def rows(self) -> int:
        found = self.spark.read.parquet(f"{self.folder}/numbers").groupBy("part").agg(F.max("rows").alias("rows"))
        return found.agg(F.sum("rows")).first()[0] or 0

    def stats(self, bins: dict[str, int]) -> dict[str, tuple]:
        """(least, largest, inner quantiles) of each numeric column."""
        if not bins:
            return {}
        merged = self.spark.read.parquet(f"{self.folder}/numbers").groupBy("feature").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch")), self.sketch).alias("sketch"))
        each = []  # the ranks must be literals: one expression for each number of bins, of which there are two at most
        for count in sorted(set(bins.values())):
            mine = F.col("feature").isin([n for n, b in bins.items() if b == count]) & (F.col("n") > 0)
            each.append(F.when(mine, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / count) for k in range(1, count)]))))
        some = merged.withColumn("q", F.coalesce(*each))
        found = {r["feature"]: (r["lo"], r["hi"], list(r["q"] or [])) for r in some.select("feature", "lo", "hi", "q").collect()}
        return {n: found.get(n, (None, None, [])) for n in bins}

    def values(self) -> dict[str, list[str]]:
        """The first values of each categorical column by falling number of rows, then value; of a class target, all."""
        out: dict[str, list[str]] = {n: [] for n in self.words}
        if not self.words:
            return out
        counts = self.spark.read.parquet(f"{self.folder}/values").groupBy("i", "value").agg(F.sum("n").alias("n"))
        place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "value"))
        target = f"f{self.words.index(self.config.target)}" if self.config.target in self.words else ""
        first = counts.filter(F.col("i") != target).withColumn("place", place).filter(F.col("place") <= self.config.max_categories + 1).drop("place")
        found = [*first.collect(), *counts.filter(F.col("i") == target).collect()]
        for r in sorted(found, key=lambda r: (-r["n"], r["value"])):
            out[self.words[int(r["i"][1:])]].append(r["value"])
        return out

    def codings(self) -> tuple[list[P.Coding], P.Coding, int]:
        """As ``profile.codings`` of all parts together."""
        rows = self.rows()
        bins = P.bins_of(self.kinds, self.config, self.task, rows)
        return *P.codings_of(self.stats(bins), self.values(), bins, self.kinds, self.config, self.task), rows
