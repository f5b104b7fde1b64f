import os

import pytest
from pyspark.sql import functions as F

from gleaner import InfoSelector, SelectorConfig
from gleaner.operators import profile as P
from gleaner.streaming.counts import StoredCounts


@pytest.fixture(scope="module")
def table(spark):
    bit = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3)).cast("int")
    df = spark.range(4000).select("id", bit(1).alias("a"), bit(2).alias("b"), F.when(F.col("id") % 17 > 0, bit(3)).alias("c"))
    return df.select("id", "a", "b", "c", F.col("a").alias("d"), (((F.col("a") > 0) & (F.col("b") > 0)) != (F.col("id") % 11 == 0)).cast("int").alias("y")).cache()


def counts_of(spark, df, folder, criterion="jmim", **more):
    config = SelectorConfig(target="y", **more)
    features, target, _ = P.codings(df.drop("id"), P.kinds_of(df.drop("id"), config), config, "classifier_multiclass")
    return StoredCounts(spark, str(folder), features, target, criterion, **more)


@pytest.mark.parametrize(("criterion", "more"), [("jmim", {}), ("mrmr", {"missing": "drop"}), ("cmim", {"cmim_approx": "max_min", "significance": "permutation", "n_permutations": 30})])
def test_selection_of_a_stream_equals_that_of_the_table(spark, table, tmp_path, criterion, more):
    """Three files, a batch each; the second batch fails after it wrote, and comes again."""
    for k in range(3):
        table.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = counts_of(spark, table, tmp_path / "cells", criterion, max_features=3, **more)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    real, fails = counts.add, [1]

    def flaky(rows, batch):
        real(rows, batch)
        if batch in fails:
            fails.remove(batch)
            raise RuntimeError("lost after writing")

    counts.add = flaky
    with pytest.raises(Exception, match="lost after writing"):
        counts.start(stream, str(tmp_path / "progress"), availableNow=True).awaitTermination()
    counts.start(stream, str(tmp_path / "progress"), availableNow=True).awaitTermination()
    assert counts.parts() == [(0, 0), (1, 1), (2, 2)]
    whole = InfoSelector(criterion, target="y", exclude=("id",), max_features=3, **more).fit(table)
    for _ in range(2):
        got = counts.model()
        assert got.n_rows == whole.n_rows and got.selected_features == whole.selected_features and "b" in got.selected_features
        assert got.scores_ == pytest.approx(whole.scores_, abs=1e-12)
        counts.compact()
        assert counts.parts() == [(0, 2)]


def test_unfinished_and_contained_parts_do_not_count(spark, table, tmp_path):
    counts = counts_of(spark, table, tmp_path / "cells")
    assert counts.parts() == [] and counts.cells().count() == 0 and counts.model().selected_features == []
    counts.compact()
    for k in range(3):
        counts.add(table.filter(F.col("id") % 3 == k), k)
    before = sorted(map(tuple, counts.cells().collect()), key=repr)
    counts.cells().write.parquet(str(tmp_path / "cells" / "0-2"))  # added up, but the parts are still there
    os.makedirs(tmp_path / "cells" / "3-3")  # begun, not ended
    assert counts.parts() == [(0, 2)] and sorted(map(tuple, counts.cells().collect()), key=repr) == before
    counts.add(table.filter(F.col("id") % 3 == 1), 1)  # comes again after it was added up
    assert sorted(map(tuple, counts.cells().collect()), key=repr) == before
    counts.compact()
    assert sorted(os.listdir(tmp_path / "cells")) == ["0-2"]


def test_what_pairs_cannot_tell_is_refused(spark, table, tmp_path):
    for criterion in ("cmim", "other"):
        with pytest.raises(ValueError):
            counts_of(spark, table, tmp_path, criterion)
