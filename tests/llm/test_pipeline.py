"""Each stage against brute force over all that its predecessor kept."""

import re
from pathlib import Path

import corpus_pipeline
from gleaner.llm import quality
from gleaner.llm.common import staged, work_folder

from .test_operators import components, kept, low


def test_stages(spark, odd_docs, tmp_path):
    docs = odd_docs.select(*corpus_pipeline.COLUMNS).filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k != 40)) for k in range(100)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = staged(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            after = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name == "quality":
            good = quality.classify(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).filter("predicted = 1").collect()
            want = [(n, t) for n, t in before if n in {r["doc_id"] for r in good}]
        elif name == "exact_dedup":
            want = [(n, t) for n, t in before if n == max(m for m, u in before if low(u) == low(t))]
        elif name == "near_dedup":
            want = [(n, t) for (n, t), (_, _, root) in zip(before, components(before), strict=True) if n == root]
        elif name == "pii":
            want = [(n, re.sub(r"1\.2\.3\.4", "[IP]", t).replace("a@b.co", "[EMAIL]") if t else t) for n, t in before]
        else:
            assert {r["doc_id"] for r in out.collect()} == {n for n, _ in before}
            return
        assert kept(after) == kept(want), name
        docs = out


def test_stages_on_null_and_repeated_ids(spark, odd_docs, tmp_path):
    junk, good = "$$ ## @@ " * 40, "A quiet sentence of common words follows another one. " * 12
    more = [(None, junk), (None, good), (None, good), (70, junk), (70, good + "More."), (71, good), (71, good.upper()), (71, good + "More."), (72, "only"), (72, "only")]
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    docs = docs.unionByName(spark.createDataFrame([(n, t, "en", "s", None) for n, t in more], docs.schema))
    labelled = [(1000 + k, junk + str(k) if k % 2 else good + str(k)) for k in range(80)]
    docs = staged(docs.unionByName(spark.createDataFrame([(n, t, "en", "s", None) for n, t in labelled], docs.schema)), "odd")
    spark.createDataFrame([(n, int(n % 2 == 0)) for n, _ in labelled], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    after = lambda name: [(r["doc_id"], r["text"]) for r in stages[name](spark, docs, str(tmp_path)).collect()]

    got = after("quality")
    assert (None, junk) not in got and (70, junk) not in got  # others under their ids stay
    assert (70, good + "More.") in got and got.count((None, good)) == 2

    got = after("exact_dedup")
    texts = {low(t) for _, t in rows}
    assert len(got) == len(texts) and {low(t) for _, t in got} == texts
    for n, t in got:
        assert (n, t) in rows and n == max((m for m, u in rows if low(u) == low(t) and m is not None), default=None)

    got = after("near_dedup")
    apart = [(k, t) for k, (_, t) in enumerate(rows)]  # components by row
    groups = {}
    for k, (_, _, root) in enumerate(components(apart)):
        groups.setdefault(root, []).append(k)
    want = [min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups.values()]
    assert kept(n for n, _ in got) == kept(want)
    assert all(row in rows for row in got)


def test_stages_on_an_empty_table_and_other_columns(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(k, k % 2) for k in range(0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
        plain, more = odd_docs.select(*corpus_pipeline.COLUMNS), odd_docs.withColumn("__row", odd_docs["doc_id"] * 0).withColumn("__pii", odd_docs["doc_id"])
        out = [stage(spark, d, str(tmp_path)) for d in (plain, more)]
        assert out[0].columns == out[1].columns and kept(map(tuple, out[0].collect())) == kept(map(tuple, out[1].collect())), name


def test_run_leaves_only_its_result(spark, odd_docs, tmp_path):
    odd_docs.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k != 40)) for k in range(100)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    staged(odd_docs.select("doc_id"), "first")  # from the second table on, all are in one folder
    folder = Path(work_folder(spark).removeprefix("file:")).parent
    there = lambda: {p.name for p in folder.glob("gleaner-*")}
    before = there()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 50 and len(there() - before) == 1


def test_each_stage_gives_back_the_heap_of_those_before(spark, no_docs, tmp_path):
    spark.createDataFrame([(k, k % 2) for k in range(0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    beans = spark._jvm.java.lang.management.ManagementFactory
    full = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if re.search("Old|MarkSweep", b.getName()))
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, no_docs, str(tmp_path))
        assert full() > before, name
