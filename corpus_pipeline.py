"""The corpus pipeline: documents in, packed sequences of the documents worth training on out.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns the columns of documents (the last: pieces of
sequences). ``run`` writes each stage's result to the shared folder and reads it back for the next; what a stage staged
for itself, and its input, are deleted when its result is written.

Decisions are about rows. A stage that drops copies stages its input with a number for each row and judges by that, so
rows with a null id, and different texts under one id, have each a fate of their own. Of a group of equal or near-equal
texts exactly one row stays, whatever the ids: rows with an id come before those without, then the id decides, then a
digest of the row, then its number (between rows equal in all columns, it doesn't matter which stays).

For every stage: an empty table gives an empty one; columns beyond those of documents are left out; a null text counts
as empty and stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, jaccard_join, packing, pii, quality
from gleaner.llm.common import collected, documents, dropped, scratch, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Row numbers to be broadcast at most (8 bytes each).
BROADCAST_ROWS = 1_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number that no other row has, staged so that it stays."""
    return staged(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _one_each(docs: DataFrame, groups: DataFrame, largest: bool) -> DataFrame:
    """One row of ``docs`` for each group of ``groups`` (__row, group): that with the largest or smallest id."""
    names = docs.select("__row", "doc_id", F.xxhash64(*COLUMNS).alias("digest"))
    order = F.struct(F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull(), "doc_id", "digest", "__row")
    best = groups.join(names, "__row").groupBy("group").agg((F.max if largest else F.min)(order).alias("best"))
    stay = staged(best.select("best.__row"), "stay")
    gone = staged(docs.select("__row").join(stay, "__row", "left_anti"), "gone")
    # texts move only where neither list is short enough to be sent to them
    for rows, how in ((gone, "left_anti"), (stay, "left_semi")):
        if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return docs.join(F.broadcast(rows), "__row", how).select(*COLUMNS)
    return docs.join(stay, "__row", "left_semi").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learnt from the labels of their ids, scores 0.5 or more, each by its own text.

    A null or repeated id and a repeated row change nothing in a row's own score; without labels of both kinds all rows
    have one score, the share of label 1 (all stay where it is 0.5 or more, as without any label).
    """
    found = quality.with_score(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.filter("score >= 0.5").select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered; null as empty), one row: that with the largest id, one without an id only if none has any."""
    docs = _numbered(docs)
    found = exact_dedup.exact_dedup(docs, id_col="__row", keep="max")
    return _one_each(docs, found.select("__row", F.col("keep_id").alias("group")), largest=True)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, one row: that with the smallest id, one without an id only if none has any.

    Texts without words (null, empty, blanks) have no near duplicates and all stay.
    """
    docs = _numbered(docs)
    found = jaccard_join.near_duplicates(docs, id_col="__row")
    return _one_each(docs, found.select("__row", F.col("component_id").alias("group")), largest=False)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data replaced by its kind; n_chars is counted anew where the text's length changed."""
    masked = pii.redacted(docs.select(*COLUMNS).withColumn("__before", F.length("text")))
    n = F.when(F.length("text") == F.col("__before"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens; each row is a document of its own, whatever its id."""
    return packing.packed(docs)


def _after_others(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` on executors that have given back what the stages before it took."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _after_others(good_quality)),
    ("exact_dedup", _after_others(distinct_texts)),
    ("near_dedup", _after_others(without_near_duplicates)),
    ("pii", _after_others(without_pii)),
    ("packing", _after_others(packed)),
]

#: A learnt classifier and a tokenizer can't be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch() as keep:
            docs = staged(stage(spark, docs, sf_dir), name)
            keep(docs)
        if before is not None:
            dropped(before)
        before = docs
    return docs
