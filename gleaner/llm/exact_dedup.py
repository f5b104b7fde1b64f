"""Exact dedup: sorted runs of digests are merged in the rounds of a tree.

1. Each task digests its texts (A-Z lowered) and emits one row a document: a 64-bit key, the SHA-256, the document's
   id and the label of its run. These rows are written to the shared folder; texts are read once and never shuffled.
2. A task makes its rows sorted runs of RUN entries at most, one entry a text: key, SHA-256, the id that stays and the
   number of rows. Runs are merged in rounds of FAN_IN. In a round the run labels d0, d1, ... of one parent send their
   runs to it (a radix-FAN_IN binomial tree), cut into ranges of the key, so that a round has many small tasks whatever
   the number of runs. A run's range travels as one blob of sorted entries; a task lays the blobs of a parent and range
   end to end, merges them (a stable merge sort finds the runs and merges these) and keeps one entry a text. Equal keys
   count as equal texts only when their SHA-256 agree: every level verifies what it merges. A text that a third of all
   rows share is one entry a run from the first level on.
3. Each document's row is joined with its text's entry; texts with very many rows are joined apart (``attach_group``).

Edge cases: a null text counts as empty; empty texts are equal. A null id never stays while its group has another.
Rows that share id and text are one document: each is reported, with the same result. The identifiers are 64-bit
integers; the least (or, for ``keep="max"``, the largest) of a group stays. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import attach_group, documents, freed, partitions, staged

#: Run labels, and how many of them one parent merges in a round: two rounds for any number of partitions.
RUNS, FAN_IN = 256, 16
#: Entries of a run at most, and of a range of the key about.
RUN, RANGE = 1 << 18, 1 << 16

_ROW = "id long, key long, sha binary, run int"
_BLOB = "run int, part int, entries binary"
#: What an entry holds: 64-bit key, SHA-256, the id that stays, rows.
_ENTRY = np.dtype([("key", "<u8"), ("sha", "<u8", 4), ("best", "<i8"), ("n", "<i8")])


def normalised(text: pa.Array) -> pa.Array:
    """Null as empty, A-Z lowered, nothing else changed."""
    return pc.ascii_lower(pc.fill_null(text, ""))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = TaskContext.get().partitionId() % RUNS
    for b in batches:
        texts = normalised(b.column(1)).cast(pa.large_binary()).to_pylist()
        key = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts)).view(np.int64)
        sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(key), sha, pa.array(np.full(len(texts), run, np.int32))], ["id", "key", "sha", "run"])


def merge(entries: np.ndarray, sign: int) -> np.ndarray:
    """Runs of entries laid end to end as one run: ascending keys, one entry a text."""
    entries = entries[np.argsort(entries["key"], kind="stable")]
    same_key = entries["key"][1:] == entries["key"][:-1]
    same = same_key & (entries["sha"][1:] == entries["sha"][:-1]).all(axis=1)
    if (same_key & ~same).any():  # different texts with one key
        entries = entries[np.lexsort((*entries["sha"].T[::-1], entries["key"]))]
        same = (entries["key"][1:] == entries["key"][:-1]) & (entries["sha"][1:] == entries["sha"][:-1]).all(axis=1)
    at = np.flatnonzero(np.concatenate([[True], ~same])) if len(entries) else np.zeros(0, np.int64)
    out = entries[at]
    if len(at):
        out["best"] = (np.minimum if sign < 0 else np.maximum).reduceat(entries["best"], at)
        out["n"] = np.add.reduceat(entries["n"], at)
    return out


def _blobs(run: int, entries: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A run as one row a range of the key: its first ``bits`` bits."""
    cut = np.searchsorted(entries["key"], (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else [])
    pieces = [(i, x.tobytes()) for i, x in enumerate(np.split(entries, cut)) if len(x)]
    if pieces:
        yield pa.record_batch([pa.array([run] * len(pieces), pa.int32()), pa.array([i for i, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary())], ["run", "part", "entries"])


def _as_runs(batches: Iterator[pa.RecordBatch], sign: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Level 0: the rows of a task as sorted runs."""
    none, held, size, run = np.iinfo(np.int64).max * -sign, [], 0, TaskContext.get().partitionId() % RUNS
    for b in batches:
        new = np.zeros(b.num_rows, _ENTRY)
        new["best"] = b.column(0).fill_null(none).to_numpy(zero_copy_only=False)
        new["key"] = b.column(1).to_numpy().view(np.uint64)
        new["sha"] = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8").reshape(-1, 4)
        new["n"] = 1
        held.append(new)
        size += len(new)
        if size >= RUN:
            yield from _blobs(run, merge(np.concatenate(held), sign), bits)
            held, size = [], 0
    if size:
        yield from _blobs(run, merge(np.concatenate(held), sign), bits)


def _merged(batches: Iterator[pa.RecordBatch], sign: int) -> Iterator[pa.RecordBatch]:
    """Merges the blobs of each run and range, from rows sorted by these."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        entries = merge(np.concatenate([np.frombuffer(x, _ENTRY) for x in held]), sign)
        return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([entries.tobytes()], pa.binary())], ["run", "part", "entries"])

    for b in batches:
        for run, part, entries in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (run, part) and held:
                yield out()
                held = []
            now = (run, part)
            held.append(entries)
    if held:
        yield out()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root run's entries as rows."""
    for b in batches:
        for data in b.column(2):
            x = np.frombuffer(data.as_py(), _ENTRY)
            sha = np.ascontiguousarray(x["sha"]).tobytes()
            shas = pa.array([sha[i : i + 32] for i in range(0, len(sha), 32)], pa.binary())
            yield pa.record_batch([pa.array(x["key"].view(np.int64)), shas, pa.array(x["best"]), pa.array(x["n"])], ["key", "sha", "best", "n"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One staged row a document: id, key, sha, run."""
    return staged(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(freed(_digests), _ROW), "digests")


def merged(rows: DataFrame, keep: str = "min") -> DataFrame:
    """The root run: one entry (key, sha, best, n) for each text of ``digests``."""
    sign = {"min": -1, "max": 1}[keep]
    bits = min(16, max(0, rows.count() // RANGE).bit_length())
    runs = rows.mapInArrow(freed(lambda it: _as_runs(it, sign, bits)), _BLOB)
    left = RUNS
    while left > 1:
        left = -(-left // FAN_IN)
        sent = runs.withColumn("run", F.expr(f"run div {FAN_IN}").cast("int"))
        sent = sent.repartition(partitions(rows.sparkSession), "run", "part").sortWithinPartitions("run", "part")
        if left > 1:
            runs = sent.mapInArrow(freed(lambda it: _merged(it, sign)), _BLOB)
    none = (2**63 - 1) * -sign
    found = sent.mapInArrow(freed(lambda it: _listed(_merged(it, sign))), "key long, sha binary, best long, n long")
    return staged(found.select("key", "sha", F.when(F.col("best") != none, F.col("best")).alias("best"), "n"), "merged")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col)
    found = attach_group(rows.select("id", "key", "sha"), merged(rows, keep), ["key", "sha"], "n")
    return found.select(
        F.col("id").alias(id_col),
        F.col("best").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
