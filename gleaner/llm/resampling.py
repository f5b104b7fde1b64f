"""Target-distribution importance resampling: the documents whose words look most like a target's, drawn without replacement.

1. Features are all runs of 1 to ``longest`` consecutive words (A-Z lowered; words are stretches of 0-9, a-z and all beyond
   ASCII), joined by one space, repeats counted. A feature's bucket is the crc32 of its bytes modulo ``buckets``. Each task sums
   its documents' buckets in one array; the arrays are added by Spark, and ``buckets`` sums (not documents) reach the driver.
2. A bucket's gain is 1000 ln of its chance in the target over that among all documents, both smoothed by 1, rounded down. A
   document's weight is the sum of the gains of its features: the gains are one array, read by whole arrays of buckets.
3. A document's score is its weight and a Gumbel variable drawn from a keyed hash of its id. The highest scores are a draw without
   replacement by exp(weight / 1000).
4. The k-th key (highest score, then ids, nulls last, then the row's place) is found by radix selection: rows are counted by one digit of
   DIGIT bits at a time, among those that agree with the k-th key so far; a round moves 2 ** DIGIT counts at most, and it ends early where a
   digit's rows are all drawn. Only rows up to the key are sorted by ranges and ranked; the others get a null rank.

Edge cases: a null text has no words and weight 0. Rows with one id and one text are ranked one after the other. A null id is drawn by the
hash of "seed:null". Without documents, or without any that has ``least_words`` words, nothing is drawn. Null texts of the target add nothing.
The result has the columns named below only; further columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, freed, partitions, staged
from gleaner.llm.words import bounds, sliced, split, translated, whole

BUCKETS, SEED, LEAST_WORDS = 10_000, 2024, 20
DIGIT = 16

_TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def _featured(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; bucket of each feature, and its text."""
    count, words = split(translated(whole(texts), _TABLE))
    owner = np.repeat(np.arange(len(count)), count)
    crc, different, kind = _crcs(words)
    found, owners = [crc[kind] % buckets], [owner]
    for n in range(2, longest + 1):
        # different runs are read once
        at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
        runs, back = np.unique(np.stack([kind[at + k] for k in range(n)], 1), axis=0, return_inverse=True) if len(at) else (np.zeros((0, n), np.int64), at)
        value = np.fromiter((zlib.crc32(b" ".join([different[i] for i in run])) for run in runs.tolist()), np.int64, len(runs))
        found.append(value[back.ravel()] % buckets)
        owners.append(owner[at])
    return count, np.concatenate(found), np.concatenate(owners)


def _crcs(words: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(crc32 of each different word, these words, number of each word among them)."""
    if not len(words):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    kinds = words.dictionary_encode()
    offsets, data = bounds(kinds.dictionary)
    raw, at = data.tobytes(), offsets.tolist()
    different = [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    return np.fromiter(map(zlib.crc32, different), np.int64, len(different)), different, kinds.indices.to_numpy().astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of all texts of a task."""
    total = np.zeros(buckets, np.int64)
    for b in (x for one in batches for x in sliced(one, 0)):
        total += np.bincount(_featured(b.column(0), longest, buckets)[1], minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = rows.mapInArrow(freed(lambda it: _summed(it, longest, buckets)), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, all_of: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (t + 1) (S + buckets) / ((s + 1) (T + buckets))) by bucket."""
    t_all, s_all, n = int(target.sum()), int(all_of.sum()), len(target)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for t, s in zip(target.tolist(), all_of.tolist(), strict=True)], np.int64)


def noise(name: int | None, seed: int) -> int:
    """1000 times a Gumbel variable by the id's keyed hash, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'null' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(batches: Iterator[pa.RecordBatch], gain: np.ndarray, longest: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in (x for one in batches for x in sliced(one, 1)):
        words, bucket, owner = _featured(b.column(1), longest, len(gain))
        n = np.bincount(owner, minlength=b.num_rows)
        # sums of integers: exact, as no weight reaches 2 ** 53
        weight = np.bincount(owner, gain[bucket], b.num_rows).astype(np.int64)
        score = weight + np.array([noise(i, seed) for i in b.column(0).to_pylist()], np.int64)
        yield pa.record_batch([b.column(0), *map(pa.array, (n.astype(np.int64), words.astype(np.int64), weight, score))], ["id", "n_features", "n_words", "weight", "score"])


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One staged row a document: id, n_features, n_words, weight, score, place (a number of its own)."""
    gain = gains(bucket_counts(target, text_col, longest, buckets), bucket_counts(docs, text_col, longest, buckets))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(freed(lambda it: _scored(it, gain, longest, seed)), "id long, n_features long, n_words long, weight long, score long")
    return staged(found.withColumn("place", F.monotonically_increasing_id()), "scores")


#: The composite key's parts: ascending, so that the best row comes first.
_KEY = ("-score - 1", "CASE WHEN id IS NULL THEN 1 ELSE 0 END", "coalesce(id, 0)", "place")


def _digits(rows: DataFrame) -> list[str]:
    """The key's digits as SQL, from the highest on, without those before the first in which a part's least and largest value differ.

    A signed part has its top bit turned over, so that digits are in the order of the values.
    """
    ends = rows.agg(*[f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(len(_KEY)) for f in (F.min, F.max)]).first()
    out = []
    for i in range(len(_KEY)):
        low, high = ends[2 * i], ends[2 * i + 1]
        bits = 0 if low is None else ((low ^ high) & (1 << 64) - 1).bit_length()
        for at in range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT):
            digit = f"shiftrightunsigned(k{i}, {at}) & {(1 << DIGIT) - 1}"
            out.append(f"({digit}) ^ {1 << DIGIT - 1}" if at == 64 - DIGIT else digit)
    return out


def kth_key(rows: DataFrame, k: int) -> Column:
    """Which rows (with the parts k0 to k3 of ``_KEY``) are among the ``k`` least: True for exactly k of them, if there are so many.

    Rounds count one digit of the rows whose digits so far are those of the k-th row.
    """
    within, under = F.lit(True), F.lit(False)
    if k <= 0:
        return under
    for digit in _digits(rows):
        d = F.expr(digit).cast("int")
        counts = sorted((r["d"], r["n"]) for r in rows.filter(within).groupBy(d.alias("d")).agg(F.count("*").alias("n")).collect())
        for value, n in counts:
            if k <= n:
                break
            k -= n
        else:
            return under | within  # fewer rows than asked for
        under, within = under | within & (d < value), within & (d == value)
        if k == n:
            return under | within
    return under | within


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``rank``: 1 to k in the order of the key, null for all others. ``rows`` should be staged."""
    keyed = rows.select("*", *[F.expr(e).cast("long").alias(f"k{i}") for i, e in enumerate(_KEY)])
    drawn = kth_key(keyed, k)
    order = [f"k{i}" for i in range(4)]
    ranged = keyed.filter(drawn).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    at = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a task
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    first = rows.sparkSession.createDataFrame(before, "part long, before long")
    mine = at.join(F.broadcast(first), part == F.col("part")).withColumn("rank", F.col("before") + F.col("at") % (1 << 33) + 1)
    return mine.select(*rows.columns, "rank").unionByName(keyed.filter(~drawn).select(*rows.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row a document: id, n_features, n_words, weight, score, rank (null: not drawn).

    Of the N documents with at least ``least_words`` words, floor(percent N / 100) are drawn.
    """
    rows = scored(docs, target, id_col, text_col, longest, buckets, seed)
    able = F.col("n_words") >= least_words
    drawn = ranked(rows.filter(able), rows.filter(able).count() * percent // 100)
    found = drawn.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return found.select(F.col("id").alias(id_col), "n_features", "n_words", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")
