"""A sample of exactly so many rows that doesn't depend on how rows are laid out: those with the least keyed hashes.

The largest hash that belongs to the sample is found by digits: rows are counted by DIGIT bits of the hash at a time, among those that agree with it so
far, so a round moves 2 ** DIGIT counts at most and no rows. Rows below it are taken by a filter. Of the rows at it (equal rows, or a collision), kinds
are taken in the order of their columns; where not all rows of a kind are, its row is repeated as often as needed. So a row that makes up a third of the
table is counted before it moves, and no task orders more than different rows of one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of all columns and a seed."""
    return F.xxhash64(F.lit(seed), *[F.col(_q(c)) for c in df.columns])


def bottom_k(df: DataFrame, key: Column, k: int) -> DataFrame:
    """The ``k`` rows with the least keys (a long), ties in the order of the columns; all rows if there are no more.

    ``df`` is read up to 6 times, of which the counts need the key alone.
    """
    mark = "__key"
    while mark in df.columns:
        mark += "_"
    rows = df.withColumn(mark, key.cast("long"))
    if k <= 0:
        return df.limit(0)
    within, at, left = F.lit(True), 0, k
    for low in range(64 - DIGIT, -1, -DIGIT):
        d = F.shiftrightunsigned(F.col(mark), low).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
        d = d.bitwiseXOR(F.lit(1 << DIGIT - 1)) if low == 64 - DIGIT else d  # keys are signed
        counts = sorted((r["d"], r["n"]) for r in rows.filter(within).groupBy(d.alias("d")).agg(F.count("*").alias("n")).collect())
        for value, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return df
        at, within = at << DIGIT | value, within & (d == value)
    key_at = at - (1 << 63)  # the top bit was turned over
    below, here = rows.filter(F.col(mark) < key_at).drop(mark), rows.filter(F.col(mark) == key_at).drop(mark)
    if left == n:
        return below.unionByName(here)
    columns = [F.col(_q(c)) for c in df.columns]
    count, upto = mark + "n", mark + "s"
    kinds = here.groupBy(*columns).agg(F.count("*").alias(count))
    placed = kinds.withColumn(upto, F.sum(count).over(Window.orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)))
    taken = F.least(F.col(count), F.lit(left) - F.coalesce(F.col(upto), F.lit(0))).cast("int")
    repeated = placed.filter(taken > 0).withColumn(count, F.explode(F.array_repeat(F.lit(0), taken)))
    return below.unionByName(repeated.select(*columns))
