"""Stage 0: what each column is, and its codes.

One aggregate gives all numeric columns' ranges and quantiles, one grouped count all categories; a single projection
then turns every column into small integers.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.config import SelectorConfig
from gleaner.operators.categories import top_values
from gleaner.operators.sampling import bottom_k, row_hash

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGERS = NUMBERS[:4]
CATEGORIES = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: An integer target with at most this many values is a class label.
FEW_CLASSES = 20
#: Accuracy of approximate quantiles (relative error of the rank: one over it).
ACCURACY = 10_000
#: Bits of a number's key that the first round of exact quantiles counts, and each later one; rows that a task holds before it counts them.
FIRST_DIGIT, DIGIT = 14, 10
_HELD = 1 << 17


@dataclass
class Coding:
    """How a column becomes codes 0 .. n_codes - 1."""

    name: str
    kind: str
    edges: tuple[float, ...] = ()
    codes: dict[str, int] = field(default_factory=dict)
    n_codes: int = 1
    missing_code: int | None = None
    other_code: int | None = None


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kinds_of(df: DataFrame, config: SelectorConfig) -> dict[str, str]:
    """'numeric' or 'categorical' of every candidate column, in the order of the columns."""
    found = {}
    for f in df.schema.fields:
        if f.name == config.target or f.name in config.exclude:
            continue
        if f.name in (config.numeric_features or ()):
            found[f.name] = "numeric"
        elif f.name in (config.categorical_features or ()):
            found[f.name] = "categorical"
        elif isinstance(f.dataType, NUMBERS):
            found[f.name] = "numeric"
        elif isinstance(f.dataType, CATEGORIES):
            found[f.name] = "categorical"
        else:
            raise TypeError(f"column {f.name} has the type {f.dataType.simpleString()}, which can't be a feature")
    return found


def distinct_values(df: DataFrame, column: str) -> int:
    """Number of distinct values; a null counts as one."""
    c = _col(column)
    return df.agg((F.count_distinct(c) + F.max(c.isNull().cast("int"))).alias("n")).first()[0] or 0


def task_of(df: DataFrame, target: str, declared: str = "auto") -> str:
    kind = df.schema[target].dataType
    if declared == "auto":
        if isinstance(kind, CATEGORIES):
            return "classifier_multiclass"
        if isinstance(kind, INTEGERS):
            return "classifier_multiclass" if distinct_values(df, target) <= FEW_CLASSES else "continuous"
        if isinstance(kind, NUMBERS):
            return "continuous"
        raise ValueError(f"no task fits the target {target} of type {kind.simpleString()}")
    if not isinstance(kind, NUMBERS + CATEGORIES):
        raise TypeError(f"the target {target} has the type {kind.simpleString()}")
    if declared == "continuous":
        if not isinstance(kind, NUMBERS):
            raise ValueError(f"a continuous target must be a number; {target} is {kind.simpleString()}")
        return declared
    n = distinct_values(df, target)
    if declared == "classifier_binary" and n != 2:
        raise ValueError(f"classifier_binary needs 2 values of {target}, not {n}")
    if declared == "classifier_multiclass" and n < 2:
        raise ValueError(f"classifier_multiclass needs 2 values of {target} at least, not {n}")
    return declared


def bins_for(n_rows: int, bins: int | str) -> int:
    return max(4, min(20, round(math.log2(max(n_rows, 1))))) if bins == "auto" else int(bins)


def cut_points(low: float | None, high: float | None, quantiles: list[float], bins: int) -> tuple[float, ...]:
    """Edges between bins: the inner quantiles, or, if these leave no more values than bins, the middles between values."""
    if low is None:
        return ()
    marks = sorted({low, high, *quantiles})
    if len(marks) < 2:
        return ()
    if len(marks) <= bins:
        return tuple((a + b) / 2 for a, b in zip(marks[:-1], marks[1:], strict=True))
    return tuple(sorted(set(quantiles)))


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a double; what is no number, and NaN, is null."""
    x = _col(name).try_cast("double") if isinstance(df.schema[name].dataType, T.StringType) else _col(name).cast("double")
    return F.when(~F.isnan(x), x)


def as_text(df: DataFrame, name: str) -> Column:
    """The text by which a value is a category; parts of a second are dropped."""
    kind = df.schema[name].dataType
    return F.date_format(_col(name), "yyyy-MM-dd HH:mm:ss") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else _col(name).cast("string")


def number_stats(df: DataFrame, bins: dict[str, int], exact: bool = False) -> tuple[dict[str, tuple], int]:
    """(least, largest, inner quantiles) of each column, and the number of rows, by one aggregate."""
    wanted = [F.count("*").alias("rows")]
    for i, (name, b) in enumerate(bins.items()):
        x, levels = as_number(df, name), [k / b for k in range(1, b)]
        q = F.lit(None).cast("array<double>") if exact else F.percentile_approx(x, levels, ACCURACY)
        wanted.append(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), q.alias("q")).alias(f"s{i}"))
    row = df.agg(*wanted).first()
    quantiles = exact_quantiles(df, bins) if exact else {n: list(row[i + 1]["q"] or []) for i, n in enumerate(bins)}
    return {n: (row[i + 1]["lo"], row[i + 1]["hi"], quantiles[n]) for i, n in enumerate(bins)}, row["rows"]


def side_by_side(columns: list[Column], kind: str) -> Column:
    """Numbers of a row as one array. To the tasks of ``mapInArrow``, many columns cost much more: Spark sums up the buffers of every column for each row."""
    return F.array(*columns).cast(f"array<{kind}>")


def numbers_of(column: pa.Array, width: int) -> np.ndarray:
    """The numbers of ``side_by_side``, a row each; null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ordered(values: np.ndarray) -> np.ndarray:
    """The numbers that are there as unsigned 64-bit keys in the same order."""
    bits = (values[~np.isnan(values)] + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def _number(key: int) -> float:
    """The number of a key."""
    u = key ^ (1 << 63)
    return struct.unpack("<d", (u if u < 1 << 63 else u ^ ((1 << 63) - 1)).to_bytes(8, "little"))[0]


class _Digits:
    """How many of a column's keys that begin with one of some prefixes go on with each digit, and the only key there if there is one."""

    def __init__(self, prefixes: list[int], taken: int, bits: int):
        self.prefixes, self.taken, self.bits = np.array(prefixes, np.uint64), taken, bits
        size = max(1, len(prefixes)) << bits
        self.n, self.key, self.several = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, bool)

    def add(self, keys: np.ndarray) -> None:
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        count, keys = np.diff(first, append=len(keys)), keys[first]
        digit = keys >> np.uint64(64 - self.taken - self.bits)
        if self.taken:
            rest = 64 - self.taken
            start = np.searchsorted(keys, self.prefixes << np.uint64(rest))
            size = np.searchsorted(keys, (self.prefixes << np.uint64(rest)) | np.uint64((1 << rest) - 1), side="right") - start
            at = np.repeat(np.arange(len(size)), size)
            here = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + start[at]
            keys, count, digit = keys[here], count[here], (digit[here] & np.uint64((1 << self.bits) - 1)) + (at << self.bits).astype(np.uint64)
        digit = digit.astype(np.int64)
        fresh = self.n[digit] == 0
        self.key[digit[fresh]] = keys[fresh]
        self.several[digit[keys != self.key[digit]]] = True
        self.n += np.bincount(digit, count, len(self.n)).astype(np.int64)


def _digits(batches: Iterator[pa.RecordBatch], prefixes: list[list[int]], taken: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(f, at, n, low, high) of a task: ``at`` numbers prefixes and digits; low and high are equal where only one key occurs."""
    found = {f: _Digits(some, taken, bits) for f, some in enumerate(prefixes) if some or not taken}
    held: list[np.ndarray] = []
    rows = 0

    def take() -> None:
        for i, d in enumerate(found.values()):
            d.add(np.concatenate([_ordered(x[:, i]) for x in held]))
        held.clear()

    for b in batches:
        held.append(numbers_of(b.column(0), len(found)))
        rows += b.num_rows
        if rows >= _HELD:
            take()
            rows = 0
    if held:
        take()
    for f, d in found.items():
        at = np.flatnonzero(d.n)
        key = (d.key[at] ^ np.uint64(1 << 63)).view(np.int64)
        low, high = (np.where(d.several[at], end, key) for end in (np.iinfo(np.int64).min, np.iinfo(np.int64).max))
        yield pa.record_batch([pa.array(np.full(len(at), f, np.int32)), pa.array(at), pa.array(d.n[at]), pa.array(low), pa.array(high)], ["f", "at", "n", "low", "high"])


def exact_quantiles(df: DataFrame, bins: dict[str, int]) -> dict[str, list[float]]:
    """Quantiles k / bins of each column, between two values if need be.

    The values at the wanted ranks are found by their digits (FIRST_DIGIT, then DIGIT bits of a key in the numbers' order): a round counts the next
    digit of the keys that begin as a wanted one does, in arrays. A value is known when only one key begins like it, so few rounds are needed; six
    at most. No values are shuffled, and what moves is bounded by tasks and columns, not by rows or different values.
    """
    names = list(bins)
    if not names:
        return {}
    wide = [as_number(df, n) for n in names]
    #: by column: {rank: (prefix, rank among the keys with that prefix)} of what is wanted, and the keys found
    open_ranks: list[dict[int, tuple[int, int]]] = [{} for _ in names]
    ranks: list[list[float]] = [[] for _ in names]
    found: list[dict[int, int]] = [{} for _ in names]
    taken, bits = 0, FIRST_DIGIT
    while taken < 64 and (not taken or any(open_ranks)):
        prefixes = [sorted({p for p, _ in some.values()}) for some in open_ranks]
        asked = [x for x, some in zip(wide, prefixes, strict=True) if some or not taken]
        parts = df.select(side_by_side(asked, "double").alias("x")).mapInArrow(lambda it, p=prefixes, t=taken, b=bits: _digits(it, p, t, b), "f int, at long, n long, low long, high long")
        sums = parts.groupBy("f", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        f, at, n, low, high = (c.to_numpy() for c in sums.columns)
        for i, b in enumerate(bins.values()):
            mine = np.flatnonzero(f == i)
            mine = mine[np.argsort(at[mine])]
            upto, place = np.cumsum(n[mine]), at[mine]
            if not taken and len(mine):
                ranks[i] = [(int(upto[-1]) - 1) * k / b for k in range(1, b)]
                open_ranks[i] = {r: (0, r) for x in ranks[i] for r in (int(x), math.ceil(x))}
            after = {}
            for r, (prefix, inside) in open_ranks[i].items():
                first = (prefixes[i].index(prefix) if taken else 0) << bits
                before = int(n[mine[: np.searchsorted(place, first)]].sum())
                k = int(np.searchsorted(upto, before + inside, side="right"))
                if low[mine[k]] == high[mine[k]]:
                    found[i][r] = int(low[mine[k]]) + (1 << 63)
                else:
                    after[r] = (prefix << bits | int(place[k]) - first, before + inside - int(upto[k] - n[mine[k]]))
            open_ranks[i] = after
        taken, bits = taken + bits, DIGIT

    def between(i: int, x: float) -> float:
        lo, hi = _number(found[i][int(x)]), _number(found[i][math.ceil(x)])
        return lo if lo == hi or x == int(x) else lo + (hi - lo) * (x - int(x))

    return {name: [between(i, x) for x in ranks[i]] for i, name in enumerate(names)}


def category_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, value, n, place): values by falling count, then value. One pass over all columns."""
    texts = df.select(*[as_text(df, n).alias(n) for n in names])
    long = texts.unpivot([], [_col(n) for n in names], "feature", "value").filter("value is not null")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value")))


def bins_of(kinds: dict[str, str], config: SelectorConfig, task: str, n_rows: int) -> dict[str, int]:
    """Bins of each numeric column, the target's among them if it is continuous. ``n_rows`` counts where bins are "auto"."""
    bins = {n: bins_for(n_rows, config.bins) for n, k in kinds.items() if k == "numeric"}
    return bins | ({config.target: config.bins_target} if task == "continuous" else {})


def words_of(kinds: dict[str, str], config: SelectorConfig, task: str) -> list[str]:
    """The categorical columns, the target last if it is a class."""
    return [n for n, k in kinds.items() if k == "categorical"] + ([] if task == "continuous" else [config.target])


def codings(df: DataFrame, kinds: dict[str, str], config: SelectorConfig, task: str, exact: bool = False) -> tuple[list[Coding], Coding, int]:
    """Codings of the features and the target, and the number of rows."""
    bins = bins_of(kinds, config, task, df.count() if config.bins == "auto" else 0)
    stats, n_rows = number_stats(df, bins, exact or config.exact_quantiles)
    words = words_of(kinds, config, task)
    values: dict[str, list[str]] = {n: [] for n in words}
    if words:
        texts = df.select(*[as_text(df, n).alias(n) for n in words])
        # of the target, all values are classes; of a feature, only the most frequent are told apart
        found = top_values(texts.select(*[_col(n) for n in words if n != config.target]), config.max_categories + 1)
        values |= {n: [v for v, _ in some] for n, some in found.items()}
        if config.target in words:
            counts = texts.groupBy(_col(config.target).alias("value")).agg(F.count("*").alias("n")).filter("value is not null")
            values[config.target] = [r["value"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["value"]))]
    return *codings_of(stats, values, bins, kinds, config, task), n_rows


def codings_of(stats: dict[str, tuple], values: dict[str, list[str]], bins: dict[str, int], kinds: dict[str, str], config: SelectorConfig, task: str) -> tuple[list[Coding], Coding]:
    """Codings by (least, largest, inner quantiles) of numbers and by the first values of categories (of the target, all)."""
    keep_missing = config.missing == "category"

    def coding(name: str, kind: str) -> Coding:
        c = Coding(name, kind)
        if kind == "numeric":
            lo, hi, q = stats[name]
            c.edges = cut_points(lo, hi, q, bins[name])
            c.n_codes = len(c.edges) + 1
        else:
            kept = values[name] if name == config.target else values[name][: config.max_categories]
            c.codes = {v: i for i, v in enumerate(kept)}
            c.n_codes = len(kept)
            if len(values[name]) > len(kept):
                c.other_code, c.n_codes = len(kept), len(kept) + 1
        if keep_missing:
            c.missing_code, c.n_codes = c.n_codes, c.n_codes + 1
        c.n_codes = max(c.n_codes, 1)
        return c

    return [coding(n, k) for n, k in kinds.items()], coding(config.target, "numeric" if task == "continuous" else "categorical")


def code_of(df: DataFrame, c: Coding) -> Column:
    """The code of a column; null where a value is missing and missing values have no code. For many columns, see ``coded``."""
    missing = F.lit(c.missing_code).cast("int")
    if c.kind == "numeric":
        x = as_number(df, c.name)
        code = F.lit(0)
        for e in c.edges:
            code = code + (x >= F.lit(e)).cast("int")
        return F.when(x.isNotNull(), code).otherwise(missing).cast("int")
    x = as_text(df, c.name)
    rest = F.lit(c.other_code if c.other_code is not None else 0)
    known = F.create_map(*[F.lit(v) for kv in c.codes.items() for v in kv]) if c.codes else None
    code = F.coalesce(F.try_element_at(known, x), rest) if known is not None else rest
    return F.when(x.isNotNull(), code).otherwise(missing).cast("int")


def _codes(batches: Iterator[pa.RecordBatch], codings: list[Coding], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows of the numbers side by side, the texts, and further columns."""
    numeric = [c.kind == "numeric" for c in codings]
    place = np.where(numeric, np.cumsum(numeric), np.cumsum(~np.array(numeric))) - 1
    known = [pa.array(list(c.codes), pa.string()) for c in codings]
    given = [pa.array(np.array(list(c.codes.values()), np.int32)) for c in codings]
    edges = [np.array(sorted(e for e in c.edges if e == e)) for c in codings]
    for b in batches:
        out = []
        numbers = numbers_of(b.column(0), sum(numeric)) if any(numeric) else None
        for c, at, texts, codes, cuts in zip(codings, place, known, given, edges, strict=True):
            if c.kind == "numeric":
                x = numbers[:, at]
                code = pa.array(np.searchsorted(cuts, x, side="right").astype(np.int32), mask=np.isnan(x))
            else:
                column = b.column(int(at) + any(numeric))
                rest = pa.scalar(c.other_code if c.other_code is not None else 0, pa.int32())
                code = pc.fill_null(codes.take(pc.index_in(column, texts)), rest)
                code = pc.if_else(column.is_valid(), code, pa.scalar(None, pa.int32()))
            out.append(code if c.missing_code is None else pc.fill_null(code, pa.scalar(c.missing_code, pa.int32())))
        yield pa.RecordBatch.from_arrays([*out, *b.columns[any(numeric) + numeric.count(False) :]], names=names)


def coded(df: DataFrame, codings: list[Coding], more: tuple[str, ...] = ()) -> DataFrame:
    """The codes of columns, as ``code_of``, and further columns as they are.

    Codes are looked up in arrays: as expressions, hundreds of comparisons make code that the JVM doesn't compile.
    """
    codings = list(codings)
    numbers = [as_number(df, c.name) for c in codings if c.kind == "numeric"]
    given = [side_by_side(numbers, "double").alias("numbers")] if numbers else []
    given += [as_text(df, c.name).alias(f"c{i}") for i, c in enumerate(codings) if c.kind != "numeric"]
    kinds = T.StructType([T.StructField(c.name, T.IntegerType()) for c in codings] + [df.schema[m] for m in more])
    return df.select(*given, *map(_col, more)).mapInArrow(lambda it: _codes(it, codings, kinds.names), kinds)


def encoded(df: DataFrame, features: list[Coding], target: Coding, missing: str = "category") -> DataFrame:
    """All columns as codes; with missing="drop" only rows without missing values."""
    out = coded(df, [*features, target])
    return out.filter(reduce(and_, [_col(c).isNotNull() for c in out.columns])) if missing == "drop" else out


def sampled(df: DataFrame, n_rows: int, most: int, seed: int) -> DataFrame:
    """``df``, or if it has more than ``most`` rows, exactly ``most`` of them: the same ones however they are laid out."""
    return df if n_rows <= most else bottom_k(df, row_hash(df, seed), most)
