"""Joint tables of all pairs of features and the target, counted in tiles.

The features are cut into groups; a block is the pairs of one group with another (or with itself). Rows are packed, BATCH at a time, into small
whole numbers by columns, and a batch's columns of a block's two groups, with the target, are dealt to that block's task. A task counts
its block's pairs in dense tables of BLOCK_CELLS cells together at most, whatever the number of rows and pairs, so no row is ever repeated for a
pair. A pair whose own table is larger is counted by sorted keys, which takes as much memory as the combinations that occur.

What is sent: each column once a group, in one to four bytes a row; with more than SHARD_ROWS rows, blocks are counted in shards, and the
shards' tables are added pair by pair. Informations come straight from the tables in the tasks: one row a pair leaves them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells (8 bytes each) of the dense tables that a task holds; rows packed together; rows that one task counts.
BLOCK_CELLS, BATCH, SHARD_ROWS = 4_000_000, 1 << 16, 1 << 22
#: Bytes of tables sent together.
_SENT = 8 << 20

Table = tuple[int, int, np.ndarray, np.ndarray]


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Tiles:
    """How pairs of features with so many codes each (one more stands for null) fall into blocks."""

    def __init__(self, sizes: list[int], target_size: int, tasks: int, block_cells: int):
        self.wide = [n + 1 for n in sizes]
        self.y = target_size + 1
        if max(self.wide, default=1) ** 2 * self.y >= 1 << 63:
            raise ValueError("a pair's combinations must number below 2 ** 63")
        k, self.block_cells = len(sizes), block_cells
        for groups in range(1, k + 1):
            edge = np.searchsorted(np.cumsum(self.wide), np.arange(1, groups) * sum(self.wide) / groups)
            edge = np.unique(np.concatenate([[0], edge, [k]])) if groups < k else np.arange(k + 1)
            members = [range(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            blocks = [(a, b) for i, a in enumerate(members) for b in members[i:] if a is not b or len(a) > 1]
            most = max((sum(self.cells(i, j) for i, j in self.pairs(a, b)) for a, b in blocks), default=0)
            self.blocks = blocks
            if most <= block_cells and len(blocks) >= tasks:
                break

    def cells(self, i: int, j: int) -> int:
        """Cells that a pair takes in dense tables; one that is too large for them takes none."""
        n = self.wide[i] * self.wide[j] * self.y
        return n if n <= self.block_cells else 0

    @staticmethod
    def pairs(a: range, b: range) -> Iterator[tuple[int, int]]:
        return ((i, j) for j in b for i in (a if a is not b else range(a.start, j)))

    def columns(self, block: int) -> list[int]:
        a, b = self.blocks[block]
        return [*a, *(b if a is not b else ())]


def _packed(batches: Iterator[pa.RecordBatch], tiles: Tiles, shards: int) -> Iterator[pa.RecordBatch]:
    """(task, block, data): each block's columns of BATCH rows, and the target, as the smallest whole numbers that hold them."""
    wide = [*tiles.wide, tiles.y]
    kind, null = np.min_scalar_type(max(wide) - 1), np.array(wide)[:, None] - 1
    held, rows, n = [], 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        table = np.concatenate(held, axis=1)
        for block in range(len(tiles.blocks)):
            data = table[[*tiles.columns(block), len(wide) - 1]].tobytes()
            yield pa.record_batch([pa.array([block * shards + n % shards], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["task", "block", "data"])

    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            some = b.slice(at, BATCH)
            codes = pc.fill_null(some.column(0).flatten(), -1).to_numpy(zero_copy_only=False).reshape(-1, len(wide)).T
            held.append(np.where(codes < 0, null, codes).astype(kind))
            rows += some.num_rows
            if rows >= BATCH:
                yield from out()
                held, rows, n = [], 0, n + 1
    if rows:
        yield from out()


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and the sum of each one's counts."""
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], tiles: Tiles) -> Iterator[Table]:
    """The tables of the blocks dealt to a task: (i, j, keys, counts) with the key (xi * wide[j] + xj) * y + target."""
    kind = np.min_scalar_type(max(*tiles.wide, tiles.y) - 1)
    dense: dict[tuple[int, int], np.ndarray] = {}
    sparse: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
            columns = tiles.columns(block)
            table = np.frombuffer(data.as_buffer(), kind).reshape(len(columns) + 1, -1)
            y = table[-1].astype(np.int64)
            x = {c: table[k].astype(np.int64) for k, c in enumerate(columns)}
            low, last = y, -1
            for i, j in tiles.pairs(*tiles.blocks[block]):
                if j != last:
                    low, last = x[j] * tiles.y + y, j
                width = tiles.wide[j] * tiles.y
                key = x[i] * width + low
                if tiles.cells(i, j):
                    found = np.bincount(key, minlength=tiles.wide[i] * width)
                    if (i, j) in dense:
                        dense[i, j] += found
                    else:
                        dense[i, j] = found
                else:
                    found = np.unique(key, return_counts=True)
                    before = sparse.get((i, j))
                    sparse[i, j] = found if before is None else _added([before[0], found[0]], [before[1], found[1]])
    while dense:  # a table goes when it has been given out
        (i, j), t = dense.popitem()
        at = np.flatnonzero(t)
        yield i, j, at, t[at]
    while sparse:
        (i, j), (at, n) = sparse.popitem()
        yield i, j, at, n


def _sent(tables: Iterator[Table]) -> Iterator[pa.RecordBatch]:
    """Tables as rows of (i, j, keys, counts)."""
    held, size = [], 0
    for t in tables:
        held.append(t)
        size += 16 * len(t[2])
        if size >= _SENT:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _rows(held: list[Table]) -> pa.RecordBatch:
    i, j, keys, counts = zip(*held, strict=True)
    return pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())], ["i", "j", "keys", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[Table]:
    """The tables of shards, sorted by pair, added."""
    now, keys, counts = None, [], []
    for b in batches:
        for i, j, k, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now not in (None, (i, j)):
                yield *now, *_added(keys, counts)
                keys, counts = [], []
            now = (i, j)
            keys.append(np.frombuffer(k, np.int64))
            counts.append(np.frombuffer(n, np.int64))
            if len(keys) > 16:  # so that many shards take no more than some
                some = _added(keys, counts)
                keys, counts = [some[0]], [some[1]]
    if now is not None:
        yield *now, *_added(keys, counts)


def _as_cells(tables: Iterator[Table], tiles: Tiles) -> Iterator[pa.RecordBatch]:
    for i, j, keys, n in tables:
        high, y = np.divmod(keys, tiles.y)
        xi, xj = np.divmod(high, tiles.wide[j])
        out = [pa.array(np.full(len(keys), v, np.int32)) for v in (i, j)]
        out += [pa.array(c.astype(np.int32), mask=c == w - 1) for c, w in zip((xi, xj, y), (tiles.wide[i], tiles.wide[j], tiles.y), strict=True)]
        yield pa.record_batch([*out, pa.array(n)], ["i", "j", "xi", "xj", "y", "n"])


def _terms(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """n ln n of the sums of counts by key."""
    most = int(key.max(initial=0)) + 1
    n = np.bincount(key, counts, most) if most <= 4 * len(key) + 1024 else _added([key], [counts])[1]
    n = n[n > 0].astype(float)
    return n * np.log(n)


def _as_informations(tables: Iterator[Table], tiles: Tiles) -> Iterator[pa.RecordBatch]:
    """(i, j, mi, gain_i, gain_j): I(xi; xj), I(xi; y | xj), I(xj; y | xi).

    Sums of n ln n over the cells and their margins, exactly rounded: they don't depend on the order of the cells, so equal columns have equal
    informations, and what cancels is 0.
    """
    total = lambda plus, minus: math.fsum(np.concatenate([*plus, *(-m for m in minus)]).tolist())
    for i, j, keys, counts in tables:
        high, y = np.divmod(keys, tiles.y)
        xi, xj = np.divmod(high, tiles.wide[j])
        n, a, b = float(counts.sum()), _terms(xi, counts), _terms(xj, counts)
        both, ay, by = _terms(high, counts), _terms(xi * tiles.y + y, counts), _terms(xj * tiles.y + y, counts)
        every = counts.astype(float)
        every = every * np.log(every)
        found = [total([both, [n * math.log(n)]], [a, b]), total([every, b], [both, by]), total([every, a], [both, ay])]
        yield pa.record_batch([pa.array([i], pa.int32()), pa.array([j], pa.int32()), *(pa.array([v / n]) for v in found)], ["i", "j", "mi", "gain_i", "gain_j"])


def _sizes_of(codes: DataFrame, columns: list[str]) -> list[int]:
    row = codes.agg(*[F.max(_col(c)).cast("int").alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return [0 if m is None else m + 1 for m in row]


def _tables(codes: DataFrame, features: list[str], target: str, sizes: list[int] | None, target_size: int, rows: int | None, block_cells: int | None, given, kind: str) -> DataFrame:
    spark = codes.sparkSession
    if sizes is None:
        *sizes, target_size = _sizes_of(codes, [*features, target])
    if len(features) < 2:
        return spark.createDataFrame([], kind)
    rows = codes.count() if rows is None else rows
    shards = max(1, -(-rows // SHARD_ROWS))
    tiles = Tiles(sizes, target_size, -(-2 * spark.sparkContext.defaultParallelism // shards), block_cells or BLOCK_CELLS)
    # as one array: for each row, Spark sums up the buffers of every column that goes to a task of ``mapInArrow``
    ints = codes.select(F.array(*[_col(c).cast("int") for c in (*features, target)]).alias("codes"))
    dealt = ints.mapInArrow(lambda it: _packed(it, tiles, shards), "task int, block int, data binary")
    dealt = dealt.repartitionById(len(tiles.blocks) * shards, F.col("task"))
    if shards == 1:
        return dealt.mapInArrow(lambda it: given(_counted(it, tiles), tiles), kind)
    parts = dealt.mapInArrow(lambda it: _sent(_counted(it, tiles)), "i int, j int, keys binary, counts binary")
    return parts.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(lambda it: given(_merged(it), tiles), kind)


def pair_cells(codes: DataFrame, features: list[str], target: str, sizes: list[int] | None = None, target_size: int = 0, rows: int | None = None, block_cells: int | None = None) -> DataFrame:
    """(i, j, xi, xj, y, n) of every pair i < j (places in ``features``) and the target, for the combinations that occur.

    Codes are whole numbers from 0 on, below ``sizes`` and ``target_size`` (found by a pass of its own if not given); null is a code
    of its own. ``rows``: about how many there are (counted if not given). ``block_cells``: cells a task may hold.
    """
    return _tables(codes, features, target, sizes, target_size, rows, block_cells, _as_cells, "i int, j int, xi int, xj int, y int, n long")


def pair_informations(codes: DataFrame, features: list[str], target: str, sizes: list[int] | None = None, target_size: int = 0, rows: int | None = None, block_cells: int | None = None) -> DataFrame:
    """(i, j, mi, gain_i, gain_j) of every pair i < j: I(xi; xj), I(xi; y | xj), I(xj; y | xi). Arguments as in ``pair_cells``."""
    return _tables(codes, features, target, sizes, target_size, rows, block_cells, _as_informations, "i int, j int, mi double, gain_i double, gain_j double")
