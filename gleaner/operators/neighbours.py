"""Nearest-neighbour informations of a table's columns, by Spark tasks: no row reaches the driver, none is broadcast.

A request is a pair of lists of columns (a, b); many are answered at once.

Tables of up to CELL_ROWS rows: each request's columns are packed and dealt to a task of its own, which measures them with k-d trees
(``knn.ksg_mi``). Each column is sent once a request that has it.

Larger tables: the points of each request are cut into cells of nearly equal numbers of points, by ranges of their coordinates and then their number,
so that equal points share no cell of unbounded size.
1. Each cell finds its points' nearest neighbours among its own. The k-th distance so found bounds the true one.
2. A point goes, as a query, to those other cells alone whose boxes that distance reaches, and is settled by what they answer.
3. The margins are cut into cells of their own. A cell that lies wholly within a point's radius adds its size, one that is partly reached is
   asked, any other isn't touched.
Boxes of cells (a row each) are all that the driver sees.

Both ways give the same neighbours and the same counts, whatever the partitions; ties and copied columns among them.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.special import digamma
from gleaner.operators.kdtree import Tree
from gleaner.operators.knn import ksg_mi

#: Rows of a task's trees; rows packed together; queries of a cell that are answered together.
CELL_ROWS, BATCH, ASKED = 1 << 18, 1 << 14, 1 << 15

Request = tuple[tuple[str, ...], tuple[str, ...]]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def informations(table: DataFrame, rows: int, requests: list[Request], k: int) -> list[float]:
    """I(a; b) in nats, at least 0, of each request; 0 if there are no more than k + 1 rows. Columns are doubles without nulls."""
    if rows <= k + 1 or not requests:
        return [0.0] * len(requests)
    return _by_request(table, requests, k) if rows <= CELL_ROWS else _by_cells(table, rows, requests, k)


def _by_request(table: DataFrame, requests: list[Request], k: int) -> list[float]:
    columns = sorted({c for a, b in requests for c in (*a, *b)})
    places = [([columns.index(c) for c in a], [columns.index(c) for c in b]) for a, b in requests]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            points = np.concatenate(held, axis=1)
            for i, (a, b) in enumerate(places):
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([points[[*a, *b]].tobytes()], pa.binary())], ["request", "data"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
            if n >= BATCH:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.setdefault(i, []).append(np.frombuffer(data.as_buffer()).reshape(sum(map(len, places[i])), -1))
        for i, some in parts.items():
            points = np.concatenate(some, axis=1).T
            d = len(places[i][0])
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([ksg_mi(points[:, :d], points[:, d:], k)])], ["request", "v"])

    dealt = table.select(*map(_q, columns)).mapInArrow(packed, "request int, data binary").repartitionById(len(requests), F.col("request"))
    found = {r["request"]: r["v"] for r in dealt.mapInArrow(measured, "request int, v double").collect()}
    return [found[i] for i in range(len(requests))]


# --- larger tables: points are (g, id, p), g the request's number


class _Boxes:
    """Boxes and sizes of the cells of each request; cells are numbered through."""

    def __init__(self, cells: DataFrame, d: dict[int, int]):
        most = max(d.values())
        ends = [f(F.get("p", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(most) for f in (F.min, F.max)]
        found = sorted(cells.groupBy("g", "part").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: (r["g"], r["part"]))
        self.cell = {(r["g"], r["part"]): i for i, r in enumerate(found)}
        self.count, self.of = len(found), {}
        for g in d:
            mine = [(self.cell[g, r["part"]], r) for r in found if r["g"] == g]
            box = np.array([[[r[f"min{i}"], r[f"max{i}"]] for i in range(d[g])] for _, r in mine], float).reshape(len(mine), d[g], 2)
            self.of[g] = (np.array([c for c, _ in mine]), box[:, :, 0], box[:, :, 1], np.array([r["n"] for _, r in mine]))

    def near_and_far(self, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that a point of each cell of ``g`` may have from each of ``p``: (points, cells)."""
        _, low, high, _ = self.of[g]
        near, far = np.zeros((len(p), len(low))), np.zeros((len(p), len(low)))
        for i in range(p.shape[1]):
            x = p[:, i : i + 1]
            near += np.maximum(low[:, i] - x, x - high[:, i]).clip(0) ** 2
            far += np.maximum(high[:, i] - x, x - low[:, i]) ** 2
        return np.sqrt(near), np.sqrt(far)


def _points(b: pa.RecordBatch, name: str, rows: np.ndarray | None = None) -> np.ndarray:
    """A column of arrays of one length as a table."""
    c = b.column(name) if rows is None else b.column(name).take(pa.array(rows))
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _groups(g: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for v in np.unique(g).tolist():
        yield v, np.flatnonzero(g == v)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def _celled(points: DataFrame, rows: int, d: int) -> DataFrame:
    """Points with ``part``: with their request, the cell they fall into."""
    coordinates = [F.get("p", F.lit(i)) for i in range(d)]
    parts = max(1, -(-rows // CELL_ROWS))
    return points.repartitionByRange(parts, "g", *coordinates, "id").withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)


def _asked(points: DataFrame, queries: DataFrame, boxes: _Boxes, answer: Callable[[Tree, np.ndarray, np.ndarray], pa.Array], kind: str) -> DataFrame:
    """(g, id, answer) of queries (cell, g, id, p, r) by the points (g, id, p, part) of their cells."""
    number = boxes.cell

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = [number[k] for k in zip(b.column("g").to_pylist(), b.column("part").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(cell, pa.int32()), pa.array([False] * len(cell)), b.column("g"), b.column("id"), b.column("p"), pa.nulls(len(cell), pa.float64())], ["cell", "asks", "g", "id", "p", "r"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a cell's points come first; it has CELL_ROWS or so
        now, held, tree = None, [], None
        for b in batches:
            for cell, some in _groups(b.column("cell").to_numpy()):
                b_cell = b.take(pa.array(some))
                if cell != now:
                    now, held, tree = cell, [], None
                asks = b_cell.column("asks").to_numpy(zero_copy_only=False)
                if (~asks).any():
                    held.append(_points(b_cell, "p", np.flatnonzero(~asks)))
                which = np.flatnonzero(asks)
                for i in range(0, len(which), ASKED):
                    tree = tree or Tree(np.concatenate(held))
                    rows = which[i : i + ASKED]
                    part = b_cell.take(pa.array(rows))
                    yield pa.record_batch([part.column("g"), part.column("id"), answer(tree, _points(part, "p"), part.column("r").to_numpy())], ["g", "id", "answer"])

    mine = points.select("g", "id", "p", "part").mapInArrow(numbered, "cell int, asks boolean, g int, id long, p array<double>, r double")
    both = mine.unionByName(queries.withColumn("asks", F.lit(True)))
    dealt = both.repartitionById(boxes.count, F.col("cell")).sortWithinPartitions("cell", "asks")
    return dealt.mapInArrow(answered, f"g int, id long, answer {kind}")


def _radii(points: DataFrame, rows: int, d: dict[int, int], k: int) -> DataFrame:
    """(g, id, p, r): each point's distance to its k-th neighbour."""
    cells = _celled(points, rows * len(d), max(d.values()))
    boxes = _Boxes(cells, d)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for g, some in _groups(b.column("g").to_numpy()):
            part = b.take(pa.array(some))
            p = _points(part, "p")
            near = Tree(p, max(32, 2 * (k + 2))).nearest(k + 1)
            yield pa.record_batch([part.column("g"), part.column("id"), part.column("p"), part.column("part"), _lists(near)], ["g", "id", "p", "part", "near"])

    first = cells.mapInArrow(own, "g int, id long, p array<double>, part int, near array<double>").persist(StorageLevel.MEMORY_AND_DISK)

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, some in _groups(b.column("g").to_numpy()):
                for i in range(0, len(some), BATCH):
                    part = b.take(pa.array(some[i : i + BATCH]))
                    p, r = _points(part, "p"), _points(part, "near")[:, -1]
                    mine = np.array([boxes.cell[g, v] for v in part.column("part").to_pylist()])
                    cell = boxes.of[g][0]
                    row, at = np.nonzero((boxes.near_and_far(g, p)[0] <= r[:, None]) & (cell != mine[:, None]))
                    sent = part.take(pa.array(row))
                    yield pa.record_batch([pa.array(cell[at].astype(np.int32)), sent.column("g"), sent.column("id"), sent.column("p"), pa.array(r[row])], ["cell", "g", "id", "p", "r"])

    queries = first.mapInArrow(reaching, "cell int, g int, id long, p array<double>, r double")
    more = _asked(cells, queries, boxes, lambda tree, p, r: _lists(tree.nearest(k + 1, Tree(p), r)), "array<double>")
    every = first.select("g", "id", "p", "near").unionByName(more.select("g", "id", F.lit(None).cast("array<double>").alias("p"), F.col("answer").alias("near")))
    merged = every.groupBy("g", "id").agg(F.first("p", ignorenulls=True).alias("p"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    out = merged.select("g", "id", "p", F.get("near", F.lit(k)).alias("r")).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    first.unpersist()
    cells.unpersist()
    return out


def _counts(radii: DataFrame, rows: int, d: dict[int, int]) -> DataFrame:
    """(g, id, n): how many points lie within each point's radius."""
    cells = _celled(radii, rows * len(d), max(d.values()))
    boxes = _Boxes(cells, d)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to cells that are partly reached; what cells wholly within add comes without a cell, in r."""
        for b in batches:
            for g, some in _groups(b.column("g").to_numpy()):
                for i in range(0, len(some), BATCH):
                    part = b.take(pa.array(some[i : i + BATCH]))
                    r = part.column("r").to_numpy()[:, None]
                    near, far = boxes.near_and_far(g, _points(part, "p"))
                    cell, _, _, size = boxes.of[g]
                    whole = (far <= r) @ size
                    row, at = np.nonzero((near <= r) & ~(far <= r))
                    row, cell_of, value = np.concatenate([row, np.arange(len(r))]), np.concatenate([cell[at], np.full(len(r), -1)]).astype(np.int32), np.concatenate([r[row, 0], whole])
                    sent = part.take(pa.array(row))
                    yield pa.record_batch([pa.array(cell_of), sent.column("g"), sent.column("id"), sent.column("p"), pa.array(value.astype(float))], ["cell", "g", "id", "p", "r"])

    asked = cells.mapInArrow(split, "cell int, g int, id long, p array<double>, r double").persist(StorageLevel.MEMORY_AND_DISK)
    more = _asked(cells, asked.filter("cell >= 0"), boxes, lambda tree, p, r: pa.array(tree.count(r, Tree(p)), pa.int64()), "long")
    every = asked.filter("cell < 0").select("g", "id", F.col("r").cast("long").alias("n")).unionByName(more.select("g", "id", F.col("answer").alias("n")))
    out = every.groupBy("g", "id").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    asked.unpersist()
    cells.unpersist()
    return out


def _by_cells(table: DataFrame, rows: int, requests: list[Request], k: int) -> list[float]:
    sizes = {g: (len(a), len(b)) for g, (a, b) in enumerate(requests)}
    each = [F.struct(F.lit(g).alias("g"), F.array(*[F.col(_q(c)) for c in (*a, *b)]).alias("p")) for g, (a, b) in enumerate(requests)]
    points = table.select(F.monotonically_increasing_id().alias("id"), F.explode(F.array(*each)).alias("s")).select("s.g", "id", "s.p")
    radii = _radii(points, rows, {g: a + b for g, (a, b) in sizes.items()}, k)
    width = F.get(F.array(*[F.lit(a) for a, _ in sizes.values()]), F.col("g"))
    sides = (F.slice("p", F.lit(1), width), F.slice("p", width + 1, F.size("p") - width))
    parts = [_counts(radii.withColumn("p", p), rows, {g: s[i] for g, s in sizes.items()}) for i, p in enumerate(sides)]

    def psi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("g"), pa.array(digamma(b.column("n").to_numpy()))], ["g", "v"])

    every = parts[0].unionByName(parts[1]).mapInArrow(psi, "g int, v double")
    sums = {r["g"]: float(r["v"]) for r in every.groupBy("g").agg(F.sum(F.col("v").cast("decimal(38,18)")).alias("v")).collect()}
    for p in (*parts, radii):
        p.unpersist()
    top = float(digamma(np.array([k]))[0]) + math.log(rows)
    return [max(0.0, top - sums[g] / rows) for g in range(len(requests))]


class KnnInformations:
    """Informations of a table's columns by nearest neighbours, each asked once.

    The table is kept by the executors from its first use to the end of the ``with`` block.
    """

    def __init__(self, df: DataFrame, features: list[str], target: str, numeric_target: bool, k: int):
        """Rows with nulls go; a class target becomes its place among the sorted classes."""
        some = df.select(*[F.col(_q(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(_q(target)).alias("y")).dropna()
        if numeric_target:
            self.table = some.withColumn("y", F.col("y").cast("double"))
        else:
            classes = sorted(r["y"] for r in some.select("y").distinct().collect())  # a row a class
            places = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(classes)], f"y {df.schema[target].dataType.simpleString()}, place double")
            self.table = some.join(F.broadcast(places), "y").withColumn("y", F.col("place")).drop("place")
        self.table = self.table.persist(StorageLevel.MEMORY_AND_DISK)
        self.rows, self.k, self.columns = self.table.count(), k, list(range(len(features)))
        self._kept: dict[Request, float] = {}

    def __enter__(self) -> KnnInformations:
        return self

    def __exit__(self, *_) -> None:
        self.table.unpersist()

    def only(self, columns: list[int]) -> KnnInformations:
        """The informations of some candidates, on the same rows."""
        out = copy.copy(self)
        out.columns = [self.columns[i] for i in columns]
        return out

    def _asked(self, requests: list[Request]) -> np.ndarray:
        if new := [r for r in dict.fromkeys(requests) if r not in self._kept]:
            self._kept |= dict(zip(new, informations(self.table, self.rows, new, self.k), strict=True))
        return np.array([self._kept[r] for r in requests])

    def _names(self) -> list[str]:
        return [f"x{i}" for i in self.columns]

    def relevance(self) -> np.ndarray:
        return self._asked([((x,), ("y",)) for x in self._names()])

    def redundancy(self, s: int) -> np.ndarray:
        names = self._names()
        return self._asked([((x,), (names[s],)) for x in names])

    def gain(self, s: int) -> np.ndarray:
        """I(x, s; y) - I(s; y)."""
        names = self._names()
        found = self._asked([((x, names[s]), ("y",)) for x in names] + [((names[s],), ("y",))])
        return found[:-1] - found[-1]

    def gain_given(self, fixed: list[int]) -> np.ndarray:
        names = self._names()
        rest = [tuple(names[f] for f in fixed if f != i) for i in range(len(names))]
        # nothing is known of the target without columns
        whole = self._asked([((x, *z), ("y",)) for x, z in zip(names, rest, strict=True)])
        known = self._asked([(z, ("y",)) for z in rest if z])
        before = iter(known.tolist())
        return whole - np.array([next(before) if z else 0.0 for z in rest])
