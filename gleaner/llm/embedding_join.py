"""Near-duplicate vectors by cosine: a subspace pigeonhole join.

1. Equal vectors of a label (bit for bit) are one class, so copies are neither joined nor listed.
2. Vectors are scaled to length 1 and rotated by a fixed random rotation, which spreads their length evenly over all
   coordinates. cos >= c means a squared distance of at most 2 - 2c. The coordinates are cut into BLOCKS blocks, block
   j with the share d_j / d of that budget: if every block of a pair were over its share, the whole would be over
   the budget, so a similar pair is within its share in at least one block.
3. Each block is range-joined by itself: on its first GRID coordinates vectors fall into cells twice as wide as the
   block's radius: each is filed under its own cell and sought in the cells that its radius reaches (2^GRID at most), an
   equi-join on (label, block, cell). A cell with many vectors is cut into tiles of about TILE of them and SIDE of those
   sought. Rows carry the block only, and a row leaves its tile only if some other is within the block's
   share of it: rows leave, never pairs.
4. The rows that left meet again in their tiles, now with their vectors, where pairs are verified in double precision.
   A pair counts in the first block in which it is within the share, so that the union over blocks has it once. A tile
   gives out for each of its rows how many vectors it links with there, and what it connects (a node and its
   representative): again rows, as few as the tile has, however many pairs it verified.

Links of a class are counted with the sizes of the classes it links with; components contract what the tiles connect.

Edge cases: vectors that are null, empty, all zero or hold null or non-finite components, and rows without a label,
link with nothing and are reported with no links and themselves as component; vectors of different dimension never
link; null or repeated ids are allowed, each row is reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import attach_group, freed, scratch, staged
from gleaner.llm.graph import components
from gleaner.llm.shingles import mix

COSINE = 0.98
BLOCKS, GRID = 8, 3
#: Vectors filed in a tile, and sought in it.
TILE, SIDE = 1024, 8192
#: Added to budgets against rounding, and to radii so that a pair within a budget is met from both sides.
_EPS, _REACH = 1e-6, 1e-5
#: Cells of a matrix, and pairs, that are handled at a time.
_CELLS, _PAIRS = 1 << 20, 1 << 14

_ROW = "id long, label string, cls binary, unit array<float>, vector array<double>"
_U = np.uint64


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"\0".join(parts)).digest()[:16]


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns: dict[int, np.ndarray] = {}
    for b in batches:
        labels = b.column(1).to_pylist()
        cls, units, vectors = [], [], []
        for v, label in zip(b.column(2), labels, strict=True):
            x = None
            if v.is_valid and label is not None and len(v.values) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                top = np.abs(x).max()
                x = x if np.isfinite(top) and top > 0 else None
            if x is None:
                for out in (cls, units, vectors):
                    out.append(None)
                continue
            if len(x) not in turns:
                turns[len(x)] = rotation(len(x))
            y = x / top
            cls.append(_digest(label.encode(), x.tobytes()))
            units.append((turns[len(x)] @ (y / np.linalg.norm(y))).astype(np.float32))
            vectors.append(x)
        yield pa.record_batch([b.column(0), pa.array(labels, pa.string()), pa.array(cls, pa.binary()), pa.array(units, pa.list_(pa.float32())), pa.array(vectors, pa.list_(pa.float64()))], ["id", "label", "cls", "unit", "vector"])


def _blocks(d: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def _share(budget: float, size: int, d: int) -> float:
    return budget * size / d + _EPS


_PLACE = "place long, block int, share double, home boolean, cls binary, part array<float>"


def _by_size(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length of vectors."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(offsets)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, values[offsets[rows][:, None] + np.arange(d)]


def _places(batches: Iterator[pa.RecordBatch], budget: float) -> Iterator[pa.RecordBatch]:
    """A row for each cell in which a class is filed (home) or sought; ``place`` is a hash of label, dimension, block and cell."""
    for b in batches:
        labels, names = b.column(0).to_pylist(), b.column(1)
        label = np.array([xxhash.xxh64_intdigest(x) for x in labels], np.uint64)
        for rows, x in _by_size(b.column(2)):
            d = x.shape[1]
            for j, (lo, hi) in enumerate(_blocks(d)):
                share = _share(budget, hi - lo, d)
                width = 2 * ((share + _EPS) ** 0.5 + _REACH)
                at = x[:, lo : min(hi, lo + GRID)].astype(np.float64) / width
                own, low = np.floor(at), np.floor(at - 0.5)
                corners = np.array(list(np.ndindex(*(2,) * at.shape[1])), np.float64)
                cells = np.concatenate([own[:, None], low[:, None] + corners], axis=1)  # (rows, 1 + corners, coordinates)
                off = np.maximum(np.maximum(cells - at[:, None], at[:, None] - cells - 1), 0)
                reached = (off**2).sum(axis=2) <= 0.25
                row, cell = np.nonzero(reached)
                h = mix(label[rows[row]] + _U(d << 8 | j))
                for c in range(at.shape[1]):
                    h = mix(h + cells[row, cell, c].astype(np.int64).view(np.uint64))
                part = np.ascontiguousarray(x[row, lo:hi], np.float32)
                parts = pa.ListArray.from_arrays(np.arange(0, part.size + 1, hi - lo, dtype=np.int32), pa.array(part.ravel()))
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(row), j, np.int32)), pa.array(np.full(len(row), share)), pa.array(cell == 0), names.take(pa.array(rows[row])), parts], ["place", "block", "share", "home", "cls", "part"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of each tile, from rows sorted by place and tile."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        place, tile = b.column("place").to_numpy(), b.column("tile").to_numpy()
        cut = np.flatnonzero((place[1:] != place[:-1]) | (tile[1:] != tile[:-1])) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            if now != (place[i], tile[i]):
                if held:
                    yield held
                now, held = (place[i], tile[i]), []
            held.append(b.slice(i, j - i))
    if held:
        yield held


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles that have another within the block's share: (place, tile, block, home, cls)."""
    for held in _tiles(batches):
        t = pa.Table.from_batches(held).combine_chunks()
        home, share = t["home"].to_numpy(), float(t["share"][0].as_py())
        part = t["part"].chunk(0)
        size = np.diff(part.offsets.to_numpy())
        if not home.any() or home.all() or (size != size[0]).any():
            continue
        x = part.flatten().to_numpy().reshape(len(home), -1).astype(np.float64)
        cls = t["cls"].chunk(0).dictionary_encode().indices.to_numpy()
        at, to = np.flatnonzero(home), np.flatnonzero(~home)
        y, square = x[at], (x[at] ** 2).sum(1)
        keep = np.zeros(len(home), bool)
        step = max(1, _CELLS // len(at))
        for i in range(0, len(to), step):
            z = x[to[i : i + step]]
            near = square[:, None] + (z**2).sum(1)[None, :] - 2 * y @ z.T <= share + _EPS
            near &= cls[at][:, None] != cls[to[i : i + step]][None, :]
            keep[at] |= near.any(axis=1)
            keep[to[i : i + step]] = near.any(axis=0)
        if keep.any():
            yield from t.select(["place", "tile", "block", "home", "cls"]).take(np.flatnonzero(keep)).to_batches()


def _connected(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers the labels of nodes so that nodes joined by a pair have one; labels are nodes of their component."""
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:  # to the label's own label
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _linked_rows(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Of tiles with vectors: (cls, others, root): how many vectors a row links with there, and what it is connected with."""
    budget, turns = 2 - 2 * cosine, {}
    for held in _tiles(batches):
        t = pa.Table.from_batches(held).combine_chunks()
        home, block = t["home"].to_numpy(), int(t["block"][0].as_py())
        vector = t["vector"].chunk(0)
        d = np.diff(vector.offsets.to_numpy())
        if not home.any() or home.all() or (d != d[0]).any():
            continue
        d = int(d[0])
        x = vector.flatten().to_numpy().reshape(len(home), d)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        if d not in turns:
            turns[d] = rotation(d)
        turned = (x / norm[:, None]) @ turns[d].T
        blocks = _blocks(d)[: block + 1]
        shares = [_share(budget, hi - lo, d) for lo, hi in blocks]
        weight = t["size"].to_numpy()
        names = t["cls"].chunk(0).dictionary_encode()
        cls = names.indices.to_numpy()
        at, to = np.flatnonzero(home), np.flatnonzero(~home)
        others, label = np.zeros(len(home), np.int64), np.arange(len(names.dictionary))
        step = max(1, _CELLS // len(at))
        for i in range(0, len(to), step):
            some = to[i : i + step]
            near = (x[at] / norm[at][:, None]) @ (x[some] / norm[some][:, None]).T >= cosine - 1e-9
            near &= cls[at][:, None] != cls[some][None, :]
            for (lo, hi), share in zip(blocks[:-1], shares[:-1], strict=True):  # surely met in an earlier block
                if near.any():
                    y, z = turned[at, lo:hi], turned[some, lo:hi]
                    near &= (y**2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * y @ z.T > share - 1e-9
            rows, columns = np.nonzero(near)
            for k in range(0, len(rows), _PAIRS):
                # to the last bit alike from both sides of a pair
                a, b = at[rows[k : k + _PAIRS]], some[columns[k : k + _PAIRS]]
                good = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
                gap = (turned[a, : blocks[-1][1]] - turned[b, : blocks[-1][1]]) ** 2
                within = [gap[:, lo:hi].sum(axis=1) <= share for (lo, hi), share in zip(blocks, shares, strict=True)]
                good &= within[-1] & ~np.any(within[:-1], axis=0) if block else within[-1]
                a, b = a[good], b[good]
                np.add.at(others, b, weight[a])
                _connected(label, cls[a], cls[b])
        first = np.zeros(len(home), bool)
        first[np.unique(cls, return_index=True)[1]] = True
        out = np.flatnonzero((others > 0) | (first & (label[cls] != cls)))
        if len(out):
            take = names.dictionary.take
            yield pa.record_batch([take(pa.array(cls[out])), pa.array(others[out]), take(pa.array(label[cls[out]]))], ["cls", "others", "root"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept."""
    with scratch() as keep:
        rows, named = _named(vectors.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("string"), F.col(f"`{vector_col}`").cast("array<double>")), cosine)
        keep(rows, named)
    out = attach_group(rows.filter("cls is not null").select("id", "cls"), named, ["cls"], "size").select("id", "n_links", "component_id")
    alone = rows.filter("cls is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _named(vectors: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(id, cls, ...) of each row, and (cls, size, n_links, component_id) of each class."""
    budget = 2 - 2 * cosine
    rows = staged(vectors.mapInArrow(freed(_prepared), _ROW), "vectors")
    full = rows.filter("cls is not null")
    classes = staged(full.groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("size")), "classes")
    shapes = staged(full.select("cls", "label", "unit", "vector").dropDuplicates(["cls"]), "shapes")

    places = staged(shapes.select("label", "cls", "unit").mapInArrow(freed(lambda it: _places(it, budget)), _PLACE), "places")
    full_places = places.groupBy("place").agg(F.count_if("home").alias("filed"), F.count("*").alias("rows"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    full_places = staged(full_places.filter("filed > 0 and filed < rows and lo < hi").select("place", "filed", "rows"), "filed")
    across, down = F.ceil(F.col("filed") / TILE).cast("int"), F.ceil((F.col("rows") - F.col("filed")) / SIDE).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    tiles = F.when(F.col("home"), F.sequence(mine(across) * down, mine(across) * down + down - 1)).otherwise(F.sequence(mine(down), (across - 1) * down + mine(down), down))
    met = attach_group(places, full_places, ["place"], "rows").withColumn("tile", F.explode(tiles)).drop("filed", "rows")
    met = met.repartition(F.col("place"), F.col("tile")).sortWithinPartitions("place", "tile")
    near = staged(met.mapInArrow(freed(_near_rows), "place long, tile int, block int, home boolean, cls binary"), "near")

    with_vectors = near.join(shapes.select("cls", "vector"), "cls").join(classes.select("cls", "size"), "cls")
    with_vectors = with_vectors.repartition(F.col("place"), F.col("tile")).sortWithinPartitions("place", "tile")
    found = staged(with_vectors.mapInArrow(freed(lambda it: _linked_rows(it, cosine)), "cls binary, others long, root binary"), "linked")
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))

    degree = found.groupBy("cls").agg(F.sum("others").alias("others"))
    named = classes.join(degree, "cls", "left").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    named = staged(named.select("cls", "id", "size", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "named")
    least = staged(named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("classes")), "least")
    return rows, staged(attach_group(named, least, ["root"], "classes").select("cls", "size", "n_links", "component_id"), "named")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
    AND list_cosine_similarity(x.e, y.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degree USING (vec_id)"""
