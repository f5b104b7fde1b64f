"""Packing of documents into sequences of a fixed window, planned by non-negative least squares on the histogram of lengths.

1. Texts are encoded once; ids are staged with the row they came from. A document's full windows are sequences of their
   own; its remainder (shorter than the window) is a piece to be packed. Each task numbers its remainders of a length.
2. The histogram of remainders (at most window - 1 numbers, whatever the input) is the only thing that reaches the
   driver. ``plan`` enumerates shallow combinations of two to four lengths that fill the window, solves how often to
   repeat each (minimise |A x - h|^2, x >= 0, by accelerated projected gradients), rounds, and packs what is left
   greedily, largest first; what no combination fills well is laid end to end and cut where a sequence ends.
   The plan says for each length which ranks go where, in ranges: it has a few numbers a combination.
3. A remainder's rank is its number within its task plus the numbers of the tasks before; the plan turns ranks into
   (sequence, offset) by arithmetic. Nothing is dealt by length, so a very common length is no hot key.

Edge cases: a null text counts as empty and holds the end id only; ids may be null or repeated (each row is a document
of its own); an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import documents, freed, staged
from gleaner.llm.tokens import encoded

WINDOW = 4096
#: Padding that a combination may leave, as a share of the window, before its pieces are laid end to end instead.
SLACK = 1 / 128
#: Partners tried for each length in combinations of three and four.
PARTNERS = 6
_STEPS = 300
#: Pieces handed on at a time.
FLUSH = 512

_DOC = "part int, seq long, doc_id long, n_tokens long, rest int, number long, ids binary"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    seen = np.zeros(window, np.int64)
    for names, flat, n in (x for b in batches for x in encoded(b.column(0), b.column(1), path)):
        flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1  # each document is followed by the end id
        rest = n % window
        number = np.empty(len(n), np.int64)
        for i, r in enumerate(rest.tolist()):
            number[i] = seen[r]
            seen[r] += 1
        offsets = (np.concatenate([[0], np.cumsum(n)]) * flat.itemsize).astype(np.int64)
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())
        yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(seq, seq + len(n))), pa.array(names, pa.int64()), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(number), ids], ["part", "seq", "doc_id", "n_tokens", "rest", "number", "ids"])
        seq += len(n)


def combinations(h: np.ndarray, window: int) -> np.ndarray:
    """Shallow combinations of lengths present in ``h`` that fill the window but for a few ids; rows of four, 0 for none."""
    there = np.flatnonzero(h)
    if not len(there):
        return np.zeros((0, 4), np.int64)
    # largest[x]: the largest present length <= x (0 if none)
    largest = np.zeros(window + 1, np.int64)
    largest[there] = there
    largest = np.maximum.accumulate(largest)
    common = there[np.argsort(-h[there], kind="stable")]
    spread = there[np.linspace(0, len(there) - 1, min(PARTNERS, len(there))).astype(int)]
    found = [np.stack([there, largest[window - there], 0 * there, 0 * there], 1)]
    for b in {*common[:PARTNERS].tolist(), *spread.tolist()}:
        a = there[there + b < window]
        found.append(np.stack([a, 0 * a + b, largest[window - a - b], 0 * a], 1))
        for c in {b, int(common[0]), int(there[len(there) // 2])}:
            a = there[there + b + c < window]
            found.append(np.stack([a, 0 * a + b, 0 * a + c, largest[window - a - b - c]], 1))
    for k in (2, 3):  # the same length again and again, topped up
        a = there[there * k < window]
        found.append(np.stack([a] * k + [largest[window - k * a]] + [0 * a] * (3 - k), 1))
    every = np.unique(-np.sort(-np.concatenate(found), axis=1), axis=0)
    return every[every.sum(axis=1) >= window * (1 - SLACK)]


def repeats(h: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Least squares repeat counts x >= 0 with A x close to h, A counting each combination's lengths."""
    weight = (combos > 0).astype(float)
    size, flat = len(h), combos.ravel()
    forward = lambda x: np.bincount(flat, (weight * x[:, None]).ravel(), size)
    back = lambda r: (r[combos] * weight).sum(axis=1)
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(forward(v / np.linalg.norm(v)))
    step = 1 / (np.linalg.norm(v) * 1.05)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(_STEPS):
        new = np.maximum(y - step * back(forward(y) - h), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Where remainders go, by length and rank.

    Returns placed ranges (length, first rank, ranks, first sequence, pieces a sequence, first offset), laid ranges
    (length, first rank, ranks, first id of the lay-out, its first sequence), and the number of sequences.
    """
    left = h.astype(np.int64).copy()
    left[0] = 0
    total = left.copy()
    placed: list[tuple[int, ...]] = []
    sequences = 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length in dict.fromkeys(lengths):
            k = lengths.count(length)
            placed.append((length, int(total[length] - left[length]), k * times, sequences, k, offset))
            left[length] -= k * times
            offset += k * length
        sequences += times

    combos = combinations(left, window)
    if len(combos):
        x = np.floor(repeats(left.astype(float), combos) + 0.5).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] <= 0:
                break
            lengths = [int(v) for v in combos[i] if v]
            times = min(int(x[i]), *(int(left[v]) // lengths.count(v) for v in set(lengths)))
            if times > 0:
                place(lengths, times)
    laid: list[tuple[int, ...]] = []
    at = 0
    spare: list[int] = []
    for length in range(window - 1, 0, -1):
        while left[length] > 0:
            lengths, room, top = [length], window - length, length
            while room > 0:
                fits = np.flatnonzero(left[1 : min(top, room) + 1]) + 1
                fits = [v for v in fits[::-1][:8] if left[v] > lengths.count(v)][:1]
                if not fits:
                    top = 0
                    break
                top = int(fits[0])
                lengths.append(top)
                room -= top
            if room > window * SLACK:
                spare.append(length)
                break
            place(lengths, min(int(left[v]) // lengths.count(v) for v in set(lengths)))
    for length in spare:
        if left[length] > 0:
            laid.append((length, int(total[length] - left[length]), int(left[length]), at, sequences))
            at += length * int(left[length])
            left[length] = 0
    sequences += -(-at // window)
    return np.array(placed, np.int64).reshape(-1, 6), np.array(laid, np.int64).reshape(-1, 5), sequences


def _ranges(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((table[:, 1], table[:, 0]))
    return table[order], table[order, 0] * (1 << 44) + table[order, 1]


def _pieces(batches: Iterator[pa.RecordBatch], placed: np.ndarray, laid: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents: one row each, with ids."""
    (placed, placed_key), (laid, laid_key) = _ranges(placed), _ranges(laid)
    for b in batches:
        col = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("n_tokens", "rest", "rank", "fulls")}
        names, ids = b.column("doc_id").to_pylist(), b.column("ids")
        out: list[tuple] = []
        for i in range(b.num_rows):
            data, n, rest, rank = ids[i].as_py(), int(col["n_tokens"][i]), int(col["rest"][i]), int(col["rank"][i])
            if len(data) == 2 * n:
                data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
            pieces = [(k * window, window, int(col["fulls"][i]) + k, 0) for k in range(n // window)]
            if rest:
                start, key = n - rest, rest * (1 << 44) + rank
                at = int(np.searchsorted(placed_key, key, "right")) - 1
                row = placed[at] if at >= 0 else None
                if row is not None and row[0] == rest and rank < row[1] + row[2]:
                    k, again = divmod(rank - int(row[1]), int(row[4]))
                    pieces.append((start, rest, int(row[3]) + k, int(row[5]) + again * rest))
                else:
                    row = laid[int(np.searchsorted(laid_key, key, "right")) - 1]
                    at, done = int(row[3]) + (rank - int(row[1])) * rest, 0
                    while done < rest:
                        k, offset = divmod(at + done, window)
                        take = min(rest - done, window - offset)
                        pieces.append((start + done, take, int(row[4]) + k, offset))
                        done += take
            for start, length, sequence, offset in pieces:
                out.append((names[i], start, length, n, sequence, offset, data[4 * start : 4 * (start + length)]))
            if not out or len(out) < FLUSH and i + 1 < b.num_rows:
                continue
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            out = []


_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    With ``digests`` (then in the same tasks) the pieces' checksums stand for their ids: ids_crc32.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    coded = staged(rows.mapInArrow(freed(lambda it: _encoded(it, tokenizer, end_id, window)), _DOC), "ids")
    small = coded.select("part", "rest", F.expr(f"n_tokens div {window}").alias("full"))
    lengths = small.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    before = Window.partitionBy("rest").orderBy("part")
    bases = lengths.select("part", "rest", (F.sum("n").over(before) - F.col("n")).alias("base"))
    h = np.zeros(window, np.int64)
    for r in small.groupBy("rest").count().collect():  # at most ``window`` numbers
        h[r["rest"]] = r["count"]
    placed, laid, sequences = plan(h, window)
    # sequences of full windows are numbered after the others: by part (one row each), then by row
    parts = small.groupBy("part").agg(F.sum("full").alias("full"))
    parts = parts.select("part", (F.sum("full").over(Window.orderBy("part")) - F.col("full") + sequences).alias("part_fulls"))
    fulls = coded.filter(F.col("n_tokens") >= window).select("part", "seq", F.expr(f"n_tokens div {window}").alias("full"))
    fulls = fulls.withColumn("within", F.sum("full").over(Window.partitionBy("part").orderBy("seq")) - F.col("full"))
    fulls = fulls.join(parts, "part").select("part", "seq", (F.col("within") + F.col("part_fulls")).alias("fulls"))
    # only small rows are numbered; ids move once, by their row
    ranks = coded.select("part", "seq", "rest", "number").join(bases, ["part", "rest"]).select("part", "seq", (F.col("number") + F.col("base")).alias("rank"))
    ranks = ranks.join(fulls, ["part", "seq"], "left").select("part", "seq", "rank", F.coalesce("fulls", F.lit(0)).alias("fulls"))
    ranked = coded.join(ranks, ["part", "seq"]).select("doc_id", "n_tokens", "rest", "rank", "fulls", "ids")
    if digests:
        return ranked.mapInArrow(freed(lambda it: _with_crc(_pieces(it, placed, laid, window))), _DIGEST)
    return ranked.mapInArrow(freed(lambda it: _pieces(it, placed, laid, window)), _PIECE)


def _with_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in b.column(6)], pa.int64())
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), crc, *(b.column(i) for i in (3, 4, 5))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, digests=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
