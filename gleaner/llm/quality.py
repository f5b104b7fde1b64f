"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

1. ``describe`` turns each whole text into STATS numbers with vectorised byte counts; no label, language, source or
   id is among them.
2. ``learn`` describes labelled texts; ``fit`` grows BOOSTS trees of depth DEPTH on features cut into BINS quantile bins: at each level one weighted
   histogram of gradients over (node, feature, bin) gives every node's best split. It runs in numpy on at most FIT_ROWS
   labelled rows, those with the least hash of their id: the bound of the sample is a parameter.
3. Trees are full binary trees flattened into arrays (feature, threshold, leaf); ``Forest.score`` walks all rows of a
   batch down one level at a time. Texts are described and scored in one pass; no text is shuffled.

Edge cases: a null text counts as empty, and empty texts get a score like any other; labels other than 0 and 1, null
labels and labels of unknown rows teach nothing; a row with several labels teaches each; without labels of both
kinds the score is the share of label 1 (0.5 without any). A null id is scored, and never learnt from.
``with_score`` keeps further columns, and replaces one that is named like its result; ``classify`` ignores them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleaner.llm.common import documents, freed, in_stretches, staged

FIT_ROWS = 60_000
BOOSTS, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 2.0, 5

#: Names of the statistics, in order.
STATS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "upper", "digit", "blank", "dot", "comma", "pipe", "mark", "brace", "high", "exclaim",
    "line_words", "distinct_words", "top_word", "distinct_lines", "top_line", "short_words", "packed", "capital_words", "end_dot_lines", "marked_words", "long_words",
    "entropy", "pair_repeat", "worst_mark_window", "worst_upper_window", "worst_pipe_window",
)
#: Bytes of texts (or one text) that are Python objects at a time.
SLICE = 1 << 20
#: Bytes of a window whose worst share of marks counts.
PIECE = 512


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT, _BLANK = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(b"0123456789"), _table(b" \t\n\r\x0b\x0c")
_MARK = _table(b"#$%&*@^~=+\\/<>_")
_MARKED = _table(b"#$%&*!|")


def _windows(mask: np.ndarray) -> float:
    """The worst share of a window; the last window ends with the text."""
    n = len(mask) // PIECE
    return float(max(mask[: n * PIECE].reshape(n, PIECE).sum(axis=1).max(), mask[-PIECE:].sum()) / PIECE) if n else float(mask.mean())


def describe(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text."""
    if not text.strip():
        return [0.0] * len(STATS)
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    count = np.bincount(b, minlength=256)
    share = lambda table: float(count[table].sum()) / n
    words, lines = text.split(), text.split(b"\n")
    w = len(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    kinds: dict[bytes, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    line_kinds: dict[bytes, int] = {}
    for x in lines:
        line_kinds[x] = line_kinds.get(x, 0) + len(x)
    blank = _BLANK[b]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
    p = count[count > 0] / n
    full = [x for x in lines if x.strip()]
    pairs = len({*zip(words, words[1:], strict=False)}) / max(1, w - 1)
    return [
        np.log1p(n), np.log1p(w), np.log1p(len(lines)), n / w, share(_UPPER), share(_DIGIT), share(_BLANK), count[46] / n, count[44] / n, count[124] / n, share(_MARK),
        float(count[[91, 93, 123, 125, 40, 41]].sum()) / n, float(count[128:].sum()) / n, count[33] / n,
        w / len(full), len(kinds) / w, max(kinds.values()) / w, len(line_kinds) / len(lines), max(line_kinds.values()) / n, float((sizes <= 3).mean()),
        len(zlib.compress(text, 1)) / n, float(_UPPER[b[first]].mean()), sum(x.endswith((b".", b"!", b"?")) for x in full) / len(full), float(_MARKED[b[last]].mean()), float((sizes >= 12).mean()),
        float(-(p * np.log2(p)).sum()), 1 - pairs, _windows(_MARK[b]), _windows(_UPPER[b]), _windows(b == 124),
    ]


def _table_of(texts: pa.Array) -> np.ndarray:
    return np.array([describe(t) for t in pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()], np.float32).reshape(-1, len(STATS))


def _sliced(b: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes in a column of texts."""
    sizes = pc.fill_null(pc.binary_length(b.column(texts)), 0).to_numpy(zero_copy_only=False)
    for i, j in in_stretches(sizes, SLICE):
        yield b.slice(i, j - i)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for whole in batches for x in _sliced(whole, 2)):
        yield pa.record_batch([b.column(0), b.column(1), pa.array(list(_table_of(b.column(2))), pa.list_(pa.float32()))], ["id", "y", "x"])


@dataclass
class Forest:
    """Trees as arrays: feature and threshold by (tree, inner node), leaf value by (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):  # full trees: all rows reach the leaves together
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels 0 and 1."""
    share = float(y.mean()) if len(y) else 0.5
    empty = np.zeros((0, 0))
    if not len(y) or not 0 < share < 1:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Forest(empty.astype(np.int64), empty, empty, float(np.log(p / (1 - p))))
    base = float(np.log(share / (1 - share)))
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).astype(np.float32)  # (BINS - 1, features)
    code = np.stack([np.searchsorted(cuts[:, j], x[:, j], "left") for j in range(x.shape[1])], 1)
    features, inner = x.shape[1], 2**DEPTH - 1
    flat = code + np.arange(features) * BINS
    out_f, out_t, out_v, total = [], [], [], np.full(len(y), base)
    for _ in range(BOOSTS):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            at = ((node - first) * features * BINS)[:, None] + flat
            hist = [np.bincount(at.ravel(), np.repeat(v, features), nodes * features * BINS).reshape(nodes, features, BINS).cumsum(axis=2) for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (ga, ha, na) = hist, (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain = np.where((nl >= LEAST) & (na - nl >= LEAST), gain, 0.0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(nodes), best] > 1e-9
            f, c = np.where(good, best // BINS, 0), best % BINS
            feature[first : first + nodes] = f
            threshold[first : first + nodes] = np.where(good & (c < BINS - 1), cuts[np.minimum(c, BINS - 2), f], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        total += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Forest(np.array(out_f), np.array(out_t), np.array(out_v), base)


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fits on at most ``rows`` labelled rows whose crc32(id as text) mod 3 is not 1, those with the least hash of their id."""
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out("id")).distinct()
    order = (F.xxhash64("id"), "id", "y")
    # ids first, so that only texts of the sample are described; a top-k: no more than ``rows`` leave a task
    chosen = staged(known.join(named.select("id").distinct(), "id").orderBy(*order).limit(rows), "labelled")
    known_texts = named.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(freed(_described), "id long, y int, x array<float>")
    sample = known_texts.orderBy(*order).limit(rows).select("x", "y").toPandas()  # more than ``chosen`` only where ids repeat
    if not len(sample):
        return fit(np.zeros((0, len(STATS)), np.float32), np.zeros(0))
    return fit(np.stack(sample["x"].to_numpy()).astype(np.float32), sample["y"].to_numpy(float))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score", kept: list[str] | None = None) -> DataFrame:
    """``docs`` (of it, the columns ``kept``) with a score a row, learnt from ``labels`` by id."""
    forest = learn(docs, labels, id_col=id_col, text_col=text_col)
    kept = [c for c in kept or docs.columns if c != out_col]
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in _sliced(whole, 0)):
            yield pa.record_batch([*b.columns[1:], pa.array(forest.score(_table_of(b.column(0))))], [*b.schema.names[1:], "score"])

    out = rows.mapInArrow(freed(scored), StructType([*rows.schema.fields[1:], StructField("score", DoubleType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("score").alias(out_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, score, predicted."""
    found = with_score(docs.select(f"`{id_col}`", f"`{text_col}`"), labels, id_col, text_col, kept=[id_col])
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
