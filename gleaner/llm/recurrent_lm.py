"""Scores of texts by a gated recurrent language model with a class-factored output.

Tokens are the words of a text, A-Z lowered, and one end. Counts cover all training documents:
 - c(word), N and V by one grouped count; a batch's words are counted before the shuffle.
 - The FREQUENT most frequent words (or twice the lexicon) go to the workers. The counts of all other words reach the
   documents by a join on the word; only sums come back.

Model. P(token | text so far) = P(class | state) P(token | class, state). The most frequent tokens, kinds ** GROWTH of
them (LEXICON at least), fall into classes of like frequency, as many as the square root of their number, with a
softmax inside the class. All other words fall into SHAPES classes by how they are
written; inside such a class the chance of a word is (c + 1) / (sum of (c + 1) + 1), the last 1 for words never seen.
Classes are factored once more: P(class | state) = P(group | state) P(class | group, state).
So the chances of all words and one unknown a class sum to 1. The state is a GRU's, carried from window to window, and
starts anew with each text; a text's log-likelihood is over all its tokens.

Learning. All training documents are dealt to shards of SHARD_TOKENS tokens or, with a large lexicon, of as many bytes as the model has. Each learns by back-propagation through WINDOW steps from the common
start (unigram biases); the models are then averaged by Spark tasks, each piece of PIECE numbers by itself. A row of the
tables of inputs and of words weighs as many tokens as moved it in a shard (as input, or of its class), all else the shard's
tokens: what few shards learnt of a rare word isn't thinned out by those that never met it.

Scoring runs on LANES texts side by side, in lanes of nearly equal length, a window at a time; a lane that ends leaves the
windows after, so that one very long text costs its own tokens only.

Edge cases: a null text counts as empty: its only token is the end. Null ids count as training. Rows may share ids
(rows are told apart by id and digest of the text). Without training documents every word is unknown: N = 0, V = 0.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, dropped, freed, in_stretches, partitions, staged

LEXICON, GROWTH, FREQUENT = 2048, 0.75, 100_000
STATE, WINDOW, LANES = 24, 32, 512
SHARD_TOKENS, RATE = 1_500_000, 0.01
#: Numbers of a model in a row, so that no row, and no sort of them, grows with the model.
PIECE = 1 << 15
#: Outputs (rows by classes) that are handled at a time, so that they stay in the cache; rows of inputs that are moved at a time.
CELLS, ROWS = 1 << 17, 512
#: Words of a lexicon that are moved together.
MOVED = 2048
#: Uses of an input in a window from which its slopes are summed by themselves.
OFTEN = 16
#: Tokens whose outputs are scored together.
TOGETHER = 1 << 16
#: Steps of the optimiser that a shard makes at least before it uses more lanes.
UPDATES = 300
#: Logits are shifted where the exponentials of a row sum to more than this, or less than its inverse (float32 ends at 3e38).
FAR = 1e30
#: Bytes of text (or one text) whose words are objects at a time.
SLICE = 4 << 20
#: Frequent words that are sought in arrays; the others one at a time, so that no table of all is made for each slice.
SOUGHT = 1 << 18
END = b"\n"

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Shapes: last byte a-z by length (short, long), and digits, marks, bytes beyond ASCII.
SHAPES = 2 * 26 + 6


def shape(word: bytes) -> int:
    last = word[-1] - 97
    long = len(word) > 7
    if 0 <= last < 26:
        return last * 2 + long
    return 52 + (0 if 48 <= word[-1] < 58 else 2 if word[-1] < 128 else 4) + long


def _shape(token: bytes) -> int:
    """The shape of a word, or of the end."""
    return 52 if token == END else shape(token)


def _shapes(words: pa.Array) -> np.ndarray:
    """The shapes of many words, or ends (large binary)."""
    if not len(words):
        return np.zeros(0, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    last = np.frombuffer(words.buffers()[2], np.uint8)[at[1:] - 1].astype(np.int64)
    long = np.diff(at) > 7
    rest = np.select([last == END[0], (last >= 48) & (last < 58), last < 128], [0, 0, 2], 4)
    return np.where((last >= 97) & (last < 123), (last - 97) * 2, 52 + rest) + long


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_binary())


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has (binary, lowered), and the words of all."""
    parts = pc.ascii_split_whitespace(texts.view(pa.large_string()))
    words = parts.flatten().view(pa.large_binary())
    full = pc.greater(pc.binary_length(words), 0)
    at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    return np.diff(at), words.filter(full)


def _sliced(b: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[int, int]]:
    return in_stretches(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), most or SLICE)


def is_held_out(name: int | None) -> bool:
    return name is not None and zlib.crc32(str(name).encode()) % 7 == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the training texts of each batch."""
    for b in batches:
        for i, j in _sliced(b, 2 * SLICE):
            mine = pa.array([not is_held_out(name) for name in b.column(0).slice(i, j - i).to_pylist()], pa.bool_())
            some = _lowered(b.column(1).slice(i, j - i)).filter(mine)
            if len(some):
                kinds = pc.value_counts(_split(some)[1])
                words, n = pa.concat_arrays([kinds.field(0), pa.array([END], pa.large_binary())]), pa.concat_arrays([kinds.field(1), pa.array([len(some)], pa.int64())])
                yield pa.record_batch([words.cast(pa.binary()), n], ["word", "n"])


def lexicon_size(kinds: int) -> int:
    """Words with learnt inputs and outputs, by the number of different words."""
    return max(LEXICON, int(kinds**GROWTH))


def _parted(weight: np.ndarray, parts: int) -> np.ndarray:
    """Edges of stretches with nearly equal sums of weights, none of them empty."""
    share, each = np.cumsum(weight) if len(weight) else np.zeros(1), np.arange(parts + 1)
    edge = np.searchsorted(share, share[-1] * each / max(parts, 1))
    edge = np.minimum(np.maximum.accumulate(edge - each) + each, len(weight) - parts + each)
    edge[0], edge[-1] = 0, len(weight)
    return edge


class Lexicon:
    """The frequent words with their counts, the classes, and what must be known of all other words."""

    def __init__(self, frequent: list[tuple[bytes, int]], tokens: int, kinds: int, shapes: dict[int, tuple[int, int]]):
        """frequent: by falling count; shapes: (sum of counts, words) of each shape over all words but the first, the lexicon."""
        self.tokens, self.kinds = tokens, kinds
        top = frequent[: lexicon_size(kinds)]
        self.size = len(top)
        self.count = np.array([c for _, c in frequent], np.float64)
        self.sought = pa.array([w for w, _ in frequent[:SOUGHT]], pa.large_binary())
        self.code = {w: i for i, (w, _) in enumerate(frequent)}
        # classes of the first words, by falling count: of equal sums of the counts' roots, so that frequent words are in small ones
        self.classes = max(1, int(round(self.size**0.5))) if self.size else 0
        self.edge = _parted(np.sqrt(self.count[: self.size]), self.classes)
        self.cls = np.repeat(np.arange(self.classes), np.diff(self.edge))
        total = np.zeros(SHAPES)
        for s, (c, w) in shapes.items():
            total[s] = c + w
        self.rest = total + 1  # the inner sum of a shape's class
        self.outputs = self.classes + SHAPES
        mass = np.concatenate([np.add.reduceat(self.count[: self.size], self.edge[:-1]) if self.size else np.zeros(0), self.rest])
        self.class_bias = np.log(mass / mass.sum())
        # the same of classes, which fall into groups
        self.groups = int(round(self.outputs**0.5))
        self.group_edge = _parted(np.sqrt(mass), self.groups)
        self.group = np.repeat(np.arange(self.groups), np.diff(self.group_edge))
        self.group_bias = np.log(np.add.reduceat(mass, self.group_edge[:-1]) / mass.sum())
        self.word_bias = np.log(self.count[: self.size] / mass[self.cls]) if self.size else np.zeros(0)
        self.log_count = np.log10(self.count + 1)
        self.log_rest = np.log10(self.rest)
        self.shapes = np.array([_shape(w) for w, _ in frequent], np.int16)

    def coded(self, words: pa.Array) -> np.ndarray:
        """Place of each word among the frequent ones, or -1 - shape; each kind that isn't sought in arrays is looked up once."""
        codes = pc.fill_null(pc.index_in(words, value_set=self.sought), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        missed = np.flatnonzero(codes < 0)
        kinds = words.take(pa.array(missed)).dictionary_encode()
        of_kind = -1 - _shapes(kinds.dictionary).astype(np.int32)
        if len(self.code) > len(self.sought):
            of_kind = np.array([self.code.get(w, c) for w, c in zip(kinds.dictionary.to_pylist(), of_kind.tolist(), strict=True)], np.int32)
        codes[missed] = of_kind[kinds.indices.to_numpy()]
        return codes


class Softmaxes:
    """Rows of outputs, each over the stretch of ``edge`` that it is in; rows come by stretch, ``at`` says where each begins."""

    def __init__(self, x: np.ndarray, w: np.ndarray, at: list[int], edge: np.ndarray, out: np.ndarray):
        """Logits are x @ w.T, the last column of both being ones and biases; out: the output that came, of all outputs."""
        n, width = np.diff(at), np.diff(edge)
        self.x, self.w = x, w.T
        self.edge, self.at = edge.tolist(), at
        self.begin = np.concatenate([[0], np.cumsum(np.repeat(width, n))])
        self.own = self.begin[:-1] + out - np.repeat(edge[:-1], n)
        self.space = np.empty(0, np.float32)

    def parts(self, cells: int, rows: bool = True) -> Iterator[list[tuple[int, int, int, int]]]:
        """Blocks (rows, and where their outputs lie) that follow one another, so many cells at a time, or one block. Small ones
        share the calls that need no table. ``rows``: a stretch's rows may be cut into several blocks."""
        some: list[tuple[int, int, int, int]] = []
        n = 0
        for c in np.flatnonzero(np.diff(self.at)).tolist():
            i, last, lo, hi = self.at[c], self.at[c + 1], self.edge[c], self.edge[c + 1]
            size = hi - lo
            step = max(1, cells // size) if rows else last - i
            while i < last:
                j = i + step if i + step < last else last
                n += (j - i) * size
                if n > cells and some:
                    yield some
                    some, n = [], (j - i) * size
                some.append((i, j, lo, hi))
                i = j
        if some:
            yield some

    def exponentials(self, blocks: list[tuple[int, int, int, int]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """A table of each block, the sums by row, the logits of what came, and where these lie in ``space``.

        Where exponentials would overflow or vanish, all is less each row's largest logit.
        """
        i, j = blocks[0][0], blocks[-1][1]
        start = int(self.begin[i])
        size = int(self.begin[j]) - start
        if len(self.space) < size:
            self.space = np.empty(size, np.float32)
        flat, begin, own, tables = self.space[:size], self.begin[i:j] - start, self.own[i:j] - start, []
        n = 0
        for a, b, lo, hi in blocks:
            end = n + (b - a) * (hi - lo)
            tables.append(flat[n:end].reshape(b - a, hi - lo))
            n = end

        def fill() -> None:
            for (a, b, lo, hi), f in zip(blocks, tables, strict=True):
                self.x[a:b].dot(self.w[:, lo:hi], f)

        fill()
        picked = flat[own]
        total = np.add.reduceat(np.exp(flat, out=flat), begin)
        if not (total.min() > 1 / FAR and total.max() < FAR):
            fill()
            most = np.maximum.reduceat(flat, begin)
            flat -= np.repeat(most, np.diff(self.begin[i : j + 1]))
            picked -= most
            total = np.add.reduceat(np.exp(flat, out=flat), begin)
        return tables, total, picked, own

    def slopes(self, blocks: list[tuple[int, int, int, int]], scale: np.float32) -> tuple[list[np.ndarray], np.ndarray]:
        """The logits' slopes but for a row's share, which comes last, so that it meets STATE numbers and not all outputs."""
        tables, total, _, own = self.exponentials(blocks)
        self.space[own] -= total
        return tables, (scale / total)[:, None]


def _and_one(x: np.ndarray) -> np.ndarray:
    """``x`` with a column of ones, by which a product with a bias below (or beside) its weights adds it."""
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)


class Model:
    """A GRU whose inputs are rows of a table (the lexicon's words, shapes, start), with numpy arrays as parameters."""

    def __init__(self, lexicon: Lexicon, seed: int = 7):
        rng, h = np.random.default_rng(seed), STATE
        k = lexicon.size
        normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"x": normal(k + SHAPES + 1, 3 * h), "u": normal(h, 3 * h), "c": normal(h, lexicon.outputs), "cb": lexicon.class_bias.astype(np.float32), "w": normal(k, h), "wb": lexicon.word_bias.astype(np.float32)}
        self.p |= {"g": normal(lexicon.groups, h), "gb": lexicon.group_bias.astype(np.float32)}
        self.l = lexicon

    @np.errstate(over="ignore")  # of exponentials that a chance of 0 comes from
    def step(self, x: np.ndarray, s: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The next states (in ``out``), and what their slopes are made of."""
        h, u = STATE, self.p["u"]
        zr, gn = s @ u[:, : 2 * h], s @ u[:, 2 * h :]
        zr += x[:, : 2 * h]
        np.negative(zr, out=zr)  # 1 / (1 + exp(-x)), whose exponential takes half as long as a tanh
        np.exp(zr, out=zr)
        zr += np.float32(1)
        np.divide(np.float32(1), zr, out=zr)
        z, r = zr[:, :h].copy(), zr[:, h:].copy()  # whole arrays are quicker than columns
        n = r * gn
        n += x[:, 2 * h :]
        np.tanh(n, out=n)
        new = np.subtract(s, n, out=out)
        new *= z
        new += n
        return new, z, r, n, gn

    @np.errstate(over="ignore")  # see Softmaxes.exponentials
    def log_probs(self, states: np.ndarray, out_class: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log of P(class) P(word | class) for each row (word -1: P(class) only); P(class) = P(group) P(class | group)."""
        lex = self.l
        order, of_group, of_class = self.by_class(out_class)
        x, cls = _and_one(states[order]), out_class[order]
        chances = np.zeros(len(x))

        def add(w: np.ndarray, at: list[int], edge: np.ndarray, out: np.ndarray) -> None:
            rows = Softmaxes(x, w, at, edge, out)
            for blocks in rows.parts(CELLS):
                _, total, picked, _ = rows.exponentials(blocks)
                chances[blocks[0][0] : blocks[-1][1]] += picked - np.log(total)

        add(np.column_stack([self.p["g"], self.p["gb"]]), [0, len(x)], np.array([0, lex.groups]), lex.group[cls])
        add(np.column_stack([self.p["c"].T, self.p["cb"]]), of_group, lex.group_edge, cls)
        if lex.size:
            add(np.column_stack([self.p["w"], self.p["wb"]]), of_class, lex.edge, word[order[: of_class[-1]]])
        total = np.empty(len(x))
        total[order] = chances
        return total

    def by_class(self, out_class: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        """The rows in the order of their classes, and where each group and each class of words begins and ends."""
        order = np.argsort(out_class.astype(np.int16 if self.l.outputs < 1 << 15 else np.int32), kind="stable")
        cls = out_class[order]
        return order, np.searchsorted(cls, self.l.group_edge).tolist(), np.searchsorted(cls, np.arange(self.l.classes + 1)).tolist()


def _sums(x: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the sum of the rows of each."""
    order = np.argsort(key, kind="stable")
    key, x = key[order], np.take(x, order, axis=0)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[at, len(key)])
    out = x[at]
    few = np.flatnonzero((n > 1) & (n < OFTEN))
    for k in range(1, OFTEN - 1):  # the second rows of all, then the third
        few = few[n[few] > k]
        out[few] += x[at[few] + k]
    ones = np.ones(int(n.max()), x.dtype)
    for i in np.flatnonzero(n >= OFTEN).tolist():
        np.dot(ones[: n[i]], x[at[i] : at[i] + n[i]], out=out[i])
    return key[at], out


def _lanes(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to lanes so that the lanes' total lengths are nearly equal: longest first, to the shortest lane."""
    heap = [(0, i) for i in range(max(1, min(lanes, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, lane = heap[0]
        heapq.heapreplace(heap, (n + int(lengths[i]), lane))
        out[lane].append(i)
    return out


def _windows(codes: list[np.ndarray], shapes: list[np.ndarray], lanes: list[list[int]], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(steps, lanes) tables of a window at a time: code, shape, owner (-1: none), whether a text starts.

    Lanes come longest first, and a window has only those that go on: the later ones of the window before have ended.
    So memory and work follow the tokens, however unequal the texts are.
    """
    length = np.array([sum(len(codes[i]) for i in lane) for lane in lanes])
    lanes = [lanes[j] for j in np.argsort(-length, kind="stable")]
    length = -np.sort(-length)
    order = [i for lane in lanes for i in lane]
    flat = [np.concatenate([x[i] for i in order]) for x in (codes, shapes)]
    sizes = np.array([len(codes[i]) for i in order])
    owner = np.repeat(np.array(order, np.int32), sizes)
    start = np.zeros(len(owner), bool)
    start[np.cumsum(sizes) - sizes] = True
    base = np.cumsum(length) - length
    for t0 in range(0, int(length[0]), window):
        live = int(np.searchsorted(-length, -t0, "left"))
        t = np.arange(t0, min(t0 + window, int(length[0])))[:, None]
        there = t < length[:live]
        at = np.where(there, base[:live] + t, 0)
        yield np.where(there, flat[0][at], -1), np.where(there, flat[1][at], 0).astype(np.int32), np.where(there, owner[at], -1), there & start[at]


def _with_shapes(lexicon: Lexicon, code: np.ndarray) -> np.ndarray:
    """Shapes of the tokens outside the lexicon (0 inside)."""
    known = lexicon.shapes[np.maximum(code, 0)] if len(lexicon.shapes) else np.zeros(len(code), np.int16)
    return np.where(code < 0, -1 - code, np.where(code >= lexicon.size, known, 0)).astype(np.int16)


def scored(model: Model, codes: list[np.ndarray], shapes: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log of the class and word chances of each text (shape classes: of the class alone)."""
    if not codes:
        return np.zeros(0)
    lex, k = model.l, model.l.size
    lanes_of = _lanes(np.array([len(c) for c in codes]), lanes)
    total = np.zeros(len(codes))
    s = np.zeros((len(lanes_of), STATE), np.float32)
    before = np.full(len(lanes_of), k + SHAPES)
    waiting: list[tuple[np.ndarray, ...]] = []  # outputs need no order: those of windows with few lanes wait for others
    n = 0

    def outputs() -> None:
        if waiting:
            owner, *some = (np.concatenate(x) for x in zip(*waiting, strict=True))
            total[:] += np.bincount(owner, model.log_probs(*some), len(codes))
            waiting.clear()

    for code, shp, owner, start in _windows(codes, shapes, lanes_of, WINDOW):
        live = code.shape[1]
        s, before = s[:live], before[:live]
        inside, out_class, rows = _targets(lex, code, shp)
        states = np.empty((len(code), live, STATE), np.float32)
        for t in range(len(code)):
            if start[t].any():
                s = np.where(start[t][:, None], np.float32(0), s)
                before = np.where(start[t], k + SHAPES, before)
            s = model.step(np.take(model.p["x"], before, axis=0), s, states[t])[0]
            before = rows[t]
        real = np.flatnonzero(owner.ravel() >= 0)
        waiting.append((owner.ravel()[real], states.reshape(-1, STATE)[real], out_class.ravel()[real], np.where(inside, code, -1).ravel()[real]))
        n += len(real)
        if n >= TOGETHER:
            outputs()
            n = 0
    outputs()
    return total


def _targets(lex: Lexicon, code: np.ndarray, shp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether tokens are in the lexicon, their output classes, and their input rows."""
    inside = (code >= 0) & (code < lex.size)
    out_class = np.where(inside, lex.cls[np.where(inside, code, 0)] if lex.size else 0, lex.classes + shp)
    return inside, out_class, np.where(inside, code, lex.size + shp)


@np.errstate(over="ignore")  # see Softmaxes.exponentials
def learnt(model: Model, codes: list[np.ndarray], shapes: list[np.ndarray], lanes: int | None = None) -> None:
    """One pass of truncated back-propagation through time over the texts, by Adam; of the tables, rows in use are moved."""
    if not codes:
        return
    lanes = lanes or int(np.clip(sum(map(len, codes)) // (WINDOW * UPDATES), 8, LANES))
    lex, k, h = model.l, model.l.size, STATE
    lanes_of = _lanes(np.array([len(c) for c in codes]), lanes)
    # weights lie in one array with their biases while they are learnt
    whole = model.p
    model.p = {"x": whole["x"], "u": whole["u"], "c": np.vstack([whole["c"], whole["cb"]]).T.copy(), "w": np.hstack([whole["w"], whole["wb"][:, None]]), "g": np.hstack([whole["g"], whole["gb"][:, None]])}
    # Adam's moments: of slopes, and of their squares, ten times as large and never 0
    m1 = {n: np.zeros_like(v) for n, v in model.p.items()}
    m2 = {n: np.full_like(v, 1e-15) for n, v in model.p.items()}

    def move(name: str, at: slice | np.ndarray, v: np.ndarray) -> None:
        """A step of Adam; v: a tenth of the slopes."""
        a, b, p = m1[name][at], m2[name][at], model.p[name]
        a *= np.float32(0.9)
        a += v
        v *= v
        b *= np.float32(0.999)
        b += v
        np.sqrt(b, out=v)
        np.divide(a, v, out=v)
        v *= np.float32(rate * 10**0.5)
        if not isinstance(at, slice):  # a and b are copies
            m1[name][at], m2[name][at] = a, b
        p[at] -= v

    slope = np.empty((max(MOVED, int(np.diff(lex.edge).max(initial=0))), h + 1), np.float32)

    s, before, done = np.zeros((len(lanes_of), h), np.float32), np.full(len(lanes_of), k + SHAPES), 0
    windows = -(-max(sum(len(codes[i]) for i in lane) for lane in lanes_of) // WINDOW)
    for code, shp, owner, start in _windows(codes, shapes, lanes_of, WINDOW):
        p, live = model.p, code.shape[1]
        s, before = s[:live], before[:live]
        inside, out_class, rows = _targets(lex, code, shp)
        kept, states = [], np.empty((len(code), live, h), np.float32)
        for t in range(len(code)):
            if (new_text := start[t].any()):
                s = np.where(start[t][:, None], np.float32(0), s)
                before = np.where(start[t], k + SHAPES, before)
            new, z, r, n, gn = model.step(np.take(p["x"], before, axis=0), s, states[t])
            kept.append((before, s, z, r, n, gn, start[t] if new_text else None))
            s, before = new, rows[t]
        states = states.reshape(-1, h)
        real = np.flatnonzero(owner.ravel() >= 0)
        done += 1
        rate = RATE * (1 - 0.9 * done / windows) * (1 - 0.999**done) ** 0.5 / (1 - 0.9**done)
        scale = np.float32(0.1 / len(real))
        order, of_group, of_class = model.by_class(out_class.ravel()[real])
        real = real[order]
        x, cls, word = _and_one(states[real]), out_class.ravel()[real], code.ravel()[real]
        g = {n: np.zeros_like(p[n]) for n in ("c", "g")}
        dx = np.empty_like(x)
        for name, at, edge, out in (("g", [0, len(x)], np.array([0, lex.groups]), lex.group[cls]), ("c", of_group, lex.group_edge, cls)):
            soft = Softmaxes(x, p[name], at, edge, out)
            for blocks in soft.parts(CELLS):
                tables, share = soft.slopes(blocks, scale)
                first = blocks[0][0]
                for (i, j, lo, hi), f in zip(blocks, tables, strict=True):
                    f *= share[i - first : j - first]  # fewer numbers than the products have
                    if name == "g":
                        f.dot(p[name], dx[i:j])
                    else:
                        dx[i:j] += f.dot(p[name][lo:hi])
                    g[name][lo:hi] += f.T.dot(x[i:j])
        n = of_class[-1]  # rows of the lexicon's words come first
        w, most = p["w"], len(slope)
        soft = Softmaxes(x[:n], w, of_class, lex.edge, word[:n])
        shares, back = np.empty((n, 1), np.float32), np.empty((n, h + 1), np.float32)
        begun = ended = 0
        for blocks in soft.parts(CELLS, rows=False):
            tables, share = soft.slopes(blocks, scale)
            first = blocks[0][0]
            shares[first : blocks[-1][1]] = share
            shared = x[first : blocks[-1][1]] * share
            for (i, j, lo, hi), f in zip(blocks, tables, strict=True):
                f.dot(w[lo:hi], back[i:j])
                if lo != ended or hi - begun > most:  # words of adjoining classes are moved together, when all that read them are done
                    move("w", slice(begun, ended), slope[: ended - begun])
                    begun = lo
                ended = hi
                f.T.dot(shared[i - first : j - first], slope[lo - begun : hi - begun])
        move("w", slice(begun, ended), slope[: ended - begun])
        back *= shares
        dx[:n] += back
        full = np.zeros_like(states)
        full[real] = dx[:, :h]
        full = full.reshape(len(kept), -1, h)
        ds = np.zeros_like(s)
        # slopes of what the gates and the candidate are made of; of what the state adds to the candidate
        inner, dgn = np.empty((len(kept), live, 3 * h), np.float32), np.empty((len(kept), live, h), np.float32)
        by_gates, by_candidate = p["u"][:, : 2 * h].T, p["u"][:, 2 * h :].T
        for i in range(len(kept) - 1, -1, -1):
            _, s0, z, r, n, gn, new_text = kept[i]
            d = full[i] + ds
            keep = 1 - z
            dn = d * keep
            more = n * n
            np.subtract(1, more, out=more)
            dn *= more
            keep *= z
            keep *= d
            np.subtract(s0, n, out=more)
            at = inner[i]
            np.multiply(keep, more, out=at[:, :h])
            np.multiply(dn, r, out=dgn[i])
            np.subtract(1, r, out=more)
            more *= gn
            np.multiply(more, dgn[i], out=at[:, h : 2 * h])
            at[:, 2 * h :] = dn
            d *= z
            d += at[:, : 2 * h] @ by_gates
            d += dgn[i] @ by_candidate
            ds = d if new_text is None else np.where(new_text[:, None], np.float32(0), d)
        inner = inner.reshape(-1, 3 * h)
        read = np.concatenate([x[1] for x in kept]).T
        g["u"] = np.concatenate([read @ inner[:, : 2 * h], read @ dgn.reshape(-1, h)], axis=1)
        used, moved = _sums(inner, np.concatenate([x[0] for x in kept]))
        for i in range(0, len(used), ROWS):
            move("x", used[i : i + ROWS], moved[i : i + ROWS])
        for name, v in g.items():
            move(name, slice(None), v)
    p = model.p
    back = {"c": p["c"][:, :-1].T.copy(), "cb": p["c"][:, -1].copy(), "w": p["w"][:, :-1].copy(), "wb": p["w"][:, -1].copy()}
    back |= {"g": p["g"][:, :-1].copy(), "gb": p["g"][:, -1].copy()}
    model.p = whole | back


def _texts(lexicon: Lexicon, texts: list[bytes] | pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """Codes and shapes of each text's words and its end; the words of all, without ends."""
    n, words = _split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary()))
    codes = np.insert(lexicon.coded(words), np.cumsum(n), np.int32(lexicon.code.get(END, -1 - 52)))
    cut = np.cumsum(n + 1)[:-1]
    return np.split(codes, cut), np.split(_with_shapes(lexicon, codes), cut), words


def _shape_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            shapes = _shapes(b.column(0).cast(pa.large_binary()))
            n = np.bincount(shapes, b.column(1).to_numpy().astype(float), SHAPES).astype(np.int64)
            yield pa.record_batch([pa.array(np.arange(SHAPES)), pa.array(n), pa.array(np.bincount(shapes, minlength=SHAPES))], ["shape", "n", "kinds"])


def lexicon_of(counts: DataFrame) -> Lexicon:
    """From the staged counts (word, n): the frequent words and SHAPES sums reach the driver."""
    tokens, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    # the least count that keeps the words at or above it within the bound
    below, least, most = 0, 1, max(FREQUENT, 2 * lexicon_size(kinds))
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most + 1).collect():
        below, least = below + r["words"], r["n"] + 1 if below + r["words"] > most else r["n"]
        if below > most:
            break
    found = counts.filter(F.col("n") >= least).toPandas()
    frequent = sorted(zip(map(bytes, found["word"]), found["n"].tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    sums = counts.mapInArrow(freed(_shape_sums), "shape long, n long, kinds long").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()
    shapes = {r["shape"]: [r["n"], r["kinds"]] for r in sums}
    for w, c in frequent[: lexicon_size(kinds)]:
        s = shapes[_shape(w)]
        s[0], s[1] = s[0] - c, s[1] - 1
    return Lexicon(frequent, tokens or 0, kinds, {k: tuple(v) for k, v in shapes.items()})


def _met(lex: Lexicon, codes: list[np.ndarray], shapes: list[np.ndarray]) -> dict[str, np.ndarray]:
    """How many tokens moved each row of the tables that ``learnt`` moves by rows: inputs, and words (by their class)."""
    code, shp, ends = np.concatenate(codes), np.concatenate(shapes).astype(np.int32), np.cumsum([len(c) for c in codes]) - 1
    inside, _, rows = _targets(lex, code, shp)
    # a text's first input is the start, its last token is no input
    inputs = np.bincount(rows, minlength=lex.size + SHAPES + 1) - np.bincount(rows[ends], minlength=lex.size + SHAPES + 1)
    inputs[-1] += len(ends)
    words = np.bincount(lex.cls[code[inside]], minlength=lex.classes)[lex.cls] if lex.size else np.zeros(0)
    return {"x": inputs, "w": words, "wb": words}


def _pieces(p: dict[str, np.ndarray]) -> Iterator[tuple[str, int, np.ndarray]]:
    """A model's numbers in its parameters' order, PIECE at most at a time and whole rows, as views: parameter, first row, rows."""
    for name, v in p.items():
        step = max(1, PIECE // (v[:1].size or 1))
        for i in range(0, len(v), step):
            yield name, i, v[i : i + step]


#: The weight of a row that no token of a shard moved: without others, the row stays as it began.
UNMOVED = 1e-6


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by piece: the mean of each of its rows over all models, by the rows' weights."""
    now, total, weight = None, np.zeros((0, 0)), np.zeros(0)

    def mean() -> pa.RecordBatch:
        return pa.record_batch([pa.array([now], pa.int64()), pa.array([(total / weight[:, None]).astype(np.float32).tobytes()], pa.binary())], ["piece", "numbers"])

    for b in batches:
        for piece, w, data in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
            w = np.frombuffer(w.as_buffer(), np.float64)
            x = np.frombuffer(data.as_buffer(), np.float32).reshape(len(w), -1)
            if piece != now:
                if now is not None:
                    yield mean()
                now, total, weight = piece, np.zeros(x.shape), np.zeros(len(w))
            total += x * w[:, None]
            weight += w
    if now is not None:
        yield mean()


def train(docs: DataFrame, lexicon: Lexicon) -> Model:
    """The averaged model of all shards; docs: id, text."""
    sc = docs.sparkSession.sparkContext
    mine = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    mine = docs.filter(mine).withColumn("text", F.coalesce("text", F.lit("")))
    chars = mine.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    model = Model(lexicon)
    if not chars or not lexicon.size:
        return model
    shards = int(-(-chars // max(6 * SHARD_TOKENS, sum(v.nbytes for v in model.p.values()))))
    start = sc.broadcast(lexicon)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        shapes: list[np.ndarray] = []
        shard = 0
        for b in batches:
            for i, j in _sliced(b):
                c, s, _ = _texts(start.value, _lowered(b.column(1).slice(i, j - i)))
                codes.extend(c)
                shapes.extend(s)
            shard = b.column(0)[0].as_py() if b.num_rows else shard
        if codes:
            m = Model(start.value)
            learnt(m, codes, shapes)
            met, every = _met(start.value, codes, shapes), float(sum(map(len, codes)))
            for k, (name, first, x) in enumerate(_pieces(m.p)):
                weight = np.maximum(met[name][first : first + len(x)], UNMOVED) if name in met else np.full(len(x), every)
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([shard], pa.int64()), pa.array([weight.astype(np.float64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["piece", "shard", "weights", "numbers"])

    dealt = mine.select(F.pmod(F.xxhash64("text", "id"), F.lit(shards)).alias("shard"), "text", "id")
    # by number, not by its hash, which gave some tasks several shards and others none
    dealt = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "id", F.xxhash64("text")).select("shard", "text")
    # small row groups: readers and writers hold one at a time
    models = staged(dealt.mapInArrow(freed(learn), "piece long, shard long, weights binary, numbers binary"), "models", **{"parquet.block.size": str(8 << 20)})
    sorted_pieces = models.repartition(partitions(docs.sparkSession), "piece").sortWithinPartitions("piece", "shard")
    mean = staged(sorted_pieces.mapInArrow(freed(_averaged), "piece long, numbers binary"), "mean", **{"parquet.block.size": str(8 << 20)})
    places = [x for _, _, x in _pieces(model.p)]
    for r in mean.toLocalIterator():
        places[r["piece"]][:] = np.frombuffer(r["numbers"], np.float32).reshape(places[r["piece"]].shape)
    dropped(models, mean)
    start.unpersist()
    return model


_SCORED = "id long, held_out boolean, n_tokens long, known long, counts double, chances double, rare array<binary>"


def _of_batch(m: Model, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Scores and words that aren't frequent of a batch of (id, text).

    Words are split a slice at a time; all texts are scored side by side, so that the longest runs along with many others.
    """
    lex = m.l
    parts = [(b.column(0).slice(i, j - i), *_texts(lex, _lowered(b.column(1).slice(i, j - i)))) for i, j in _sliced(b)]
    every = scored(m, [c for x in parts for c in x[1]], [s for x in parts for s in x[2]]) / np.log(10)
    ends = np.cumsum([len(x[1]) for x in parts])
    for (names, codes, shapes, words), end in zip(parts, ends.tolist(), strict=True):
        chances = every[end - len(codes) : end]
        n = np.array([len(c) for c in codes])
        c, s, owner = np.concatenate(codes), np.concatenate(shapes), np.repeat(np.arange(len(n)), n)
        frequent, outside = c >= 0, (c < 0) | (c >= lex.size)
        plain = lex.log_count[np.maximum(c, 0)] * frequent if len(lex.log_count) else np.zeros(len(c))
        counted, found = np.bincount(owner, plain, len(n)), np.bincount(owner, frequent, len(n)).astype(np.int64)
        chances += np.bincount(owner, np.where(outside, plain - lex.log_rest[s], 0), len(n))
        # of the words that aren't frequent; a text's end is the last of its tokens
        at = np.flatnonzero(~frequent)
        last = np.cumsum(n) - 1
        words = pa.concat_arrays([words, pa.array([END], pa.large_binary())]).take(pa.array(np.where(at == last[owner[at]], len(words), at - owner[at])))
        rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(n)))]), pa.int32()), words.cast(pa.binary()))
        held = [is_held_out(name) for name in names.to_pylist()]
        yield pa.record_batch([names, pa.array(held), pa.array(n, pa.int64()), pa.array(found), pa.array(counted), pa.array(chances), rare], ["id", "held_out", "n_tokens", "known", "counts", "chances", "rare"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = staged(docs.mapInArrow(freed(_counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    lexicon = lexicon_of(counts)
    model = train(docs, lexicon)
    known = sc.broadcast((lexicon, model.p))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p = known.value
        m = Model.__new__(Model)
        m.p, m.l = p, lex
        for b in batches:
            yield from _of_batch(m, b)

    rows = staged(docs.mapInArrow(freed(each), _SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("word")).groupBy("word", "row").agg(F.count("*").alias("times"))
    sums = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    out = rows.drop("rare").join(sums, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    base = float(np.log10(lexicon.tokens + lexicon.kinds + 1))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("counts") + F.col("more") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("chances") + F.col("more")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
