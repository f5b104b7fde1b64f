"""Near duplicates by Jaccard similarity of word shingles: parity sketches joined by the pigeonhole principle.

Sketch. The hash space is cut into k blocks; a set's sketch has one 64-bit parity word a block, the XOR of the hashes
that fall into it. A token changes one word only, so the number of words in which two sketches differ is at most the
size of the symmetric difference: it is a lower bound of it.

Join. Sets with similarity t = NUM / DEN or more differ in at most (|A| + |B|) (1 - t) / (1 + t) tokens. Sizes are banded
by powers of two, with k so that the non-empty words of a set outnumber the most tokens D in which a partner of the
band can differ; a set also joins the next band if a partner could be there. Then two similar sets agree in at least
(words - D) of the words of either, so by the pigeonhole principle they share one of any D + 1 words of each, taken in
one global order. The order is by frequency: rare words first. A set's words that no other set has come first of all
and join nothing; a set with D + 1 of them has no partner and is done. A passage that thousands of documents share is
frequent, so it brings no pairs. Sets whose words don't outnumber D ("weak", a few in a hundred thousand) also join a
finer sketch, where needed one of single tokens, so no link is lost.

Frequencies. A task gathers its words in bins of BIN; a bin sends to each slice of the key space a blob of its keys,
a key that occurs again and again in the bin once, with its count. A slice sums the counts of its keys and answers
each bin with those that two or more sets have; the bin then picks the D + 1 words of its sets. So two blobs travel
for each bin and slice instead of a row for each word, and a word that all texts share is one entry a bin.

Verification is on whole sets. Before it, sketches of one parity bit a token (as many bits as twice the set's size)
drop pairs whose Hamming distance, again a lower bound, already exceeds the bound.

Groups. Sets that are equal are one class. In the group of a word all members are paired with one hub, not with
each other; verified pairs are contracted to components. In groups whose members are still apart, members are paired
with the hub that has most links so far, for as long as that finds links. What is then still apart is compared
exactly: in groups up to GROUP, all open pairs; in larger ones members of the smaller components with those of larger
ones, in tiles, first by parity bits, which leave the rows that may have a link, then by whole sets. Only links leave a
tile, as few as connect what is linked. No set is left out, and no task holds a group.

Scale. About 0.7 of each distinct shingle is sent, in some 8 bytes; texts aren't shuffled. Only counts reach the driver.

Edge cases: a null text counts as empty; a text without words has no shingles and no links; shorter texts than WORDS
words are one shingle. Null or repeated ids are allowed: each row is reported, and links hold between rows. Sets are
told apart by 128-bit digests. ``docs`` must give the same rows whenever it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import attach_group, documents, dropped, freed, partitions, scratch, staged
from gleaner.llm.graph import components, contracted
from gleaner.llm.shingles import Sets, in_chunks, mix

NUM, DEN = 75, 100
#: Band 0 holds sets below LOWEST tokens, joined token by token; band i those from LOWEST * 2^(i-1) on.
LOWEST, LOAD = 64, 2.4
#: Words in a bin of a task, and expected in a slice of the key space.
BIN, SLICE = 1 << 19, 1 << 19
#: Largest group whose open pairs are listed; larger ones go by tiles.
GROUP, TILE, SIDE = 24, 256, 8192
#: The same where whole sets are compared, in tokens of all sets together.
TILE_TOKENS, SIDE_TOKENS = 1 << 17, 1 << 21
#: Keys of a set that are compared to find a pair's smallest common one.
KEYS = 64
#: Rounds of new hubs at most, before what is left is compared exactly.
ROUNDS = 4
#: Pairs that share a copy of their hub's set when verified.
HUB = 256
#: Ids to be broadcast at most (16 bytes each).
BROADCAST_IDS = 500_000

_U = np.uint64
_OFTEN = 0xFFFF  # stands for the owners of a key that a bin has several times


def bound(a, b):
    """Most tokens in which similar sets of these sizes can differ."""
    return ((a + b) * (DEN - NUM)) // (DEN + NUM)


def _largest_partner(n: np.ndarray) -> np.ndarray:
    return n * DEN // NUM


def _band(n: np.ndarray) -> np.ndarray:
    return np.where(n < LOWEST, 0, np.floor(np.log2(np.maximum(n, 1) / LOWEST)).astype(np.int64) + 1)


def _blocks(band: np.ndarray, finer: int) -> np.ndarray:
    """Blocks of a band's sketch; 0 stands for one block a token."""
    k = np.ceil(LOWEST * 2.0**band / LOAD).astype(np.int64) * finer
    return np.where(band == 0, 0, k)


def _words(s: Sets, rows: np.ndarray, k: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty sketch words of the sets ``rows`` with ``k`` blocks each: (keys, position in rows, words a row)."""
    sizes = s.sizes[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(owner)) + np.repeat(s.at[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    h = s.hashes[at]
    blocks = k[owner].astype(np.uint64)
    block = np.where(blocks > 0, ((h >> _U(32)) * blocks) >> _U(32), h)
    first = np.ones(len(h), bool)
    first[1:] = (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    word = np.bitwise_xor.reduceat(mix(h + _U(0x9E3779B97F4A7C15)), at) if len(at) else np.zeros(0, np.uint64)
    own = owner[at]
    return mix(word + mix(block[at] ^ (level[own].astype(np.uint64) << _U(56)))), own, np.bincount(own, minlength=len(rows))


def _levels(s: Sets, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All sketches that the sets ``rows`` (non-empty) join: (keys, place of their set), and (sets, their words, most that differ)."""
    n = s.sizes[rows]
    own, top = _band(n), _band(_largest_partner(n))
    for which, band in ((np.ones(len(rows), bool), own), (top > own, top)):
        sub, b = rows[which], band[which]
        for step in range(4):
            if not len(sub):
                break
            k = _blocks(b, 4**step) if step < 3 else np.zeros(len(sub), np.int64)
            key, at, found = _words(s, sub, k, b | (step << 5))
            # a partner is of the band at most
            most = bound(s.sizes[sub], np.minimum(_largest_partner(s.sizes[sub]), LOWEST * 2**b - 1))
            yield key, at, sub, found, most
            weak = (found <= most) & (k > 0)
            sub, b = sub[weak], b[weak]


def _parity_bits(s: Sets) -> list[bytes | None]:
    """One parity bit a token, in the power of two of bits from twice the size on (at least 64)."""
    out: list[bytes | None] = []
    bits = np.maximum(64, 2 << np.ceil(np.log2(np.maximum(s.sizes, 1))).astype(np.int64))
    for i, m in enumerate(bits.tolist()):
        h = s.hashes[s.at[i] : s.at[i + 1]]
        out.append(np.packbits((np.bincount((h & _U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes() if len(h) else None)
    return out


def _digests(names: np.ndarray) -> pa.Array:
    """128-bit digests as bytes; null for an empty set."""
    raw = np.ascontiguousarray(names).tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if full else None for i, full in enumerate((names != 0).any(axis=1).tolist())], pa.binary())


def _once(s: Sets, names: np.ndarray) -> np.ndarray:
    """Places of the non-empty sets, each different one once."""
    rows = np.flatnonzero(s.sizes)
    if not len(rows):
        return rows
    return rows[np.unique(np.ascontiguousarray(names[rows]).view("V16").ravel(), return_index=True)[1]]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, cls) of every text."""
    for b in batches:
        for ids, s in in_chunks(b.column(0), b.column(1)):
            yield pa.record_batch([ids.cast(pa.int64()), pa.array(s.sizes), _digests(s.names())], ["id", "n", "cls"])


_MESSAGE = "slice int, bin long, low binary, owners binary, often binary"


def _six(keys: np.ndarray) -> bytes:
    """The low 48 bits of keys, as three arrays of 16 bits."""
    return b"".join((keys >> _U(16 * i)).astype("<u2").tobytes() for i in range(3))


def _keys_of(data: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(data, "<u2").reshape(3, -1)
    x = high.astype(np.uint64)
    for part in (middle, low):
        x <<= _U(16)
        x |= part
    return x


class _Bin:
    """Words of some sets on their way out: keys, whose they are, and of each set its class, words and bound."""

    def __init__(self, name: int):
        self.name, self.n, self.entries = name, 0, 0
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.about: list[np.ndarray] = []

    def add(self, keys: np.ndarray, at: np.ndarray, cls: np.ndarray, found: np.ndarray, most: np.ndarray) -> None:
        self.keys.append(keys)
        self.owners.append((at + self.entries).astype(np.uint32))
        self.about.append(np.column_stack([cls, found.astype(np.uint64), most.astype(np.uint64)]))
        self.n, self.entries = self.n + len(keys), self.entries + len(found)

    def sent(self, slices: int) -> Iterator[pa.RecordBatch]:
        """A row for each slice, and one for the bin itself (slice: minus one, less any slice): its sets and its frequent keys."""
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners)
        part = ((keys >> _U(32)) * _U(slices) >> _U(32)).astype(np.int64)
        low = keys & _U((1 << 48) - 1)
        order = np.lexsort((low, part))
        part, low, owners = part[order], low[order], owners[order]
        first = np.ones(len(low), bool)
        first[1:] = (low[1:] != low[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        times = np.diff(np.concatenate([at, [len(low)]]))
        many = np.repeat(times > 1, times)
        own = np.concatenate([_full(low[many], part[many]).view(np.uint8), owners[many].view(np.uint8)]).tobytes()
        part, low, owner = part[at], low[at], np.where(times > 1, _OFTEN, owners[at]).astype("<u2")
        cut = np.searchsorted(part, np.arange(slices + 1))
        yield _messages([(-1 - self.name % slices, self.name, np.concatenate(self.about).tobytes(), own, b"")])
        rows = []
        for p in np.flatnonzero(np.diff(cut)).tolist():
            i, j = cut[p], cut[p + 1]
            often = np.flatnonzero(times[i:j] > 1)
            rows.append((p, self.name, _six(low[i:j]), owner[i:j].tobytes(), np.concatenate([often, times[i:j][often]]).astype("<u4").tobytes()))
            if len(rows) >= 512:
                yield _messages(rows)
                rows = []
        if rows:
            yield _messages(rows)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["slice", "bin", "low", "owners", "often"])


def _full(low: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """The key in a group's name: its low bits and its slice."""
    return mix(low + mix(np.atleast_1d(part).astype(np.uint64) + _U(1)))


def _binned(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """The words of all texts, as messages to slices."""
    name = TaskContext.get().partitionId() << 32
    now = _Bin(name)
    for b in batches:
        for _, s in in_chunks(b.column(0), b.column(1)):
            names = s.names()
            rows = _once(s, names)
            for key, at, sub, found, most in _levels(s, rows):
                if now.entries + len(sub) >= _OFTEN:
                    yield from now.sent(slices)
                    now = _Bin(now.name + 1)
                now.add(key, at, names[sub], found, most)
            if now.n >= BIN:
                yield from now.sent(slices)
                now = _Bin(now.name + 1)
    if now.entries:
        yield from now.sent(slices)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of messages sorted by slice: to each bin those of its keys that occur twice or more, with how often; bins' own rows pass."""
    now, held = None, []

    def answers() -> Iterator[pa.RecordBatch]:
        low = np.concatenate([_keys_of(r[1]) for r in held])
        sizes = np.array([len(r[2]) // 2 for r in held])
        times = np.ones(len(low), np.int64)
        for at, r in zip(np.cumsum(sizes) - sizes, held, strict=True):
            often = np.frombuffer(r[3], "<u4").astype(np.int64)
            times[at + often[: len(often) // 2]] = often[len(often) // 2 :]
        order = np.argsort(low, kind="stable")
        x = low[order]
        first = np.ones(len(x), bool)
        first[1:] = x[1:] != x[:-1]
        at = np.flatnonzero(first)
        sums = np.add.reduceat(times[order], at)
        total = np.empty(len(low), np.int64)
        total[order] = np.repeat(sums, np.diff(np.concatenate([at, [len(low)]])))
        keep = total > 1
        cut = np.concatenate([[0], np.cumsum(sizes)])
        rows = []
        for i, r in enumerate(held):
            some = np.flatnonzero(keep[cut[i] : cut[i + 1]])
            if len(some):
                rows.append((now, r[0], _full(low[cut[i] + some], now).tobytes(), np.frombuffer(r[2], "<u2")[some].tobytes(), np.minimum(total[cut[i] + some], (1 << 32) - 1).astype("<u4").tobytes()))
                if len(rows) >= 512:
                    yield _messages(rows)
                    rows = []
        if rows:
            yield _messages(rows)

    for b in batches:
        for i, part in enumerate(b.column(0).to_pylist()):
            if part < 0:
                yield b.slice(i, 1)
                continue
            if part != now and held:
                yield from answers()
                held.clear()
            now = part
            held.append(tuple(b.column(k)[i].as_py() for k in (1, 2, 3, 4)))
    if held:
        yield from answers()


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of answers sorted by bin: (key, cls) of the words by which each set joins, its rarest."""
    now, about, own, held = None, b"", b"", []

    def words() -> Iterator[pa.RecordBatch]:
        sets = np.frombuffer(about, np.uint64).reshape(-1, 4)
        key, owner, times = (np.concatenate([np.frombuffer(r[k], kind) for r in held]) for k, kind in enumerate((np.uint64, "<u2", "<u4")))
        often = owner == _OFTEN
        if often.any():  # whose they are is in the bin's own row
            n = len(own) // 12
            mine, whose = np.frombuffer(own[: 8 * n], np.uint64), np.frombuffer(own[8 * n :], np.uint32)
            k, t = key[often], times[often]
            order = np.argsort(k)
            at = order[np.searchsorted(k, mine, sorter=order)]
            key, owner, times = np.concatenate([key[~often], mine]), np.concatenate([owner[~often].astype(np.uint32), whose]), np.concatenate([times[~often], t[at]])
        shared = np.bincount(owner, minlength=len(sets))
        need = np.minimum(shared, (sets[:, 3].astype(np.int64) + 1) - (sets[:, 2].astype(np.int64) - shared))
        some = need[owner] > 0
        key, owner, times = key[some], owner[some].astype(np.int64), times[some]
        order = np.lexsort((key, times, owner))
        key, owner = key[order], owner[order]
        start = np.searchsorted(owner, np.arange(len(sets)))
        keep = np.arange(len(key)) - start[owner] < need[owner]
        key, owner = key[keep], owner[keep]
        raw = np.ascontiguousarray(sets[:, :2]).tobytes()
        cls = pa.array([raw[16 * i : 16 * i + 16] for i in range(len(sets))], pa.binary())
        for i in range(0, len(key), 1 << 16):
            yield pa.record_batch([pa.array(key[i : i + (1 << 16)].view(np.int64)), cls.take(pa.array(owner[i : i + (1 << 16)]))], ["key", "cls"])

    for b in batches:
        for i, name in enumerate(b.column(1).to_pylist()):
            if name != now:
                if held:
                    yield from words()
                now, about, own, held = name, b"", b"", []
            row = tuple(b.column(k)[i].as_py() for k in (2, 3, 4))
            if b.column(0)[i].as_py() < 0:
                about, own = row[:2]
            else:
                held.append(row)
    if held:
        yield from words()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, s in in_chunks(b.column(0), b.column(1)):
            names = s.names()
            full = _once(s, names)
            bits = _parity_bits(s)
            data = [s.hashes[s.at[i] : s.at[i + 1]].tobytes() for i in full]
            yield pa.record_batch([_digests(names[full]), pa.array(s.sizes[full]), pa.array([bits[i] for i in full], pa.binary()), pa.array(data, pa.binary())], ["cls", "n", "bits", "tokens"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with parity bits: those whose Hamming distance allows similarity."""
    for b in batches:
        na, nb = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
        keep = (np.minimum(na, nb) * DEN >= np.maximum(na, nb) * NUM) & (na > 0)
        for i in np.flatnonzero(keep).tolist():
            x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in ("bits_a", "bits_b"))
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            keep[i] = int(np.bitwise_count(x ^ y).sum()) <= bound(int(na[i]), int(nb[i]))
        rows = pa.array(np.flatnonzero(keep))
        yield pa.record_batch([b.column(k).take(rows) for k in range(3)], ["a", "b", "shared"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (ascending) reach the similarity."""
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return DEN * inter >= NUM * (len(x) + len(y) - inter)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("tokens_a"), b.column("tokens_b"), strict=True)]
        rows = pa.array(np.flatnonzero(np.array(keep, bool)))
        yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows)], ["a", "b"])


def _joined(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b, ...) with ``n`` and ``column`` of both; hubs (a) with many pairs are dealt in parts of HUB pairs."""
    counts = staged(pairs.groupBy("a").agg(F.count("*").alias("pairs")), "hubs")
    parts = F.ceil(F.col("pairs") / HUB).cast("int")
    dealt = attach_group(pairs, counts, ["a"], "pairs").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int"))
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col(column).alias(f"{column}_{c}"))
    hubs = side("a").join(counts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("pairs")
    return dealt.drop("pairs").join(side("b"), "b").join(hubs, ["a", "part"]).select("a", "b", "shared", "n_a", "n_b", f"{column}_a", f"{column}_b")


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with an id of ``ids`` (null included); ids are broadcast only when few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    other = ids.select(F.col("id").alias("wanted"))
    return docs.join(F.broadcast(other) if few else other, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Parity bits folded to ``width`` bytes, as rows of 64-bit words."""
    out = np.empty((len(bits), width // 8), np.uint64)
    for i, x in enumerate(bits):
        v = np.frombuffer(x, np.uint64)
        while len(v) > width // 8:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[i] = v
    return out


def _near_in(g: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Of a tile: each row of the left with those of the right that its parity bits allow a link with, that are of a
    greater component, and that don't meet it under a smaller key too."""
    left, right = g[g["left"]], g[~g["left"]]
    if not len(left) or not len(right):
        return
    key, width = g["place"].iloc[0], min(map(len, g["bits"]))
    y, yn = _folded(right["bits"].tolist(), width), right["n"].to_numpy()
    rank, lists = list(zip(right["members"], right["root"], strict=True)), right["keys"].tolist()
    for at, n, members, root, bits, keys in zip(left.index, left["n"], left["members"], left["root"], left["bits"], left["keys"], strict=True):
        far = np.bitwise_count(y ^ _folded([bits], width)).sum(axis=1)
        ok = (far <= bound(n, yn)) & (np.minimum(n, yn) * DEN >= np.maximum(n, yn) * NUM)
        before = {k for k in keys if k < key}
        hit = [i for i in np.flatnonzero(ok).tolist() if rank[i] > (members, root) and before.isdisjoint(lists[i])]
        if hit:
            yield at, right.index[hit].to_numpy()


def _met(g: pd.DataFrame) -> pd.DataFrame:
    """Rows of a tile that may have a link in it."""
    at = {i for one, others in _near_in(g) for i in (one, *others.tolist())}
    return g.loc[sorted(at), ["place", "cls"]]


def _linked(g: pd.DataFrame) -> pd.DataFrame:
    """Links of a tile, as few as connect what its links connect."""
    above: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in above:
            x = above[x]
        return x

    names, roots = g["cls"].to_dict(), g["root"].to_dict()
    sets = {i: np.frombuffer(x, np.uint64) for i, x in g["tokens"].items()}
    links = []
    for i, others in _near_in(g):
        for j in others.tolist():
            x, y = top(roots[i]), top(roots[j])
            if x != y and similar(sets[i], sets[j]):
                above[x] = y
                links.append((names[i], names[j]))
    return pd.DataFrame(links, columns=["a", "b"])


def _in_tiles(rows: DataFrame, weight: Column, tile: int, side: int) -> DataFrame:
    """``rows`` (place, cls, lesser, ...) dealt to tiles (place, i, j), with ``left``.

    The lesser members of a place are its left side, all its members the right one. Both sides are cut into parts of
    ``tile`` and ``side`` by weight, and each part of the left meets each of the right, so no task holds more than one
    of each.
    """
    size = rows.groupBy("place").agg(F.sum(F.when(F.col("lesser"), weight)).alias("lefts"), F.sum(weight).alias("rights"), F.count("*").alias("m"))
    held = attach_group(rows, staged(size.filter("lefts is not null"), "sizes"), ["place"], "m").drop("m")
    cut = lambda n, by: F.ceil(F.col(n) / by).cast("int")
    spread = lambda n, by: F.explode(F.sequence(F.lit(0), cut(n, by) - 1))
    mine = lambda n, by: F.pmod(F.xxhash64("cls"), cut(n, by)).cast("int")
    one = held.filter("lesser").withColumn("i", mine("lefts", tile)).withColumn("j", spread("rights", side)).withColumn("left", F.lit(True))
    two = held.withColumn("j", mine("rights", side)).withColumn("i", spread("lefts", tile)).withColumn("left", F.lit(False))
    return one.unionByName(two).drop("lefts", "rights", "lesser")


def _placed(rows: DataFrame) -> DataFrame:
    """Where members of large groups meet: (place, cls, root, members, lesser) from rows of key, cls, root, members.

    The greatest component of a key and its other members, the lesser ones, have to be compared, and the lesser ones with
    each other. Where many keys show the same component's members to the same lesser ones, these meet once, at a place
    of the component, if that takes fewer comparisons than at the keys.
    """
    rank = F.struct("members", "root")
    tops = staged(rows.groupBy("key").agg(F.max(rank).alias("top"), F.count("*").alias("m")), "tops")
    marked = attach_group(rows, tops, ["key"], "m").withColumn("lesser", rank < F.col("top")).withColumn("of", F.col("top.root"))
    marked = staged(marked.select("key", "cls", "root", "members", "lesser", "of"), "marked")
    sides = marked.groupBy("of", "key").agg(F.count_if("lesser").alias("l"), F.count_if(~F.col("lesser")).alias("r"))
    by_key = sides.groupBy("of").agg(F.sum(F.col("l") * F.col("r")).alias("at_keys"))
    once = marked.select("of", "cls", "root", "members", "lesser").distinct()
    by_component = once.groupBy("of").agg((F.count_if("lesser") * F.count_if(~F.col("lesser"))).alias("at_once"), F.count("*").alias("m"))
    chosen = staged(by_key.join(by_component, "of").select("of", (F.col("at_once") < F.col("at_keys")).alias("once"), "m"), "chosen")
    met = attach_group(staged(once, "once"), chosen, ["of"], "m").filter("once").select(F.xxhash64("of").alias("place"), "cls", "root", "members", "lesser")
    # the rest of a key whose greatest component has gone: the lesser ones, whose greatest component is found anew
    rest = attach_group(marked, chosen, ["of"], "m").filter("lesser or not once").drop("m", "of", "once", "lesser")
    anew = staged(rest.groupBy("key").agg(F.max(rank).alias("top"), F.min(rank).alias("low"), F.count("*").alias("m")).filter("low != top").drop("low"), "anew")
    rest = attach_group(staged(rest, "rest"), anew, ["key"], "m").withColumn("lesser", rank < F.col("top"))
    return rest.select(F.col("key").alias("place"), "cls", "root", "members", "lesser").unionByName(met)


def _links_of_large(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect members of large groups; ``rows``: key, cls, root, members.

    Members meet at their smallest common place only, as far as their lists of KEYS places tell. By parity bits, rows
    without a possible link go first; whole sets are sent for the rest.
    """
    rows = staged(_placed(rows), "placed")
    lists = rows.groupBy("cls").agg(F.slice(F.array_sort(F.collect_set("place")), 1, KEYS).alias("keys"))
    rows = staged(rows.join(lists, "cls").join(sets.select("cls", "n"), "cls"), "open")
    tiles = _in_tiles(rows, F.lit(1), TILE, SIDE).join(sets.select("cls", "bits"), "cls")
    met = staged(tiles.groupBy("place", "i", "j").applyInPandas(_met, "place long, cls binary").distinct(), "met")
    rows = staged(rows.join(met, ["place", "cls"]), "open")
    tiles = _in_tiles(rows, F.col("n"), TILE_TOKENS, SIDE_TOKENS).join(sets.select("cls", "bits", "tokens"), "cls")
    return staged(tiles.groupBy("place", "i", "j").applyInPandas(_linked, "a binary, b binary"), "links")


def _few(rows: DataFrame) -> DataFrame:
    """All pairs in different components within keys of at most GROUP classes (rows: key, cls, root)."""
    return rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def joining_words(docs: DataFrame, words: int) -> DataFrame:
    """(key, cls) of the words by which classes join, of words that two or more sets have; ``words``: about how many there are."""
    n = partitions(docs.sparkSession)
    slices = max(n, -(-words // SLICE))
    sent = docs.mapInArrow(freed(lambda it: _binned(it, slices)), _MESSAGE)
    sent = sent.repartition(max(n, -(-words // (16 * SLICE))), "slice").sortWithinPartitions("slice")
    back = sent.mapInArrow(freed(_answered), _MESSAGE)
    back = back.repartition(max(n, -(-words // (16 * BIN))), "bin").sortWithinPartitions("bin", "slice")
    return back.mapInArrow(freed(_picked), "key long, cls binary")


def linked_classes(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, root) of classes with links; ``docs``: id, text; ``classes``: cls, id (one row's id), n."""
    spark = docs.sparkSession
    picked = staged(joining_words(docs, words), "words")
    keys = picked.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last"), F.count("*").alias("m"))
    keys = staged(keys.filter("hub != last").drop("last"), "keys")
    shared = staged(attach_group(picked, keys, ["key"], "m").select("key", "cls", "hub").distinct(), "shared")
    dropped(picked, keys)
    stars = staged(shared.filter("cls != hub").groupBy(F.col("hub").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("shared")), "stars")
    chosen = staged(classes.join(shared.select("cls").distinct(), "cls").select("id"), "chosen")
    sets = staged(_chosen(docs, chosen).mapInArrow(freed(_sets), "cls binary, n long, bits binary, tokens binary").dropDuplicates(["cls"]), "sets")

    def near(pairs: DataFrame) -> DataFrame:
        return staged(_joined(pairs, sets, "bits").mapInArrow(freed(_near), "a binary, b binary, shared long"), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        return staged(_joined(pairs, sets, "tokens").select("a", "b", "tokens_a", "tokens_b").mapInArrow(freed(_verified), "a binary, b binary"), "links")

    def rooted(roots: DataFrame, table: DataFrame, on: str, name: str) -> DataFrame:
        return table.join(roots.select(F.col("node").alias(on), F.col("root").alias("r")), on, "left").withColumn(name, F.coalesce("r", on)).drop("r")

    def opened(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        return rooted(roots, rooted(roots, pairs, "a", "ra"), "b", "rb").filter("ra != rb").drop("ra", "rb")

    close = near(stars)
    best = close.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"), F.max("shared").alias("shared")).select("a", "b", "shared")
    links = verified(best)
    roots = components(links)
    rest = staged(opened(close.join(best, ["a", "b"], "left_anti"), roots), "rest")
    if rest.limit(1).count():
        new = verified(rest)
        links, roots = links.unionByName(new), contracted(roots, new)
    tested = [stars.select("a", "b")]

    def untested(pairs: DataFrame) -> DataFrame:
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        return pairs

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of words whose members are in different components; with two members the hub's pair was all."""
        now = staged(rooted(roots, rows, "cls", "root"), "rooted")
        keys = now.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
        keys = staged(keys.filter("m > 2 and low != high").select("key", "m"), "open-keys")
        return staged(attach_group(now.select("key", "cls", "root"), keys, ["key"], "m"), "open")

    rows = apart(shared.select("key", "cls"))
    for _ in range(ROUNDS):
        if not rows.limit(1).count():
            return roots
        degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("degree"))
        ranked = rows.join(degree, "cls", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        hubs = ranked.groupBy("key", "m").agg(F.max(F.struct("degree", "cls", "root")).alias("hub"))
        hubs = staged(hubs.select("key", "m", F.col("hub.cls").alias("hub"), F.col("hub.root").alias("hub_root")), "hubs")
        pairs = attach_group(rows.drop("m"), hubs, ["key"], "m").filter("root != hub_root").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()
        pairs = staged(untested(pairs).withColumn("shared", F.lit(0).cast("long")), "pairs")
        new = verified(near(pairs))
        if not new.limit(1).count():
            break
        tested.append(pairs.select("a", "b"))
        links, roots = links.unionByName(new), contracted(roots, new)
        rows = apart(rows.select("key", "cls"))
    small, large = rows.filter(f"m <= {GROUP}").drop("m"), rows.filter(f"m > {GROUP}").drop("m")
    more = staged(untested(_few(small).distinct()).withColumn("shared", F.lit(0).cast("long")), "more")
    new = verified(near(more))
    if large.limit(1).count():
        members = rooted(roots, classes.select("cls"), "cls", "root").groupBy("root").agg(F.count("*").alias("members"))
        large = attach_group(large, staged(members, "members"), ["root"], "members")
        new = new.unionByName(_links_of_large(staged(large, "large"), sets))
    return contracted(roots, new)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (least id reachable by links; its own without links)."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with scratch() as keep:
        rows, named = _named(docs)
        keep(rows, named)
    full = attach_group(rows.filter("cls is not null").select("id", "n", "cls"), named, ["cls"], "size")
    empty = rows.filter("cls is null").select("id", "n", F.col("id").alias("component_id"))
    return full.select("id", "n", "component_id").unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, cls) of each row, and (cls, size, component_id) of each class."""
    rows = staged(docs.mapInArrow(freed(_profile), "id long, n long, cls binary"), "profile")
    total = rows.agg(F.sum("n")).first()[0] or 0
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count("*").alias("size"))
    classes = staged(classes, "classes")
    roots = linked_classes(docs, classes.select("cls", "id", "n"), total)
    named = staged(classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "id", "size", F.coalesce("root", "cls").alias("root")), "named")
    least = staged(named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("classes")), "components")
    return rows, staged(attach_group(named, least, ["root"], "classes").select("cls", "size", "component_id"), "named")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)"""
