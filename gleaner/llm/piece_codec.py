"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text becomes pieces of a SentencePiece BPE model by its own agenda: candidate merges of neighbouring symbols wait in a
heap by the merged piece's rank, then place. A candidate taken from the agenda is skipped for good when a keyed hash of
(seed, digest of the text, place of the unit in the text, how many candidates the unit took before) falls below
``dropout``; merges that later arise beside it are candidates of their own. So segmentations vary with the seed, from
document to document and from place to place; the same text and seed always give the same ids. With dropout 0 the ids
are those of the library's encoder.

No piece has a blank or a line end after another character, so a text is cut into units there. Units are code points in
arrays: a unit's ids without skips, and how many candidates it took, are kept in a bounded memo; all draws of a chunk
are made at once, and the units in which a candidate is skipped pass the agenda together, those of one length side by
side, a candidate each at a time. What is skipped is drawn anew for every unit of every text. Characters that no piece
has are coded as bytes, as is the model's own blank sign where a text holds it, so decoding gives every text back
exactly.

Edge cases: a null text counts as empty; an empty text has no ids; text of any length is coded whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, freed, in_stretches, kept_in_worker
from gleaner.llm.tokens import CHUNK, Memo, gathered, hashed

DROPOUT, SEED = 0.1, 17
#: Symbols of a unit up to which units pass the agenda side by side, and are kept; longer ones pass it alone.
LONGEST = 48

_SIGN, _LITERAL = "▁", "\0▁"
_MASK = (1 << 64) - 1
_UNIT, _NTH, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_U = np.uint64
_NEVER = np.iinfo(np.int32).max


def drawn(key: int, unit: int, nth: int) -> int:
    """32 bits for a unit's nth candidate, in a text of that key."""
    x = key + unit * _UNIT + nth * _NTH & _MASK
    x = (x ^ x >> 30) * _MIX[0] & _MASK
    x = (x ^ x >> 27) * _MIX[1] & _MASK
    return (x ^ x >> 31) >> 32


def _all_drawn(key: np.ndarray, unit: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """``drawn`` of arrays."""
    x = key + unit.astype(np.uint64) * _U(_UNIT) + nth.astype(np.uint64) * _U(_NTH)
    x = (x ^ x >> _U(30)) * _U(_MIX[0])
    x = (x ^ x >> _U(27)) * _U(_MIX[1])
    return (x ^ x >> _U(31)) >> _U(32)


class _Pairs:
    """Which pieces two symbols make, and their ranks: an open table of pairs of symbols."""

    def __init__(self, pairs: dict[tuple[int, int], int], rank: np.ndarray):
        self.mask = (1 << (4 * len(pairs) + 64).bit_length()) - 1
        keys = np.array([(a << 32 | b) + 1 for a, b in pairs], np.uint64)
        made = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.key, self.made, self.rank = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32), np.full(self.mask + 1, _NEVER, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.key[s] == 0
            self.key[s[free]] = keys[left[free]]  # of several that want a slot the last one has it
            won = free & (self.key[s] == keys[left])
            self.made[s[won]], self.rank[s[won]] = made[left[won]], rank[made[left[won]]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _U(_UNIT)) >> _U(40)).astype(np.int64) & self.mask

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs of symbols; an empty slot has the rank _NEVER."""
        key = ((a.astype(np.uint64) << _U(32)) | b.astype(np.uint64)) + _U(1)
        slot = self._slot(key)
        left = np.flatnonzero((self.key[slot] != key) & (self.key[slot] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.key[slot[left]]
            left = left[(there != key[left]) & (there != 0)]
        return slot


class Codec:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes = [0] * 256
        surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                self.ids[piece] = i
                self.rank[piece] = -model.get_score(i)
                surface.append(piece.replace(_SIGN, " ").encode())
        self.limit, self.seed = int(dropout * (1 << 32)), seed
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        # symbols: pieces by their ids, then characters within pieces that are no pieces, then all other characters as one
        symbol = dict(self.ids)
        for piece in self.ids:
            for c in piece:
                symbol.setdefault(c, len(surface) + len(symbol) - len(self.ids))
        self.pieces_end, self.unknown = len(surface), len(surface) + len(symbol) - len(self.ids)
        self.points = np.array(sorted(ord(c) for c in symbol if len(c) == 1), np.uint32)
        self.of_point = np.array([symbol[chr(c)] for c in self.points], np.int32)
        order = np.zeros(self.unknown + 1, np.int32)
        order[list(self.ids.values())] = np.unique([self.rank[p] for p in self.ids], return_inverse=True)[1]
        self.pairs = _Pairs({(symbol[p[:k]], symbol[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}, order)
        # of each unit: how many candidates it takes without skips, then its ids
        self.memo = Memo("u2" if self.pieces_end <= 1 << 16 else "u4")

    def pieces(self, unit: str, skip: Callable[[int], bool] | None = None) -> tuple[list[str], int]:
        """Symbols of one unit whose blanks are signs, by the agenda, and how many candidates were taken; ``skip``: by number."""
        symbols = [_LITERAL if c == _SIGN else _SIGN if c == " " else c for c in unit]
        n = len(symbols)
        if n == 1:
            return symbols, 0
        rank, taken = self.rank.get, 0
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, length = heapq.heappop(agenda)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != length:
                continue  # one of its symbols has changed since
            taken += 1
            if skip and skip(taken - 1):
                continue
            symbols[i] += symbols[j]
            size[i], size[j] = length, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, length + size[k]))
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + symbols[i])) is not None:
                heapq.heappush(agenda, (r, h, size[h] + length))
        return [s for s, c in zip(symbols, size, strict=True) if c], taken

    def alone(self, unit: str, skip: Callable[[int], bool] | None = None) -> tuple[list[int], int]:
        """Ids of one unit, and how many candidates it took."""
        out: list[int] = []
        symbols, taken = self.pieces(unit, skip)
        for p in symbols:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in (_SIGN if p == _LITERAL else p).encode()]
        return out, taken

    def _beside(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, skipped: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, how many of each, candidates taken) of units with ``size`` symbols, LONGEST at most.

        ``skipped``: of some units (by place) and candidate numbers, which are skipped.
        """
        parts, where = [], []
        counts, taken = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            cp = points[start[rows][:, None] + np.arange(n)]
            sym = self._symbols(cp)
            alive = np.ones(sym.shape, bool)
            if n > 1:
                taken[rows] = self._merged(sym, alive, None if skipped is None else (lambda some, nth, rows=rows: skipped(rows[some], nth)))
            flat, counts[rows] = self._as_ids(sym, alive, cp)
            parts.append(flat)
            where.append(rows)
        if not parts:
            return np.zeros(0, self.memo.ids.dtype), counts, taken
        order = np.concatenate(where)
        sizes = counts[order]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(sizes) - sizes
        return gathered(np.concatenate(parts), at, counts), counts, taken

    def _symbols(self, cp: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, cp), len(self.points) - 1)
        sym = np.where(self.points[at] == cp, self.of_point[at], self.unknown)
        sym[cp == ord(_SIGN)] = self.unknown
        sym[cp == 32] = self.ids[_SIGN]
        return sym

    def _merged(self, sym: np.ndarray, alive: np.ndarray, skipped: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> np.ndarray:
        """The agenda for rows of symbols, all at once: each round takes the best candidate of each row."""
        m, n = sym.shape
        rows, pairs = np.arange(m), self.pairs
        after = np.tile(np.arange(1, n + 1, dtype=np.int8), (m, 1))
        before = np.tile(np.arange(-1, n - 1, dtype=np.int8), (m, 1))
        slot = np.zeros((m, n), np.int64)
        rank = np.full((m, n), _NEVER, np.int32)
        slot[:, :-1] = pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(m, n - 1)
        rank[:, :-1] = pairs.rank[slot[:, :-1]]
        taken = np.zeros(m, np.int64)
        while True:
            i = rank[rows].argmin(axis=1)
            there = rank[rows, i] < _NEVER
            rows, i = rows[there], i[there]
            if not len(rows):
                return taken
            nth = taken[rows]
            taken[rows] += 1
            rank_at, merge_rows, merge_i = rank, rows, i
            if skipped is not None:
                off = skipped(rows, nth)
                rank_at[rows[off], i[off]] = _NEVER
                merge_rows, merge_i = rows[~off], i[~off]
            r, i = merge_rows, merge_i
            j = after[r, i]
            sym[r, i] = pairs.made[slot[r, i]]
            alive[r, j], rank[r, j] = False, _NEVER
            k = after[r, j]
            after[r, i] = k
            rank[r, i] = _NEVER
            inner = k < n
            before[r[inner], k[inner]] = i[inner]
            h = before[r, i]
            outer = h >= 0
            # the candidates on both sides of the new symbol
            rr = np.concatenate([r[inner], r[outer]])
            left, right = np.concatenate([i[inner], h[outer]]), np.concatenate([k[inner], i[outer]])
            s = pairs(sym[rr, left], sym[rr, right])
            slot[rr, left], rank[rr, left] = s, pairs.rank[s]

    def _as_ids(self, sym: np.ndarray, alive: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols alive, row by row, and how many each row has."""
        flat = sym[alive]
        counts = alive.sum(axis=1)
        odd = np.flatnonzero(flat >= self.pieces_end)
        if len(odd):
            parts, at = [], 0
            owner, points = np.repeat(np.arange(len(sym)), counts), cp[alive]
            for k in odd.tolist():
                coded = [self.bytes[b] for b in chr(points[k]).encode()]
                parts += [flat[at:k], np.array(coded)]
                counts[owner[k]] += len(coded) - 1
                at = k + 1
            flat = np.concatenate([*parts, flat[at:]])
        return flat.astype(self.memo.ids.dtype), counts

    def arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each text has); texts of CHUNK characters together, or one text."""
        full = [i for i, t in enumerate(texts) if t]
        counts = np.zeros(len(texts), np.int64)
        if not full:
            return np.zeros(0, self.memo.ids.dtype), counts
        points = np.frombuffer(" ".join(["", *(texts[i] for i in full)]).encode("utf-32-le"), np.uint32)  # each text follows a blank
        lengths = np.array([len(texts[i]) + 1 for i in full])
        edge = np.cumsum(lengths) - lengths
        keys = np.array([xxhash.xxh64_intdigest(texts[i].encode(), seed=self.seed) for i in full], np.uint64)
        blank, line = points == 32, points == 10
        start = np.empty(len(points), bool)
        start[0] = True
        start[1:] = line[1:] | (blank[1:] & ~blank[:-1]) | (~blank[1:] & line[:-1])
        start[edge] = True
        start = np.flatnonzero(start)
        size = np.diff(start, append=len(points))
        text = np.searchsorted(edge, start, "right") - 1
        place = np.arange(len(start)) - np.searchsorted(start, edge)[text]
        first, n = self._coded(points, start, size, keys[text], place)
        counts[full] = np.bincount(text, n, len(full)).astype(np.int64)
        return gathered(self.memo.ids, first, n), counts

    def _coded(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the memo's array has the ids of each unit, and how many they are."""
        memo = self.memo
        short = size <= LONGEST
        one, two = (np.zeros(len(start), np.uint64) for _ in range(2))
        for i, j in _stretches(start, size):  # hashed a chunk at a time
            base = start[i]
            some = points[base : start[j - 1] + size[j - 1]]
            if len(some) <= CHUNK:
                one[i:j], two[i:j] = (hashed(some, start[i:j] - base, start[i:j] - base + size[i:j], k) for k in (0, 1))
        slot = np.where(short, memo.find(one, two), -1)
        new = np.flatnonzero((slot < 0) & short)
        if len(new):
            at = new[np.unique(one[new], return_index=True)[1]]
            ids, n, taken = self._beside(points, start[at], size[at], None)
            memo.add(one[at], two[at], n + 1, np.insert(ids, np.cumsum(n) - n, taken))
            slot = np.where(short, memo.find(one, two), -1)
        first, n = memo.start[slot].astype(np.int64) + 1, memo.size[slot].astype(np.int64) - 1
        taken = np.where(slot >= 0, memo.ids[np.maximum(first - 1, 0)], 0).astype(np.int64)
        unit = np.repeat(np.arange(len(start)), taken)
        nth = np.arange(len(unit)) - np.repeat(np.cumsum(taken) - taken, taken)
        hit = np.zeros(len(start), bool)
        if self.limit:
            hit[unit[_all_drawn(key[unit], place[unit], nth) < self.limit]] = True
        again = np.flatnonzero(hit)
        parts, whose = [], [again]
        if len(again):
            ids, n[again], _ = self._beside(points, start[again], size[again], lambda some, k: _all_drawn(key[again[some]], place[again[some]], k) < self.limit)
            parts.append(ids)
        lost = np.flatnonzero(slot < 0)  # long units, and two with one hash
        for i in lost.tolist():
            unit_of = points[start[i] : start[i] + size[i]].tobytes().decode("utf-32-le")
            ids, _ = self.alone(unit_of, (lambda k, i=i: drawn(int(key[i]), int(place[i]), k) < self.limit) if self.limit else None)
            parts.append(np.array(ids, memo.ids.dtype))
            n[i] = len(ids)
        whose = np.concatenate([again, lost])
        if len(whose):
            first[whose] = memo.put(np.concatenate(parts)) + np.cumsum(n[whose]) - n[whose]
        return first, n

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.arrays([text])[0].astype("<u4").tobytes()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of texts one after the other, how many each has)."""
        size = self.surface_size[ids]
        data = gathered(self.surface, self.surface_at[ids], size)
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        begin, end = total[ends - counts], total[ends]
        full = counts > 0
        keep = np.ones(len(data), bool)
        keep[begin[full]] = False  # the blank before a text
        return data[keep], end - begin - full

    def decode(self, ids: bytes) -> str:
        x = np.frombuffer(ids, "<u4")
        return self.decode_all(x, np.array([len(x)]))[0].tobytes().decode()


def _stretches(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Units in a row with CHUNK symbols at most, or one."""
    ends, i = start + size, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(ends, start[i] + CHUNK, "right")))
        yield i, j
        i = j


def codec(path: str, dropout: float = DROPOUT, seed: int = SEED) -> Codec:
    """The codec of this Python worker, with its memo."""
    return kept_in_worker(("codec", path, dropout, seed), lambda: Codec(path, dropout, seed))


def _binary(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.itemsize
    large = pa.large_string() if kind == pa.string() else pa.large_binary()
    return pa.Array.from_buffers(large, len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(kind)


def _encoded(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = pc.fill_null(b.column(1), "")
        for i, j in in_stretches(pc.binary_length(texts).to_numpy(zero_copy_only=False), CHUNK):
            ids, counts = c.arrays(texts.slice(i, j - i).to_pylist())
            yield pa.record_batch([b.column(0).slice(i, j - i), _binary(ids.astype("<u4"), counts, pa.binary())], ["id", "ids"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string"))


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (binary, little-endian uint32) of every text."""
    coded = _rows(docs, id_col, text_col).mapInArrow(freed(lambda it: _encoded(it, codec(model, dropout, seed))), "id long, ids binary")
    return coded.select(F.col("id").alias(id_col), "ids")


def _ids_in(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, their ids one after the other, how many each has) of a column of ids, a bounded number at a time."""
    raw = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2] or b""
    for i, j in in_stretches(np.diff(offsets), 4 * CHUNK):
        yield i, j - i, np.frombuffer(data, "<u4", int(offsets[j] - offsets[i]) // 4, int(offsets[i])), np.diff(offsets[i : j + 1]) // 4


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for i, n, ids, counts in _ids_in(b.column(1)):
                yield pa.record_batch([b.column(0).slice(i, n), _binary(*c.decode_all(ids, counts), pa.string())], ["id", "text"])

    rows = coded.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`"))
    return rows.mapInArrow(freed(texts), "id long, text string").select(F.col("id").alias(id_col), "text")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and ids_crc32 of each text's ids, and the digest of the text decoded from them."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in _encoded(batches, c):
            for i, n, ids, counts in _ids_in(b.column(1)):
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                crc = pa.array([zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64())
                text = _binary(*c.decode_all(ids, counts), pa.string())
                yield pa.record_batch([b.column(0).slice(i, n), pa.array(counts), crc, text], ["doc_id", "n_tokens", "ids_crc32", "text"])

    found = _rows(docs, "doc_id", "text").mapInArrow(freed(both), "doc_id long, n_tokens long, ids_crc32 long, text string")
    return found.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
