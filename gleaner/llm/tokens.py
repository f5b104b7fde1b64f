"""Token ids by the tokenizers library, with a memo over units that no token crosses.

In the word vocabulary white space carries no ids, so a text's ids are the ids of its words between white space, in a
row. In a byte-level vocabulary a unit is white space with what follows it up to the next white space: the split
pattern begins anew wherever white space follows something else. Texts stay bytes: their units are found, hashed (128
bits) and looked up in numpy, a chunk at a time. Units that the memo doesn't have are asked for in one string; where a
token begins (or ends) a unit is told by the token itself. Every id comes from the library; the memo only saves asking
twice. Texts with rare kinds of white space, on which libraries differ, or with a special token are encoded whole, as
are all texts of a tokenizer whose settings are neither of the two.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.llm.common import kept_in_worker

#: Slots of the memo (some 30 bytes each); once FULL of them are taken, units that weren't met again go.
SLOTS, FULL = 1 << 21, 0.6
#: Bytes of text handled at a time; longer texts are cut between units.
CHUNK = 1 << 18
#: Bytes of a unit that is kept.
LONGEST = 64

_U = np.uint64


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_BLANK = _table(b" \t\n\r\x0b\x0c")
#: Letters, and with the bytes of U+00C0 to U+00FF; marks that are a token of their own after letters.
_LETTER, _LATIN, _ENDS = _table(_LETTERS + _LETTERS.upper()), _table(_LETTERS + _LETTERS.upper() + bytes([0xC3, *range(0x80, 0xC0)])), _table(b",.;:!?")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that may begin white space beyond ASCII, and all of it.
_RARE_LEAD = _table(bytes([*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]))
_RARE = re.compile(b"[\x1c-\x1f]|" + b"|".join(re.escape(chr(c).encode()) for c in [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, *range(0x205F, 0x2070), 0x3000, 0xFEFF]))
#: The settings of the two kinds of tokenizer that can be cut into units.
_NORMAL_WORDS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT_WORDS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _kind(tokenizer) -> str | None:
    """How a tokenizer's texts may be cut: words, bytes, or not at all."""
    normal, before = (json.loads(part.__getstate__()) if part is not None else None for part in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    before = before or {}
    if normal == _NORMAL_WORDS and before.get("type") == "Sequence" and before["pretokenizers"][:1] == [_CUT_WORDS]:
        return "words" if [x.get("use_regex") for x in before["pretokenizers"][1:]] == [False] else None
    return "bytes" if normal is None and _BYTE_LEVEL.items() <= before.items() else None


def _hashing(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of a multiplier and of its inverse."""
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 1 << 62)) * 4 + 3
    powers = []
    for base in (m, pow(m, -1, 1 << 64)):
        t = np.full(CHUNK + 1, base, np.uint64)
        t[0] = 1
        powers.append(np.multiply.accumulate(t))
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1), *powers


_HASHES = (_hashing(20240307), _hashing(20240308))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each stretch of at most CHUNK bytes or code points; there are two, independent of each other."""
    value, up, down = _HASHES[which]
    v = value[data] if data.dtype == np.uint8 else (data.astype(np.uint64) + _U(1)) * value[0]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v * up[: len(data)], out=total[1:])
    x = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x | _U(1)  # 0 is an empty slot


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    total = int(size.sum())
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(total)
    return values[at]


class Memo:
    """Ids of units by two hashes, in an open table; all operations are on arrays."""

    def __init__(self, kind: str):
        self.kind = kind
        self._empty()

    def _empty(self) -> None:
        self.one, self.two = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.start, self.size = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint16)
        self.again = np.zeros(SLOTS, bool)
        self.ids, self.used, self.entries = np.zeros(1 << 16, self.kind), 0, 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Slots of units, -1 for those that aren't there."""
        slot = (one >> _U(1)).astype(np.int64) & (SLOTS - 1)
        there = self.one[slot]
        out = np.where((there == one) & (self.two[slot] == two), slot, -1)
        left = np.flatnonzero((out < 0) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            s = slot[left]
            there = self.one[s]
            hit = (there == one[left]) & (self.two[s] == two[left])
            out[left[hit]] = s[hit]
            left = left[~hit & (there != 0)]
        self.again[out[out >= 0]] = True
        return out

    def put(self, ids: np.ndarray) -> int:
        """Writes ids behind those in use; they stay there only if ``used`` is moved."""
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        self.ids[self.used : end] = ids
        return self.used

    def add(self, one: np.ndarray, two: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Adds different units that aren't there."""
        if self.entries + len(one) > SLOTS * FULL:
            self._thinned(len(one))
        begin = self.put(ids)
        self.used += len(ids)
        self._placed(one, two, begin + np.cumsum(size) - size, size)

    def _placed(self, one: np.ndarray, two: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        slot, left = (one >> _U(1)).astype(np.int64) & (SLOTS - 1), np.arange(len(one))
        while len(left):
            s = slot[left]
            free = self.one[s] == 0
            s, mine = s[free], left[free]
            self.start[s] = mine  # of several that want a slot the last one has it
            won = self.start[s] == mine
            s, mine = s[won], mine[won]
            self.one[s], self.two[s], self.start[s], self.size[s] = one[mine], two[mine], start[mine], size[mine]
            rest = np.ones(len(one), bool)
            rest[mine] = False
            left = left[rest[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        self.entries += len(one)

    def _thinned(self, more: int) -> None:
        """Drops units that weren't met again, or all if that leaves too many."""
        keep = np.flatnonzero(self.again)
        one, two, start, size, ids = self.one[keep], self.two[keep], self.start[keep].astype(np.int64), self.size[keep].astype(np.int64), self.ids
        self._empty()
        if len(keep) + more <= SLOTS * FULL / 2:
            self.add(one, two, size, gathered(ids, start, size))


class Ids:
    """Ids of texts, as numbers of ``width`` bytes: two where the vocabulary allows, else four."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(self.tokenizer)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._code = "H" if self.width == 2 else "I"
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(f"u{self.width}")
        # where a unit begins (its first token has the blank) or a word ends
        tokens = self.tokenizer.get_vocab()
        self._edge = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self._edge[[i for t, i in tokens.items() if (t.endswith("</w>") if self.kind == "words" else t.startswith("\u0120"))]] = True

    def _asked(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array(self._code, e.ids), f"u{self.width}") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self._asked(texts)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        out: list[bytes] = []
        for _, flat, sizes in self.arrays(pa.array(texts, pa.large_binary())):
            at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            out += [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return out

    def arrays(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of some texts in a row, how many each has), a bounded number of bytes at a time; null is empty."""
        raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(raw):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            some, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            yield i, *(self._of_chunk(some, cuts) if len(some) <= CHUNK else self._of_long(some))
            i = j

    def _of_long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one text that is longer than a chunk: cut where white space begins."""
        if self._whole(data, np.array([0, len(data)]))[0]:
            ids = self._asked([data.tobytes().decode()])[0]
            return ids, np.array([len(ids)])
        out, at = [], 0
        while at < len(data):
            end = len(data)
            if end - at > CHUNK:
                blank = _BLANK[data[at : at + CHUNK]]
                begins = np.flatnonzero(blank[1:] & ~blank[:-1])
                if len(begins):
                    end = at + int(begins[-1]) + 1
                else:  # one unit, longer than a chunk
                    end = at + 1
                    while end < len(data) and not (_BLANK[data[end]] and not _BLANK[data[end - 1]]):
                        blank = _BLANK[data[end - 1 : end + CHUNK]]
                        begins = np.flatnonzero(blank[1:] & ~blank[:-1])
                        end += int(begins[0]) if len(begins) else len(blank) - 1
            part = data[at:end]
            out.append(self._of_chunk(part, np.array([0, len(part)]))[0] if len(part) <= CHUNK else self._asked([part.tobytes().decode()])[0])
            at = end
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])

    def _whole(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Which texts must be encoded whole."""
        out = np.zeros(len(cuts) - 1, bool)
        if self.kind is None:
            out[:] = True
            return out
        raw = None
        if _RARE_LEAD[data].any():
            raw = data.tobytes()
            out[np.searchsorted(cuts, [m.start() for m in _RARE.finditer(raw)], "right") - 1] = True
        for mark in self.marks:
            raw = data.tobytes() if raw is None else raw
            text, mark = (raw.lower(), mark.lower()) if self.kind == "words" else (raw, mark)
            at = text.find(mark.encode())
            while at >= 0:
                out[np.searchsorted(cuts, at, "right") - 1] = True
                at = text.find(mark.encode(), at + 1)
        return out

    def _of_chunk(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of a chunk in a row, and how many each has."""
        n, raw = len(cuts) - 1, data
        whole = self._whole(data, cuts)
        start, end = self._units(data, cuts)
        text = np.searchsorted(cuts, start, "right") - 1
        if whole.any():
            keep = ~whole[text]
            start, end, text = start[keep], end[keep], text[keep]
        if self.kind == "words":
            data = self._lowered(data, cuts)
        first, size = self._looked_up(data, start, end)
        counts = np.bincount(text, size, n).astype(np.int64)
        flat = gathered(self.memo.ids, first, size)
        if not whole.any():
            return flat, counts
        at = np.concatenate([[0], np.cumsum(counts)])
        parts = [flat[at[i] : at[i + 1]] for i in range(n)]
        alone = np.flatnonzero(whole).tolist()
        for i, x in zip(alone, self._asked([raw[cuts[i] : cuts[i + 1]].tobytes().decode() for i in alone]), strict=True):
            parts[i] = x
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _units(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and ends of all units."""
        blank = _BLANK[data]
        edge = np.zeros(len(data) + 1, bool)  # a new text
        edge[cuts] = True
        after = np.concatenate([[True], blank[:-1]]) if len(blank) else blank
        if self.kind == "words":
            start = np.flatnonzero(~blank & (after | edge[:-1]))
            end = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1 if len(blank) else start
            return start, end
        start = np.flatnonzero(blank & ~after | edge[:-1]) if len(blank) else np.zeros(0, np.int64)
        return start, np.concatenate([start[1:], [len(data)]]) if len(start) else start

    def _lowered(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """A-Z lowered as the vocabulary has lower case only; not in texts with characters beyond U+012F, which may combine."""
        far = (data > 0xC4) | (data == 0xC4) & (np.concatenate([data[1:], [0]]) > 0xAF)
        if not far.any():
            return _LOWER[data]
        odd = np.zeros(len(cuts) - 1, bool)
        odd[np.searchsorted(cuts, np.flatnonzero(far), "right") - 1] = True
        return np.where(np.repeat(odd, np.diff(cuts)), data, _LOWER[data])

    def _looked_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the memo has the ids of each unit, and how many they are."""
        memo = self.memo
        one, two = hashed(data, start, end, 0), hashed(data, start, end, 1)
        short = end - start <= LONGEST
        slot = memo.find(one, two)
        new = np.flatnonzero((slot < 0) & short)
        if len(new):
            at = new[np.unique(one[new], return_index=True)[1]]
            ids, size = self._learnt(data, start[at], end[at])
            memo.add(one[at], two[at], size, ids)
            slot = memo.find(one, two)
        first, size = memo.start[slot].astype(np.int64), memo.size[slot].astype(np.int64)
        lost = np.flatnonzero(slot < 0)  # long units, and two with one hash
        if len(lost):
            ids = self._asked([data[start[i] : end[i]].tobytes().decode() for i in lost])
            size[lost] = [len(x) for x in ids]
            first[lost] = memo.put(np.concatenate(ids)) + np.cumsum(size[lost]) - size[lost]
        return first, size

    def _learnt(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different units, one after the other, and how many each has."""
        n, length = len(start), end - start
        flat, at = gathered(data, start, length), np.cumsum(length) - length
        if self.kind == "words":
            # letters, and perhaps one mark: a token ends with them, another with it; each is asked with a blank after it
            marked = _ENDS[data[end - 1]] & (length > 1)
            plain = np.minimum.reduceat(_LATIN[flat], at) if n else np.zeros(0, bool)
            some = np.flatnonzero(marked)
            if len(some):
                body, short = gathered(data, start[some], length[some] - 1), length[some] - 1
                plain[some] = np.minimum.reduceat(_LATIN[body], np.cumsum(short) - short)
            edges = 1 + marked
        else:
            # a blank and what follows it
            plain = (data[start] == 32) & (length > 1)
            if n:
                plain &= np.add.reduceat(_BLANK[flat].astype(np.int64), at) == 1
            edges = np.ones(n, np.int64)
        simple, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        size, parts = np.zeros(n, np.int64), []
        if len(simple):
            found = self._asked_in_one(data, start[simple], end[simple], edges[simple])
            if found is None:
                rest, simple = np.arange(n), simple[:0]
            else:
                size[simple] = found[1]
                parts.append(found[0])
        if len(rest):
            ids = self._asked([data[start[i] : end[i]].tobytes().decode() for i in rest])
            size[rest] = [len(x) for x in ids]
            parts += ids
        order = np.argsort(np.concatenate([simple, rest]), kind="stable")
        sizes = size[np.concatenate([simple, rest])]
        return gathered(np.concatenate(parts), (np.cumsum(sizes) - sizes)[order], sizes[order]), size

    def _asked_in_one(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units with so many edges each, asked for in one string; None should its tokens not have these edges."""
        if self.kind == "words":
            string = b" ".join(data[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist(), strict=True))
        else:
            string = gathered(data, start, end - start).tobytes()
        (ids,) = self._asked([string.decode()])
        edge = np.flatnonzero(self._edge[ids])
        if len(edge) != edges.sum() or not len(ids):
            return None
        if self.kind == "words":
            cut = edge[np.cumsum(edges) - 1] + 1
            return (ids, np.diff(cut, prepend=0)) if cut[-1] == len(ids) else None
        return (ids, np.diff(edge, append=len(ids))) if edge[0] == 0 else None


def encoded(names: pa.Array, texts: pa.Array, path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Some documents' names, their ids in a row, and how many each has; null counts as empty."""
    for i, flat, sizes in ids_of(path).arrays(texts):
        yield names.slice(i, len(sizes)).to_pylist(), flat, sizes


def crc32(ids: np.ndarray) -> int:
    """Unsigned checksum of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4", copy=False))


def ids_of(path: str) -> Ids:
    """The tokenizer of this Python worker, with its memo."""
    return kept_in_worker(("ids", path), lambda: Ids(path))
