"""Sets of hashed word shingles of many texts at once, in numpy.

Texts are lower-cased (A-Z only) and cut at the bytes 0x20 and 0x09 to 0x0D. A word's hash is a polynomial of its
bytes modulo 2^64, read off a running sum over a chunk of text; a shingle's hash combines its words' hashes. All
hashes are 64 bits and pass a finaliser, so that any of their bits may be used by themselves.

Memory: bytes are handled CHUNK at a time, with tables of that size made once. A longer text is cut at blanks, a longer
word into parts; what grows with a text is its set alone, 8 bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes of text handled at a time.
CHUNK = 1 << 18

_U = np.uint64
_M, _C = 0x9E3779B97F4A7C15 | 1, _U(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: A byte's value; A-Z have that of their lower case.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]


def _powers(m: int) -> np.ndarray:
    t = np.full(CHUNK + 1, m, np.uint64)
    t[0] = 1
    return np.multiply.accumulate(t)


_UP, _DOWN = _powers(_M), _powers(pow(_M, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words of at most CHUNK bytes that end with a blank."""
    blank = _BLANK[data]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=total[1:])
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    return mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64) * _C), start


def _long_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, a chunk at a time."""
    total, step = 0, pow(_M, CHUNK, 1 << 64)
    for i in reversed(range(0, len(data), CHUNK)):
        part = data[i : i + CHUNK]
        total = (total * step + int((_BYTE[part] * _UP[: len(part)]).sum())) % (1 << 64)
    return mix(np.array([total], np.uint64) + np.array([len(data)], np.uint64) * _C)


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of all words of bytes that end with a blank."""
    if len(data) <= CHUNK:
        return _words_of(data) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        blanks = np.flatnonzero(_BLANK[data[at:end]])
        if len(blanks):
            end = at + int(blanks[-1]) + 1
            h, start = _words_of(data[at:end])
            out.append((h, start + at))
        else:
            while not _BLANK[data[end]]:  # the last byte is a blank
                more = np.flatnonzero(_BLANK[data[end : end + CHUNK]])
                end = end + int(more[0]) if len(more) else min(len(data) - 1, end + CHUNK)
            out.append((_long_word(data[at:end]), np.array([at])))
        at = end
    return np.concatenate([h for h, _ in out]), np.concatenate([s for _, s in out])


class Sets:
    """Distinct shingles of a few texts: ``hashes`` ascending within each text, text i's from ``at[i]`` to ``at[i+1]``."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, words: int = WORDS):
        """data: the texts' bytes, each followed by one blank; lengths: of the texts with that blank."""
        h, start = hashed_words(data)
        first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
        count = np.diff(first)  # words of each text
        if len(h) >= words:
            s = h[: len(h) - words + 1].copy()
            for k in range(1, words):
                s *= _C
                s += h[k : len(h) - words + 1 + k]
            s = mix(s)
        else:
            s = np.zeros(0, np.uint64)
        out, sizes = [], np.zeros(len(lengths), np.int64)
        none = np.zeros(0, np.uint64)
        for i, (a, w) in enumerate(zip(first[:-1].tolist(), count.tolist(), strict=True)):
            if w >= words:
                x = np.sort(s[a : a + w - words + 1])
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x if keep.all() else x[keep]
            elif w:
                x = np.array([w], np.uint64)
                for k in range(a, a + w):
                    x = x * _C + h[k : k + 1]
                x = mix(x)
            else:
                x = none
            out.append(x)
            sizes[i] = len(x)
        self.hashes = np.concatenate(out) if out else none
        self.sizes = sizes
        self.at = np.concatenate([[0], np.cumsum(sizes)])

    def names(self) -> np.ndarray:
        """A 128-bit digest of each set as two 64-bit numbers (zeros for an empty one)."""
        full = self.sizes > 0
        out = np.zeros((len(self.sizes), 2), np.uint64)
        if full.any():
            at = self.at[:-1][full]
            x = mix(self.hashes + _C)
            out[full, 0] = mix(np.bitwise_xor.reduceat(x, at) + self.sizes[full].astype(np.uint64))
            out[full, 1] = mix(np.add.reduceat(x * x | _U(1), at))
        return out


def in_chunks(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, Sets]]:
    """(ids, sets) of a batch, a bounded number of bytes at a time; null counts as empty."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(raw):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lengths = np.diff(offsets[i : j + 1])
        chunk = np.insert(data[offsets[i] : offsets[j]], np.cumsum(lengths), 32)
        yield ids.slice(i, j - i), Sets(chunk, lengths + 1)
        i = j
