"""Words of many texts at once, in Arrow arrays: cut at the bytes 0x20 and 0x09 to 0x0D, or at bytes of one's own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.llm.common import in_stretches

#: Bytes of text (or one text) whose words are handled at a time.
SLICE = 4 << 20


def whole(texts: pa.Array) -> pa.Array:
    """Texts as bytes; null is empty."""
    return pc.fill_null(texts.cast(pa.large_binary()), b"")


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has (``whole``), and the words of all."""
    parts = pc.ascii_split_whitespace(texts.view(pa.large_string()))
    words = parts.flatten().view(pa.large_binary())
    full = pc.greater(pc.binary_length(words), 0)
    at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    return np.diff(at), words.filter(full)


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Texts (``whole``) with each byte replaced by its entry of a table of 256."""
    if not len(texts):
        return texts
    offsets, data = bounds(texts)
    buffers = [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data[offsets[0] : offsets[-1]].tobytes().translate(table))]
    return pa.Array.from_buffers(pa.large_binary(), len(texts), buffers)


def bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts (large binary) begin, and the last ends, in the bytes that come second."""
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    return np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def counted(texts: pa.Array, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each text the table ``mask`` (256 truth values) marks."""
    offsets, data = bounds(texts)
    data = data[offsets[0] : offsets[-1]]
    return np.diff(np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])[offsets - offsets[0]])


def codes(words: pa.Array) -> np.ndarray:
    """A number for each word, the same for equal words of this array."""
    return words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)


def sliced(b: pa.RecordBatch, texts: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes (or one text) in a column of texts."""
    sizes = pc.fill_null(pc.binary_length(b.column(texts)), 0).to_numpy(zero_copy_only=False)
    for i, j in in_stretches(sizes, most):
        yield b.slice(i, j - i)


def repeated(code: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, run) of the stretches of ``width`` words that their text has twice or more; equal ones share a number.

    ``owner`` (ascending) is the text of each word. Stretches are sorted by 64-bit hashes; two different stretches
    of one text with equal hashes would count as equal, which ``exactly_repeated`` rules out.
    """
    n = len(code) - width + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _mixed(code.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    h = _mixed(h ^ _mixed(owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    inside = np.flatnonzero(owner[:n] == owner[width - 1 :])
    h = h[inside]
    order = np.argsort(h, kind="stable")
    h = h[order]
    equal = h[1:] == h[:-1]
    some = np.concatenate([equal, [False]]) | np.concatenate([[False], equal]) if len(h) else np.zeros(0, bool)
    run = np.cumsum(np.concatenate([[True], ~equal])) if len(h) else np.zeros(0, np.int64)
    return inside[order[some]], run[some]


def exactly_repeated(code: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Places of the stretches that their text has twice or more: hashes propose them, their words decide."""
    at, run = repeated(code, owner, width)
    same = run[1:] == run[:-1]
    differ = np.zeros(max(len(at) - 1, 0), bool)
    for k in range(width):
        differ |= code[at[1:] + k] != code[at[:-1] + k]
    if not (same & differ).any():
        return at
    kinds: dict[tuple, list[int]] = {}
    for i in at.tolist():
        kinds.setdefault((int(owner[i]), *code[i : i + width].tolist()), []).append(i)
    return np.array(sorted(i for some in kinds.values() if len(some) > 1 for i in some), np.int64)


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a stretch of ``width`` that begins at one of the places."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:n]) > 0


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
