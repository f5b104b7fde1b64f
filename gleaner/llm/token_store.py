"""Token ids on disk with Elias-Fano document boundaries.

A store is one array of token ids, documents in ascending order of id, cut into shards of about SHARD_IDS ids at
document boundaries. A shard is a self-contained byte string, kept as a row of a Parquet table so that any file
system Spark writes to can hold it and lost tasks are written again by Spark's commit protocol.

Layout of a shard (little-endian): a header of 64-bit numbers (MAGIC, documents n, ids u, bytes an id, null document
ids, first document id), then two Elias-Fano codes, then
  ids     u x uint16 or uint32
The codes hold the document ends and the document ids (ascending, less the first; nulls come before). A code of n
ascending numbers up to m is (each with its size in a header of three numbers):
  low     the l low bits of each number, packed
  high    unary-coded high parts: bit (x >> l) + k is set for number k, in 64-bit words
  samples place of every SAMPLE-th set bit, uint32, so that select(k) reads a few words only
It takes n * (2 + log2(m / n)) bits, near the least possible, and no 64-bit table. ``Shard.end(k)`` and ``name(k)``
answer a single select; readers of whole shards use selects too.

Edge cases: a null text counts as empty and holds the end id only; null ids come first; rows that share an id follow
each other, by the first characters of their text; an id that very many rows share (null too) is dealt to several tasks;
an empty table gives an empty store; a document longer than a shard has one of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import documents, freed, partitions, staged
from gleaner.llm.tokens import crc32, encoded

MAGIC, SAMPLE = 0x32454647, 256
SHARD_IDS = 1 << 20
#: Characters of a text that order rows with one id.
PREFIX = 64
_HEADER, _CODE = "<6q", "<3q"
_SHARD = "part int, seq int, n_docs long, n_ids long, shard binary"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def elias_fano(x: np.ndarray) -> bytes:
    """Code of ascending numbers, the first of them 0 or more."""
    n, top = len(x), int(x[-1]) if len(x) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = ((x[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    places = (x >> low) + np.arange(n)
    words = (int(places[-1]) // 64 + 1) if n else 0
    high = np.zeros(words * 64, np.uint8)
    high[places] = 1
    samples = places[::SAMPLE].astype("<u4")
    return struct.pack(_CODE, low, words, len(samples)) + np.packbits(bits.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes() + samples.tobytes()


class EliasFano:
    """Reads a code of n numbers at a place of some bytes; ``size`` is the code's."""

    def __init__(self, data: bytes | pa.Buffer, n: int, at: int = 0):
        begin = at
        self.n = n
        self.low, words, samples = struct.unpack_from(_CODE, data, at)
        at += struct.calcsize(_CODE)
        parts = []
        for kind, size in (("u1", -(-n * self.low // 8)), ("u1", words * 8), ("<u4", samples)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        self._low, self._high, self._samples = parts
        self.size = at - begin

    def select(self, k: int) -> int:
        """Number k: one select, from the nearest sample on."""
        place = int(self._samples[k // SAMPLE])
        left = k % SAMPLE
        byte, skip = place // 8, place % 8
        left += int(_POPCOUNT[self._high[byte] & ((1 << skip) - 1)])  # set bits of this byte before the sample
        if left >= 16:  # some bytes at a time
            counts = np.cumsum(_POPCOUNT[self._high[byte : byte + SAMPLE * 2]], dtype=np.int64)
            whole = int(np.searchsorted(counts, left, "right"))
            left -= int(counts[whole - 1]) if whole else 0
            byte += whole
        while left >= (c := int(_POPCOUNT[self._high[byte]])):
            left -= c
            byte += 1
        high = int(self._high[byte])
        for _ in range(left):
            high &= high - 1
        place = byte * 8 + (high & -high).bit_length() - 1
        bit = k * self.low
        window = int.from_bytes(self._low[bit // 8 : (bit + self.low + 7) // 8].tobytes(), "little")
        return ((place - k) << self.low) | ((window >> (bit % 8)) & ((1 << self.low) - 1))


def encode_shard(names: list[int | None], ids: list[np.ndarray]) -> bytes:
    """Bytes of a shard from documents' ids (their end ids with them), null names first, then ascending."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    known = [x for x in names if x is not None]
    first, width = known[0] if known else 0, ids[0].itemsize if ids else 2
    header = struct.pack(_HEADER, MAGIC, len(names), int(ends[-1]) if len(ends) else 0, width, len(names) - len(known), first)
    return b"".join([header, elias_fano(ends), elias_fano(np.array([x - first for x in known], np.int64)), *ids])


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes | pa.Buffer):
        magic, self.n, u, width, self.nulls, self.first = struct.unpack_from(_HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEADER)
        self._ends = EliasFano(data, self.n, at)
        at += self._ends.size
        self._names = EliasFano(data, self.n - self.nulls, at)
        self.ids = np.frombuffer(data, f"<u{width}", u, at + self._names.size)

    def end(self, k: int) -> int:
        """Where document k ends."""
        return self._ends.select(k)

    def name(self, k: int) -> int | None:
        """The id of document k."""
        return None if k < self.nulls else self.first + self._names.select(k - self.nulls)

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.end(k - 1) if k else 0 : self.end(k)]


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    names: list[int | None] = []
    ids: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()), pa.array([encode_shard(names, ids)], pa.binary())], ["part", "seq", "n_docs", "n_ids", "shard"])

    for some, flat, sizes in (x for b in batches for x in encoded(b.column(0), b.column(1), path)):
        # each document is followed by the end id
        flat, sizes = np.insert(flat, np.cumsum(sizes), end_id), sizes + 1
        at = 0
        for name, n in zip(some, sizes.tolist(), strict=True):
            if names and held + n > shard_ids:
                yield out()
                names, ids, held, seq = [], [], 0, seq + 1
            names.append(name)
            ids.append(flat[at : at + n])
            at, held = at + n, held + n
    if names:
        yield out()


def write_store(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, folder: str | None = None) -> DataFrame:
    """Writes the store (to ``folder``, else to the shared work folder) and returns it: part, seq, n_docs, n_ids, shard.

    (part, seq) is the order of the array. Texts move once, dealt by ranges of their id; ids never move.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = (F.asc_nulls_first("id"), F.asc("head"), F.asc("row"))
    rows = rows.select("id", "text", F.substring("text", 1, PREFIX).alias("head"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("id", "text")
    shards = ordered.mapInArrow(freed(lambda it: _shards(it, tokenizer, end_id, shard_ids)), _SHARD)
    if folder is None:
        return staged(shards, "token-store")
    shards.write.parquet(folder)
    return docs.sparkSession.read.schema(_SHARD).parquet(folder)


def bases(store: DataFrame) -> DataFrame:
    """part, seq and ``base``: ids before each shard. Only two numbers a shard are summed, first by part."""
    sizes = store.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row a partition of the writer
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.select("part", "seq", within.alias("within")).join(before, "part").select("part", "seq", (F.col("within") + F.col("before")).alias("base"))


_DIGEST = "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            s = Shard(data.as_buffer())
            cuts = [0, *map(s.end, range(s.n))]
            starts = np.array(cuts[:-1], np.int64)
            crc = [crc32(s.ids[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            same = [pa.array(np.full(s.n, x, np.int32)) for x in (part, seq)]
            names = pa.array(map(s.name, range(s.n)), pa.int64())
            yield pa.record_batch([*same, names, pa.array(starts), pa.array(np.diff(np.array(cuts, np.int64))), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])


def digest(store: DataFrame) -> DataFrame:
    """Each document's place, length and checksum, read back from the store's shards (which don't move)."""
    found = store.select("part", "seq", "shard").mapInArrow(freed(_digest), _DIGEST)
    return found.join(bases(store), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(write_store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))
