"""Token ids in wavelet-matrix shards.

Texts are encoded in ascending doc_id order and packed into shards. A shard stores its ids as a wavelet
matrix: one bit-plane per bit of an id, each plane's zeros stably before its ones, with cumulative counts
that make rank and select quick. From that one structure come the token at a position, how often a token
occurs before a position, and where its k-th occurrence is. Every shard is one compressed Parquet file in
the folder it is written to, so any store that Spark can reach will do.

Defined results: null text is an empty text (only the end id); of equal doc_ids (repeated rows, null ids,
which come first) the smaller text comes first; a text longer than a shard makes that shard longer; empty
input makes no shards and no rows; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import text_bytes
from barloom.llm.tokens import default_path, encoder

#: Ids in a shard, after which the next text begins another.
SHARD_IDS = 1 << 21
BITS = 16
#: The id after each document.
END_ID = 2
_BLOCK = 512


class WaveletMatrix:
    """A sequence of ids below 2 ** 16 with access, rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        x, n, zeros, planes, ranks = ids.astype(np.uint16), len(ids), [], [], []
        for level in range(BITS):
            bit = (x & np.uint16(1 << (BITS - 1 - level))).astype(bool)
            none, some = np.flatnonzero(~bit), np.flatnonzero(bit)
            plane = np.packbits(bit)
            planes.append(plane)
            zeros.append(len(none))
            # ones before each block of 512 bits
            ranks.append(np.searchsorted(some, np.arange(0, n + 1, _BLOCK)).astype(np.uint32))
            after = np.empty(n, np.uint16)
            x.take(none, out=after[: len(none)], mode="clip")
            x.take(some, out=after[len(none) :], mode="clip")
            x = after
        return cls(n, zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, *self.zeros], "<i8").tobytes()
        return head + b"".join(p.tobytes() for p in self.planes) + b"".join(r.astype("<u4").tobytes() for r in self.ranks)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        head = np.frombuffer(blob, "<i8", BITS + 1)
        n, size, blocks, at = int(head[0]), (int(head[0]) + 7) // 8, int(head[0]) // _BLOCK + 1, 8 * (BITS + 1)
        planes = [np.frombuffer(blob, np.uint8, size, at + k * size) for k in range(BITS)]
        at += BITS * size
        return cls(n, head[1:].tolist(), planes, [np.frombuffer(blob, "<u4", blocks, at + 4 * k * blocks) for k in range(BITS)])

    def to_ids(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        x = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            bit, z = np.unpackbits(self.planes[level], count=self.n).view(bool), self.zeros[level]
            before = np.empty(self.n, np.uint16)
            before[np.flatnonzero(~bit)] = x[:z]
            before[np.flatnonzero(bit)] = x[z:] | np.uint16(1 << (BITS - 1 - level))
            x = before
        return x

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // _BLOCK
        rest = np.unpackbits(self.planes[level][block * _BLOCK // 8 : (i + 7) // 8], count=i - block * _BLOCK)
        return int(self.ranks[level][block]) + int(rest.sum())

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for level in range(BITS):
            one = self.planes[level][i >> 3] >> (7 - (i & 7)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if one else i - ones
            out = out << 1 | int(one)
        return out

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        lo = 0
        for level in range(BITS):
            a, b = self._ones(level, lo), self._ones(level, i)
            lo, i = (self.zeros[level] + a, self.zeros[level] + b) if token >> (BITS - 1 - level) & 1 else (lo - a, i - b)
        return i - lo

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of token; -1 where there are fewer."""
        lo, path = 0, []
        for level in range(BITS):
            one, a = token >> (BITS - 1 - level) & 1, self._ones(level, lo)
            lo = self.zeros[level] + a if one else lo - a
            path.append(one)
        if not 0 <= k < self.rank(token, self.n):
            return -1
        i = lo + k
        for level in range(BITS - 1, -1, -1):
            i = self._where(level, path[level], i - self.zeros[level] if path[level] else i)
        return i

    def _where(self, level: int, one: int, k: int) -> int:
        """The position of the k-th bit (from 0) of a plane that equals one."""
        starts = np.arange(len(self.ranks[level])) * _BLOCK
        counts = self.ranks[level].astype(np.int64) if one else np.minimum(starts, self.n) - self.ranks[level]
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], count=min(_BLOCK, self.n - block * _BLOCK))
        return block * _BLOCK + int(np.flatnonzero(bits == one)[k - int(counts[block])])


_SHARD_SCHEMA = "part long, shard long, n_ids long, doc_ids array<long>, lengths array<long>, matrix binary"


def _shards(path: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, docs, parts, held = TaskContext.get().partitionId(), 0, [], [], 0
        enc = encoder(path)
        end = np.array([END_ID], "<u2").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal made, docs, parts, held
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u2"))
            arrays = [[part], [made], [held], [docs], [[len(p) // 2 for p in parts]], [matrix.to_bytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], ["part", "shard", "n_ids", "doc_ids", "lengths", "matrix"])
            made, docs, parts, held = made + 1, [], [], 0
            return out

        for b in batches:
            raw, at = text_bytes(b.column("text"))
            view = raw.tobytes()
            for doc, s, e in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                docs.append(doc)
                parts.append(enc.encode(view[s:e]) + end)
                held += len(parts[-1]) // 2
                if held >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs in ascending doc_id order into wavelet-matrix shards, one compressed file each."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_shards(tokenizer_path or default_path(), shard_ids), _SHARD_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, shard, docs, lengths, matrix in zip(*(b.column(c).to_pylist() for c in ("part", "shard", "doc_ids", "lengths", "matrix")), strict=True):
            ids = WaveletMatrix.from_bytes(matrix).to_ids().astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array([shard] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone."""
    shards = spark.read.schema(_SHARD_SCHEMA).parquet(folder)
    docs = shards.mapInArrow(_documents, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # ids before each part (as many as there were tasks), then before each shard of it
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before_part"))
    before = shards.select("part", "shard", "n_ids").join(parts, "part")
    before = before.select("part", "shard", (F.col("before_part") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("before"))
    return docs.join(before, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _occurrences(token: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, docs, lengths, matrix in zip(*(b.column(c).to_pylist() for c in ("part", "shard", "doc_ids", "lengths", "matrix")), strict=True):
                m, ends = WaveletMatrix.from_bytes(matrix), np.cumsum(lengths)
                n = m.rank(token, m.n)
                for first in range(0, n, most):
                    at = np.array([m.select(token, k) for k in range(first, min(n, first + most))])
                    doc = np.searchsorted(ends, at, "right")
                    yield pa.RecordBatch.from_arrays([pa.array([docs[d] for d in doc], pa.int64()), pa.array(at - (ends - lengths)[doc], pa.int64())], ["doc_id", "position"])

    return run


def token_occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """doc_id and position of every occurrence of a token, by rank and select in each shard."""
    return spark.read.schema(_SHARD_SCHEMA).parquet(folder).mapInArrow(_occurrences(token, 10_000), "doc_id long, position long")


def _counts(token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [(m := WaveletMatrix.from_bytes(x)).rank(token, m.n) for x in b.column("matrix").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("shard"), pa.array(counts, pa.int64())], ["part", "shard", "occurrences"])

    return run


def token_counts(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """part, shard and how often the token occurs there."""
    return spark.read.schema(_SHARD_SCHEMA).parquet(folder).mapInArrow(_counts(token), "part long, shard long, occurrences long")
