"""Exact deduplication by content-defined chunk recipes.

A rolling hash cuts every normalised text into chunks whose bounds depend on the content alone. Chunks
become identifiers, a text becomes the ordered list of its chunks' identifiers (its recipe), and texts are
equal exactly when their recipes are. Only digests and identifiers are shuffled; a text is read once.

Defined results: null text counts as empty; empty texts are equal to each other; of repeated rows (same
doc_id, equal text) one stays; a null doc_id ranks below all others; only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import TO_LOWER, lower_ascii, mix64, text_bytes, written

#: Chunk sizes in bytes: cuts fall after MIN at the earliest, after MIN + MEAN on average, at MAX at the latest.
MIN, MEAN, MAX = 256, 1024, 8192
_GEAR = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the 32 bytes before allows a cut."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return np.flatnonzero((h >> np.uint32(8)) % np.uint32(MEAN) == 0) + 1


def chunk_ends(start: int, end: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of one text, given the allowed cuts inside it."""
    out, last = [], start
    for c in cuts:
        while c - last > MAX:
            last += MAX
            out.append(last)
        if c - last >= MIN and c < end:
            last = c
            out.append(c)
    while end - last > MAX:
        last += MAX
        out.append(last)
    return [*out, end] if end > last else out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, at = text_bytes(b.column("text"))
        low = raw.tobytes().translate(TO_LOWER)
        cuts = cut_points(np.frombuffer(low, np.uint8))
        lo, hi = np.searchsorted(cuts, at[:-1], "right"), np.searchsorted(cuts, at[1:], "left")
        cuts, view = cuts.tolist(), memoryview(low)
        whole, chunks, ends = [], [], [0]
        for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            whole.append(hashlib.sha256(view[s:e]).hexdigest())
            last = s
            for c in chunk_ends(s, e, cuts[lo[k] : hi[k]]):
                chunks.append(hashlib.sha256(view[last:c]).digest())
                last = c
            ends.append(len(chunks))
        full = pa.array(chunks, pa.binary())
        short = np.frombuffer(b"".join(d[:8] for d in chunks), "<i8")
        pairs = pa.StructArray.from_arrays([pa.array(short, pa.int64()), full], ["short", "full"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(whole, pa.string()), lists], ["row", "doc_id", "text_sha256", "chunks"])


def recipes(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_sha256 and recipe (ordered chunk identifiers) of every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    digests = written(rows.mapInArrow(_digests, f"row long, doc_id {kind}, text_sha256 string, chunks array<struct<short: long, full: binary>>"))
    chunks = digests.select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk")).select("row", "doc_id", "text_sha256", "pos", "chunk.*")
    # an identifier is 8 bytes of the digest and, should different chunks share those, the chunk's rank among them
    known = chunks.filter("short is not null").select("short", "full").distinct()
    known = known.withColumn("rank", F.dense_rank().over(Window.partitionBy("short").orderBy("full")))
    named = chunks.join(known, ["short", "full"], "left")
    part = F.when(F.col("pos").isNotNull(), F.struct("pos", "short", "rank"))
    return named.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(part)).alias("recipe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs: of equal texts the largest doc_id stays."""
    told = recipes(docs)
    best = told.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    joined = told.join(best, "recipe")
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def keep_largest(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns, of any names; rows with one doc_id and equal texts become one of them."""
    stay = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_digest"))
    digest = F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)
    told = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest.alias("digest"))
    # by text too: a doc_id may have several, of which only some stay
    left = told.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest")), "left_semi")
    return left.dropDuplicates(["id", "digest"]).select("row.*")
