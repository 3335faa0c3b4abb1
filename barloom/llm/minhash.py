"""Near-duplicates by circulant MinHash: banded signatures find candidates, the sets themselves confirm the links.

A text's set holds the distinct n-grams of its words (two by default), as 64-bit hashes. Its signature takes two
permutations of the 32-bit ring: s places a gram, and p is shifted by one along the ring from coordinate to coordinate,
h_k(set) = min over grams of p(s(gram) - k). Both are bijections made of multiplications and shifts, so no table is kept.
BANDS bands of ROWS coordinates each are hashed; two sets share a band's bucket with the probability J ** ROWS, so the
chance that a link of J = 0.8 shares no bucket is (1 - 0.8 ** ROWS) ** BANDS, less than one in a hundred million; links are
confirmed on full sets, so nothing is linked by chance.

No bucket gives all its pairs. Equal sets are one class. In each bucket the classes first meet one leader, as many pairs as
entries; links give components. The leader is the class that meets most others in all its buckets together, which in a group
of edited copies is one of the least edited: so leaders don't depend on chance, are the same ones in most of a group's
buckets, and most copies link with them. Only buckets that still hold several components go on: a class meets those of other
components there, if their sizes and parity sketches (lower bounds of their difference, which never reject a link) allow one.
That join is on the bucket alone and may be skewed, which adaptive joins deal out; its filter stands in the join.

Defined results: null text and texts without words have an empty set and link with nothing; a text with fewer words than
n has its whole sequence as its one n-gram; rows that share a doc_id are one node, with the links of all their texts; rows
without a doc_id have no component and stay; other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import TO_LOWER, mix64, scratch, text_bytes, written
from barloom.llm.components import connected_components
from barloom.llm.jaccard_join import least_difference, token_sets

WORDS = 2
BANDS, ROWS = 48, 5
#: The threshold as a fraction.
NUM, DEN = 4, 5
#: Bytes of text whose words are hashed at once, and grams whose coordinates are made at once (a few arrays that fit a cache).
SLICE, BATCH = 1 << 20, 1 << 15
#: Cells of the sketch that entries of buckets with several components carry, in 64-bit columns.
FOLD = 1024
_FOLDS = [f"f{k}" for k in range(FOLD // 64)]


def _spread32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    with np.errstate(over="ignore"):
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            x ^= x >> np.uint32(shift)
            x *= np.uint32(factor)
        x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """One row of circulant MinHash coordinates for each set of 64-bit hashes (none of them empty)."""
    out = np.full((coordinates, len(sets)), np.uint32(0xFFFFFFFF))
    if not sets:
        return out.T
    ends = np.cumsum([len(s) for s in sets])
    grams = np.concatenate(sets)
    for lo in range(0, len(grams), BATCH):
        part = grams[lo : lo + BATCH]
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, lo + len(part) - 1, "right")
        starts = np.maximum(np.concatenate([[0], ends[first:last]]) - lo, 0)
        place = _spread32(part.astype(np.uint32) ^ np.uint32(0x5BD1E995))
        x = np.empty_like(place)
        for k in range(coordinates):
            np.subtract(place, np.uint32(k), out=x)
            own = np.minimum.reduceat(_spread32(x), starts)
            np.minimum(out[k, first : last + 1], own, out=out[k, first : last + 1])
    return out.T


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band of each signature, in which the band's number counts."""
    n, coordinates = signature.shape
    bands = signature.reshape(n, coordinates // rows, rows).astype(np.uint64)
    h = np.tile(mix64(np.arange(1, coordinates // rows + 1, dtype=np.uint64)), (n, 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return h


def _sets_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for b in batches:
        raw, at = text_bytes(b.column("text"))
        first = 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
            low = raw[at[first] : at[last]].tobytes().translate(TO_LOWER)
            yield b.column("doc_id").slice(first, last - first), token_sets(np.frombuffer(low, np.uint8), at[first : last + 1] - at[first], n)
            first = last


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _parity(s: np.ndarray) -> bytes:
    """One bit per cell: whether an odd number of grams falls into it; a power of two of cells, at least FOLD and twice the grams."""
    bits = FOLD
    while bits < 2 * len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _fold(sketch: bytes) -> bytes:
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > FOLD // 8:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _describe(words: int):
    """doc_id, n, digest of every row; the sketches and band hashes of sets that the task hasn't described before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, sets in _sets_of(batches, words):
            digests = [_digest(s) for s in sets]
            own = {d: k for k, d in enumerate(digests) if len(sets[k])}
            first = set(own.values())
            bands = dict(zip(own.values(), band_hashes(signatures([sets[k] for k in own.values()])).view(np.int64), strict=True))
            full = [k in first for k in range(len(sets))]
            sketches = [_parity(s) if f else None for s, f in zip(sets, full, strict=True)]
            columns = [docs, pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array([bands.get(k) for k in range(len(sets))], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "sketch", "bands"])

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        folds = np.frombuffer(b"".join(_fold(s) for s in b.column("sketch").to_pylist()), np.int64).reshape(-1, len(_FOLDS))
        yield pa.RecordBatch.from_arrays([b.column("rep"), *map(pa.array, np.ascontiguousarray(folds.T))], ["rep", *_FOLDS])


def _keyed_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets_of(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "grams"])

    return run


def _sketches_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches differ by no more than a link's sets may."""
    for b in batches:
        sizes = zip(b.column("an").to_pylist(), b.column("bn").to_pylist(), strict=True)
        keep = [(NUM + DEN) * least_difference(x, y) <= (DEN - NUM) * (m + n) for x, y, (m, n) in zip(b.column("asketch").to_pylist(), b.column("bsketch").to_pylist(), sizes, strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("agrams").to_pylist(), b.column("bgrams").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * DEN >= NUM * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, keep) -> DataFrame:
    """a, b of the pairs (a, b) whose sets link; only texts of sets whose sketches allow it are read again."""
    with scratch(pairs.sparkSession) as own:
        side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}sketch"))
        near = own(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "asketch", "bsketch").mapInArrow(_sketches_allow, "a long, b long"))
        ids = near.select(F.col("a").alias("rep")).union(near.select("b")).distinct()
        ids = own(classes.select("rep", "digest", "doc_id").join(ids, "rep", "left_semi"))
        sets = texts.join(ids.select("doc_id"), "doc_id", "left_semi").mapInArrow(_keyed_sets(words), "digest binary, grams binary")
        sets = own(sets.join(ids.select("rep", "digest"), "digest").groupBy("rep").agg(F.first("grams").alias("grams")))
        side = lambda x: sets.select(F.col("rep").alias(x), F.col("grams").alias(f"{x}grams"))
        met = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "agrams", "bgrams")
        return keep(met.mapInArrow(_linked, "a long, b long"))


def _class_components(classes: DataFrame, texts: DataFrame, edges: DataFrame, words: int, keep) -> DataFrame:
    """node, component of the classes that link or that edges join."""
    entries = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    several = entries.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    entries = keep(entries.join(several, "bucket"))

    # each entry against its bucket's leader
    met = entries.groupBy("rep").agg(F.sum("c").alias("met"))
    leaders = entries.join(met, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("met", "rep")).alias("lead"))
    stars = entries.join(leaders, "bucket").filter("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"))
    stars = keep(stars.distinct())
    first = _links(stars, classes, texts, words, keep)
    parts = connected_components(first.union(edges), keep)

    # pairs across components in buckets that still have several
    named = entries.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = keep(named.select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component")))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    left = keep(named.join(mixed, "bucket"))
    sketches = classes.select("rep", "sketch").join(left.select("rep").distinct(), "rep", "left_semi")
    folds = sketches.mapInArrow(_folded, f"rep long, {', '.join(f'{c} long' for c in _FOLDS)}")
    left = keep(left.join(folds, "rep"))
    x, y = (left.select("bucket", *(F.col(c).alias(s + c) for c in ("rep", "n", "component", *_FOLDS))) for s in "xy")
    apart = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in _FOLDS), F.lit(0))
    sizes = F.col("xn") + F.col("yn")
    may = (F.col("xrep") < F.col("yrep")) & (F.col("xcomponent") != F.col("ycomponent")) & (F.least("xn", "yn") * DEN >= F.greatest("xn", "yn") * NUM) & (apart * (NUM + DEN) <= sizes * (DEN - NUM))
    pairs = x.join(y, (x["bucket"] == y["bucket"]) & may).select(F.col("xrep").alias("a"), F.col("yrep").alias("b")).distinct()
    pairs = keep(pairs.join(stars, ["a", "b"], "left_anti"))
    return connected_components(parts.select("node", "component").union(_links(pairs, classes, texts, words, keep)), keep)


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text): a table in the shared folder."""
    with scratch(docs.sparkSession) as keep:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        told = keep(texts.mapInArrow(_describe(words), "doc_id long, n int, digest binary, sketch binary, bands array<long>"))
        full = told.filter("doc_id is not null and n > 0")
        # a set's sketch and bands come with one row of a task at least, which may not be that of the smallest doc_id
        classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch", True).alias("sketch"), F.first("bands", True).alias("bands"))
        classes = keep(classes.withColumn("rep", F.monotonically_increasing_id()))
        members = keep(full.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"))
        of_doc = members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
        edges = members.withColumnRenamed("rep", "b").join(of_doc.filter("rep <> other").select("doc_id", F.col("rep").alias("a")), "doc_id").select("a", "b")
        parts = _class_components(classes, texts.filter("doc_id is not null"), edges, words, keep)

        named = keep(classes.select("rep", "doc_id").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("component")))
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        component = of_doc.join(named.join(least, "component").select("rep", "component_id"), "rep").select("doc_id", "component_id")
        rows = told.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
        found = rows.join(component, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        return written(found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
