"""Exact self-join of texts on the Jaccard similarity of their word n-grams, by set relations.

A text's set holds the distinct n-grams of its words. Two texts link when their sets' similarity reaches a
threshold, and the links' connected components are the result. All sets follow one order of tokens, frequent
ones last, so that every link shares a token within both sets' prefixes (the first n - ceil(t * n) + 1 tokens).
A pair's first common token bounds its overlap: no more than n - pos tokens of either set are left. Work is saved
by relations between sets:

- Equal sets are one class, and classes are formed before the index.
- Index-level skipping. A token's list is dealt into blocks by size, room (n - pos) and a bounded number of
  entries. Blocks meet as wholes: a pair of blocks whose sizes, largest rooms or single component rule out every
  pair of their entries is skipped, and only pairs of the others are looked at one by one, inside the block.
- Answer-level skipping. Each list's sets first meet the list's leaders only (one for each size class, the set that
  meets most others), as many pairs as entries; those of a leader that don't link with it meet a few hubs, the ones nearest to it among
  themselves and among those that do. Sets that link get one component, and only pairs across components are left.
  Where two sets have one leader R that is like both, their pair isn't taken from the lists: with m tokens of R missing and tokens added,
  |A & B| = |R| - |mA | mB| + |aA & aB| is derived from the answers with R. If A doesn't link with R, then A and any
  B of R that it links with share at least needed(A, B) - |R| + |mA| + |mB| > 0 of their differences from R. So
  the differences have an index of their own, whose prefixes and rooms follow from that number, and no text is read.

Tokens are 64-bit hashes: words by their length and bytes, eight at a time (long words by XXH3), mixed by position.
Pairs from the lists are tested by parity sketches (which never reject a link), inside the blocks already, then by the
sets themselves. Texts are tokenised once to describe and count them, once for prefixes, and where pairs are tested.

Defined results: null text and texts without words have an empty set and link with nothing; a text with
fewer words than n has its whole sequence as its one n-gram; equal texts link; rows that share a doc_id are one
node, with the links of all their texts; rows without a doc_id have no component; only doc_id and text are
read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_BYTES, TO_LOWER, mix64, scratch, text_bytes, word_spans, written
from barloom.llm.components import connected_components

#: What writes a table that is read again.
Keep = Callable[[DataFrame], DataFrame]
WORDS = 5
#: The threshold as a fraction, 80 / 100, and how like its leader a set is at least, 60 / 100.
NUM, DEN = 4, 5
LEAD_NUM, LEAD_DEN = 3, 5
#: Tokens that come last in the order of prefixes, the most frequent ones: 2 MB in every task. Which they are changes no result.
COMMON = 1 << 17
#: Bytes of text whose words are hashed at once; the arrays take about 50 times as much.
SLICE = 1 << 20
#: Tokens of sets that are counted together: 8 MB, and three times as much to sort them.
WINDOW = 1 << 20
#: Entries of a block, about, and cells of the sketches that they carry.
BLOCK, FOLD = 64, 256
#: Sets which those that don't link with their leader meet: so many of these themselves, and of those that link with it.
HUBS = 8
_FOLDS = [f"f{k}" for k in range(FOLD // 64)]
#: Bytes of the longest words that are hashed eight bytes at a time, all such words at once.
CHAINED = 64
#: Pairs of entries that are looked at together: some 30 MB of arrays.
PAIRS = 1 << 18
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Which bits of eight bytes are those of the first 0 to 8 of them.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The second key of tokens' lists; lists of differences have their leader there (or its complement, for missing tokens).
_TOKENS = -(1 << 63)


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: of its length and its bytes, eight at a time; XXH3 of words of more than CHAINED bytes."""
    size = ends - starts
    # the eight bytes from every place on, of which a word's own are kept
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    out, some = mix64(size), np.arange(len(size))
    with np.errstate(over="ignore"):
        for at in range(0, CHAINED, 8):
            some = some[size[some] > at]
            if not len(some):
                break
            out[some] = mix64(out[some] * _STEP + (eight[starts[some] + at] & _FIRST[np.minimum(size[some] - at, 8)]))
    for k in np.flatnonzero(size > CHAINED).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].tobytes())
    return out


def token_sets(raw: np.ndarray, at: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; raw is lower-cased."""
    starts, ends, first = word_spans(raw, at)
    h = word_digests(raw, starts, ends)
    with np.errstate(over="ignore"):
        grams = h[: max(0, len(h) - n + 1)].copy()
        for k in range(1, n):
            grams = mix64(grams * _STEP + h[k : len(h) - n + 1 + k])
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= n:
                g = np.sort(grams[lo : hi - n + 1])
                out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
            elif hi > lo:
                x = np.array([hi - lo], np.uint64)
                for w in h[lo:hi]:
                    x = mix64(x * _STEP + w)
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """The doc_ids and sets of the texts, about SLICE bytes of text at a time."""
    for b in batches:
        raw, at = text_bytes(b.column("text"))
        first = 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
            low = raw[at[first] : at[last]].tobytes().translate(TO_LOWER)
            yield b.column("doc_id").slice(first, last - first), token_sets(np.frombuffer(low, np.uint8), at[first : last + 1] - at[first])
            first = last


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit per cell: whether an odd number of tokens falls into it; a power of two of cells, at least len(s) and FOLD."""
    bits = FOLD
    while bits < len(s):
        bits *= 2
    cells = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their parity sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded(sketch: bytes) -> bytes:
    """A sketch of FOLD cells from a larger one."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > FOLD // 8:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_TOLD: a row for each text and, without n, one for each token that several different sets of about WINDOW tokens have."""
    own: dict[bytes, np.ndarray] = {}
    held = 0

    def rows(**cols: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(size, f.type) for f in _TOLD], schema=_TOLD)

    def told() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]), return_counts=True)
        some = counts > 1
        return rows(token=pa.array(tokens[some].view(np.int64)), sets=pa.array(counts[some]))

    for docs, sets in _sets_of(batches):
        digests, sketches = [_digest(s) for s in sets], [parity_sketch(s) for s in sets]
        folds = np.ascontiguousarray(np.frombuffer(b"".join(map(folded, sketches)), np.int64).reshape(-1, len(_FOLDS)).T)
        yield rows(doc_id=docs, n=pa.array([len(s) for s in sets], pa.int32()), digest=pa.array(digests, pa.binary()), sketch=pa.array(sketches, pa.binary()), **dict(zip(_FOLDS, map(pa.array, folds), strict=True)))
        for key, s in zip(digests, sets, strict=True):
            if len(s) and key not in own:
                own[key] = s
                held += len(s)
        if held > WINDOW:
            yield told()
            own.clear()
            held = 0
    yield told()


_TOLD = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("sketch", pa.binary()), *((c, pa.int64()) for c in _FOLDS), ("token", pa.int64()), ("sets", pa.int64())])


def _prefixes(shared):
    """Each different set's prefix, in the order of tokens: those that aren't common by value, then by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = np.frombuffer(shared.value, np.uint64)  # from the most frequent one
        order = np.argsort(ranked, kind="stable")
        common = ranked[order]
        for _, sets in _sets_of(batches):
            own, parts = {s.tobytes(): s for s in sets if len(s)}.values(), []
            for s in own:
                at = np.searchsorted(common, s)
                at[at == len(common)] = 0
                late = common[at] == s if len(common) else np.zeros(len(s), bool)
                parts.append(np.concatenate([s[~late], s[late][np.argsort(-order[at[late]], kind="stable")]])[: len(s) - (NUM * len(s) + DEN - 1) // DEN + 1])
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in own], pa.binary()), tokens], ["digest", "tokens"])

    return run


def _reaches(overlap: Column, sizes: Column, num: int = NUM, den: int = DEN) -> Column:
    """Whether an overlap is that of a similarity of num / den, for sets with so many tokens in all."""
    return overlap * (num + den) >= sizes * num


def _sketch_test(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            an, bn = b.column("an").to_pylist(), b.column("bn").to_pylist()
            keep = [(num + den) * least_difference(x, y) <= (den - num) * (m + n) for x, y, m, n in zip(b.column("asketch").to_pylist(), b.column("bsketch").to_pylist(), an, bn, strict=True)]
            yield b.select(["a", "b", "an", "bn"]).filter(pa.array(keep, pa.bool_()))

    return run


def _keyed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _sets_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "tokens"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlaps of pairs of sets and, where a is like b's leader, what b lacks of a and has besides."""
    for b in batches:
        overlap, missing, added = [], [], []
        for x, y in zip(b.column("atokens").to_pylist(), b.column("btokens").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.intersect1d(x, y, assume_unique=True)
            like = len(both) * (LEAD_NUM + LEAD_DEN) >= LEAD_NUM * (len(x) + len(y))
            overlap.append(len(both))
            missing.append(np.setdiff1d(x, both, assume_unique=True).tobytes() if like else None)
            added.append(np.setdiff1d(y, both, assume_unique=True).tobytes() if like else None)
        yield pa.RecordBatch.from_arrays([*b.select(["a", "b", "an", "bn"]).columns, pa.array(overlap, pa.int64()), pa.array(missing, pa.binary()), pa.array(added, pa.binary())], ["a", "b", "an", "bn", "overlap", "missing", "added"])


def _tested(pairs: DataFrame, classes: DataFrame, texts: DataFrame, keep: Keep, num: int = NUM, den: int = DEN) -> DataFrame:
    """a, b, an, bn, overlap, missing, added of the pairs (a, b, an, bn) whose sketches allow a similarity of num / den."""
    with scratch(pairs.sparkSession) as own:
        side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"{x}sketch"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "asketch", "bsketch")
        near = own(near.mapInArrow(_sketch_test(num, den), "a long, b long, an int, bn int"))
        ids = near.select(F.col("a").alias("rep")).union(near.select("b")).distinct()
        ids = own(classes.select("rep", "digest", "doc_id").join(ids, "rep", "left_semi"))
        sets = texts.join(ids.select("doc_id"), "doc_id", "left_semi").mapInArrow(_keyed_sets, "digest binary, tokens binary")
        sets = own(sets.join(ids.select("rep", "digest"), "digest").groupBy("rep").agg(F.first("tokens").alias("tokens")))
        side = lambda x: sets.select(F.col("rep").alias(x), F.col("tokens").alias(f"{x}tokens"))
        met = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "atokens", "btokens")
        return keep(met.mapInArrow(_met, "a long, b long, an int, bn int, overlap long, missing binary, added binary"))


def _links(tested: DataFrame) -> DataFrame:
    return tested.filter(_reaches(F.col("overlap"), F.col("an") + F.col("bn"))).select("a", "b")


def _leaders(tested: DataFrame) -> DataFrame:
    """rep, n, lead, base, missing, added, far of the sets that have a leader: base is its size, far sets don't link with it."""
    best = tested.filter("missing is not null").groupBy(F.col("b").alias("rep")).agg(F.min(F.struct("a", "an", "bn", "overlap", "missing", "added")).alias("x"))
    far = ~_reaches(F.col("x.overlap"), F.col("x.an") + F.col("x.bn"))
    return best.select("rep", F.col("x.bn").alias("n"), F.col("x.a").alias("lead"), F.col("x.an").alias("base"), "x.missing", "x.added", far.alias("far"))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets' differences from their leaders, token by token; upto: how many of them a set's prefix has."""
    for b in batches:
        cols = [[] for _ in range(8)]
        for r in b.to_pylist():
            added, missing = np.frombuffer(r["added"], np.int64), np.frombuffer(r["missing"], np.int64)
            a, m = len(added), len(missing)
            # what links of the set share of their differences at least: needed - base + the numbers of both sets' missing tokens
            nine = NUM * (r["n"] + r["base"]) - (NUM + DEN) * (r["base"] - m) if r["far"] else NUM * a + DEN * m + 1
            upto = max(0, a + m - max(1, -(-nine // (NUM + DEN))) + 1)
            leads = np.where(np.arange(a + m) < a, r["lead"], ~r["lead"])
            for c, v in zip(cols, (np.concatenate([added, missing]), leads, *(np.full(a + m, v) for v in (r["rep"], r["n"], a + m, m, r["base"], upto))), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in cols], _DIFFERENCE)


_DIFFERENCE = ["k1", "k2", "rep", "n", "size", "extra", "base", "upto"]


def _difference_lists(lead: DataFrame, keep: Keep) -> DataFrame:
    """Prefixes of the sets' differences from their leaders, those that few sets of the leader have first, as _ENTRY."""
    told = keep(lead.mapInArrow(_differences, ", ".join(f"{c} long" for c in _DIFFERENCE)))
    sets = told.groupBy("k1", "k2").agg(F.count("*").alias("sets"))
    pos = F.row_number().over(Window.partitionBy("rep").orderBy("sets", "k2", "k1")) - 1  # no more than two sets' tokens
    return told.join(sets, ["k1", "k2"]).withColumn("pos", pos).filter("pos < upto").withColumn("room", F.col("size") - F.col("pos")).select(*_ENTRY)


_ENTRY = ["k1", "k2", "rep", "n", "room", "extra", "base"]
_ITEM = ["rep", "n", "room", "extra", "component", "lead"]


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of entries of two blocks that may link, many small blocks at once."""
    for b in batches:
        sides, bases, owns = [], b.column("base").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)
        for name in ("xs", "ys"):
            lists = b.column(name)
            items = lists.flatten()
            folds = np.stack([items.field(c).to_numpy() for c in _FOLDS], 1).view(np.uint64)
            sides.append(([items.field(c).fill_null(-1).to_numpy() for c in _ITEM], folds, np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])))
        (xs, xfold, xat), (ys, yfold, yat) = sides
        (rx, nx, ox, ex, cx, lx), (ry, ny, oy, ey, cy, ly) = xs, ys
        high = np.diff(yat)
        until = np.concatenate([[0], np.cumsum(np.diff(xat) * high)])
        first = 0
        while first < len(bases):
            last = max(first + 1, int(np.searchsorted(until, until[first] + PAIRS, "right")) - 1)
            k = np.repeat(np.arange(first, last), np.diff(until[first : last + 1]))
            i, j = np.divmod(np.arange(until[first], until[last]) - until[k], high[k])
            i, j = i + xat[k], j + yat[k]
            first = last

            ok = np.where(owns[k], rx[i] < ry[j], rx[i] != ry[j]) & (cx[i] != cy[j])
            i, j, k = i[ok], j[ok], k[ok]
            m, n, base = nx[i], ny[j], bases[k]
            ok = (NUM + DEN) * np.minimum(ox[i], oy[j]) >= NUM * (m + n) + (NUM + DEN) * (ex[i] + ey[j] - base)
            ok &= np.minimum(m, n) * DEN >= np.maximum(m, n) * NUM
            ok &= (base != 0) | (lx[i] != ly[j]) | (lx[i] < 0)
            i, j, m, n, base = i[ok], j[ok], m[ok], n[ok], base[ok]
            # sets differ by no less than their sketches do
            ok = (NUM + DEN) * np.bitwise_count(xfold[i] ^ yfold[j]).sum(1, dtype=np.int64) <= (DEN - NUM) * (m + n)
            i, j, m, n, base = i[ok], j[ok], m[ok], n[ok], base[ok]
            a, c = rx[i], ry[j]
            swap = a > c
            cols = (np.minimum(a, c), np.maximum(a, c), np.where(swap, n, m), np.where(swap, m, n), base != 0)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(cols, kinds, strict=True)], ["a", "b", "an", "bn", "derived"])


def _across(entries: DataFrame, keep: Keep) -> DataFrame:
    """a, b, an, bn, derived: pairs of different components that share a list and may link, block by block.

    entries: _ENTRY, component, lead, sets (entries of the list), _FOLDS. A pair needs 4 / 9 of its tokens, and the two
    extras less base besides, in room. A list of up to BLOCK entries is one block, which meets itself without a join;
    blocks of longer lists are of one size class and class of room.
    """
    long = F.col("sets") > BLOCK
    size, room = F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int"), F.floor(F.col("room") * 4 * DEN / F.col("n")).cast("int")
    classed = entries.withColumn("size", F.when(long, size).otherwise(0)).withColumn("rooms", F.when(long, room).otherwise(0))
    key = ["k1", "k2", "size", "rooms"]
    parts = classed.filter(long).groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("parts")).filter("parts > 1")
    dealt = classed.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))))
    ends = [F.min("n").alias("n"), F.max("room").alias("room"), F.min("extra").alias("extra"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("base").alias("base"), F.first("sets").alias("sets")]
    blocks = keep(dealt.groupBy(*key, "part").agg(F.collect_list(F.struct(*_ITEM, *_FOLDS)).alias("items"), *ends).withColumn("id", F.struct("size", "rooms", "part")))
    alone = blocks.filter(~long).select(F.col("items").alias("xs"), F.col("items").alias("ys"), "base", F.lit(True).alias("own"))
    x, y = (blocks.filter(long).select("k1", "k2", *(F.col(c).alias(s + c) for c in ("id", "size", "items", "n", "room", "extra", "lo", "hi", "base"))) for s in "xy")
    needed = NUM * (F.col("xn") + F.col("yn")) + (NUM + DEN) * (F.col("xextra") + F.col("yextra") - F.col("xbase"))
    one = (F.col("xlo") == F.col("xhi")) & (F.col("ylo") == F.col("yhi")) & (F.col("xlo") == F.col("ylo"))
    met = x.join(y, ["k1", "k2"]).filter((F.col("xid") <= F.col("yid")) & (F.abs(F.col("xsize") - F.col("ysize")) <= 1) & ((NUM + DEN) * F.least("xroom", "yroom") >= needed) & ~one)
    told = alone.union(met.select(F.col("xitems").alias("xs"), F.col("yitems").alias("ys"), F.col("xbase").alias("base"), (F.col("xid") == F.col("yid")).alias("own")))
    return told.mapInArrow(_block_pairs, "a long, b long, an int, bn int, derived boolean").distinct()


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link, from both sets' differences from their one leader."""
    for b in batches:
        keep = []
        for r in b.to_pylist():
            am, bm, aa, ba = (np.frombuffer(r[c], np.uint64) for c in ("amissing", "bmissing", "aadded", "badded"))
            common = lambda x, y: len(np.intersect1d(x, y, assume_unique=True))
            overlap = r["base"] - len(am) - len(bm) + common(am, bm) + common(aa, ba)
            keep.append(overlap * (NUM + DEN) >= NUM * (r["an"] + r["bn"]))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _class_components(classes: DataFrame, texts: DataFrame, counts: DataFrame, edges: DataFrame, keep: Keep) -> DataFrame:
    """node, component of the classes that link, or that edges join; counts: token, sets of tokens that several sets have."""
    spark = classes.sparkSession
    common = counts.orderBy(F.desc("sets"), "token").limit(COMMON).select("token").toArrow().column("token").to_numpy()
    shared = spark.sparkContext.broadcast(common.astype(np.int64).tobytes())
    size = F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int")
    folds = classes.select("rep", *_FOLDS)
    # how many entries a set meets in its lists: what lies in the middle of a group meets most, as its own tokens are others' too
    meets = F.sum("sets").over(Window.partitionBy("rep"))  # one set's prefix
    # one exchange of all prefixes at a time: by set, to count tokens, to meet those counts
    with scratch(spark) as brief:
        own = texts.mapInArrow(_prefixes(shared), "digest binary, tokens array<long>").groupBy("digest").agg(F.first("tokens").alias("tokens"))
        index = brief(own.join(classes.select("digest", "rep"), "digest").select("rep", "tokens"))
        entries = index.select("rep", F.posexplode("tokens").alias("pos", "token"))
        several = brief(entries.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1"))
        met = entries.join(several, "token").withColumn("meets", meets).join(classes.select("rep", "n", *_FOLDS), "rep")
        lists = keep(met.select("token", "rep", "n", (F.col("n") - F.col("pos")).alias("room"), "meets", *_FOLDS, size.alias("size")))

    # each entry against the leaders of its size class in the list, and of the next smaller one; a list has one for each class, so a bounded number
    heads = lists.groupBy("token", "size").agg(F.min(F.struct(-F.col("meets"), "rep", "n", "room", *_FOLDS)).alias("head"))
    heads = heads.groupBy("token").agg(F.collect_list(F.struct("size", "head")).alias("heads"))
    near = F.filter("heads", lambda h: (h["size"] == F.col("size")) | (h["size"] == F.col("size") - 1))
    met = lists.join(heads, "token").select("rep", "n", "room", *_FOLDS, F.explode(near).alias("of")).select("*", "of.head").filter("head.rep <> rep")
    least = sum((F.bit_count(F.col(f"head.{c}").bitwiseXOR(F.col(c))) for c in _FOLDS), F.lit(0))  # by which they differ
    both = F.col("head.n") + F.col("n")
    met = met.filter(_reaches(F.least("head.room", "room"), both) & (least * (LEAD_NUM + LEAD_DEN) <= both * (LEAD_DEN - LEAD_NUM)))
    stars = keep(met.select(F.col("head.rep").alias("a"), F.col("rep").alias("b"), F.col("head.n").alias("an"), F.col("n").alias("bn")).distinct())
    first = _tested(stars, classes, texts, keep, LEAD_NUM, LEAD_DEN)
    lead = keep(_leaders(first))
    # sets that don't link with their leader may still be like each other, or like what links with it: they meet some hubs
    of_lead = lead.select("lead", "rep", "n", "far", (F.length("missing") + F.length("added")).alias("apart"), F.pmod(F.xxhash64("missing", "added"), F.lit(HUBS)).alias("of"))
    hubs = of_lead.groupBy("lead", "far", "of").agg(F.min(F.struct("apart", "rep", "n")).alias("hub"))
    met = of_lead.filter("far").join(hubs.select("lead", "hub"), "lead").filter("hub.rep <> rep")
    first_is_hub, hub_n = F.col("hub.rep") < F.col("rep"), F.col("hub.n")
    beside = met.select(F.least("hub.rep", "rep").alias("a"), F.greatest("hub.rep", "rep").alias("b"), F.when(first_is_hub, hub_n).otherwise(F.col("n")).alias("an"), F.when(first_is_hub, F.col("n")).otherwise(hub_n).alias("bn"))
    hubbed = _links(_tested(keep(beside.distinct()), classes, texts, keep))
    parts = connected_components(_links(first).union(hubbed).union(edges), keep)

    # across components: lists of tokens, and lists of differences where a leader has sets that don't link with it
    odd = lead.groupBy("lead").agg(F.max("far").alias("odd"), F.count("*").alias("sets")).filter("odd and sets > 1").select("lead")
    differences = _difference_lists(lead.join(odd, "lead", "left_semi"), keep)
    both = lists.select(F.col("token").alias("k1"), F.lit(_TOKENS).cast("long").alias("k2"), "rep", F.col("n").cast("long").alias("n"), F.col("room").cast("long").alias("room"), F.lit(0).cast("long").alias("extra"), F.lit(0).cast("long").alias("base")).union(differences)
    named = both.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = keep(named.join(lead.select("rep", "lead"), "rep", "left").select(*_ENTRY, "component", "lead"))
    mixed = named.groupBy("k1", "k2").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("sets")).filter("lo <> hi").select("k1", "k2", "sets")
    pairs = _across(named.join(mixed, ["k1", "k2"]).join(folds, "rep"), keep)
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = keep(pairs.join(done, ["a", "b"], "left_anti").select("a", "b", "an", "bn", "derived"))
    second = _links(_tested(pairs.filter("not derived").drop("derived").distinct(), classes, texts, keep))
    side = lambda x: lead.select(F.col("rep").alias(x), F.col("missing").alias(f"{x}missing"), F.col("added").alias(f"{x}added"))
    by_lead = pairs.filter("derived").join(side("a"), "a").join(side("b").join(lead.select(F.col("rep").alias("b"), "base"), "b"), "b")
    more = second.union(by_lead.mapInArrow(_derived, "a long, b long"))
    return connected_components(parts.union(more), keep)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, for every row of docs: a table in the shared folder, where nothing else is left."""
    with scratch(docs.sparkSession) as keep:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        both = keep(texts.mapInArrow(_describe, f"doc_id long, n int, digest binary, sketch binary, {', '.join(f'{c} long' for c in _FOLDS)}, token long, sets long"))
        told, counts = both.filter("n is not null"), both.filter("n is null").groupBy("token").agg(F.sum("sets").alias("sets"))
        full = told.filter("doc_id is not null and n > 0")
        classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), *(F.first(c).alias(c) for c in _FOLDS))
        # numbers follow the digests, so that which sets lead doesn't depend on how rows are dealt
        classes = keep(classes.orderBy("digest").withColumn("rep", F.monotonically_increasing_id()))
        members = keep(full.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"))
        of_doc = members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
        edges = members.withColumnRenamed("rep", "b").join(of_doc.filter("rep <> other").select("doc_id", F.col("rep").alias("a")), "doc_id").select("a", "b")
        parts = _class_components(classes, texts.filter("doc_id is not null"), counts, edges, keep)

        named = keep(classes.select("rep", "doc_id").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("component")))
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of_class = named.join(least, "component").select("rep", "component_id")
        component = of_doc.join(of_class, "rep").select("doc_id", "component_id")
        rows = told.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
        return written(rows.join(component, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_smallest(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, and rows without a doc_id; columns may have any names."""
    stay = jaccard_components(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("stay")).distinct()
    whole = docs.select(F.struct("*").alias("row"))
    return whole.join(stay, F.col("row.doc_id") == F.col("stay"), "left_semi").union(whole.filter("row.doc_id is null")).select("row.*")
