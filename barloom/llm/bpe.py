"""BPE encoding and decoding by a table of distinct words.

The tokenizer works on words, so a text's ids are those of its words in order. A word is a stem and a tail (the
marks at its end), its parts, which the texts are made of:

1. Part counts find the most frequent parts; their ids form a table of bounded size that every task holds.
2. Texts are split once, in blocks of about BLOCK_BYTES: a block keeps the number of the part at each position,
   and the list of its distinct parts. Only these are moved, not the texts.
3. The parts of all blocks that aren't frequent are sorted, each distinct one is encoded once, and its ids are joined
   back to the blocks that have it. The frequent ones being left out, a part has few requests, one for each block
   at most.
4. Block by block, each position takes the ids of its part. Each id of the finished lists then takes its piece
   from the id-to-piece table (one row per id of the vocabulary, in every task), and pieces joined by spaces are
   the decoded text.

Tasks form blocks of the rows they read, whatever these hold, so repeated rows make no block larger. docs must come in
the same order when lost tasks read them again, as files do; else an error is raised, and docs should be written first.

Defined results: null text is an empty text, with no ids and an empty decoded text; repeated rows each get
a row; null doc_ids are kept; special tokens' strings in a text become their ids, as the library does
it; only doc_id and text are read, so other columns may have any names. A text is held whole by one task, with some 20
times its bytes. Vocabularies have at most 65,536 ids, others raise an error.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_BYTES, text_bytes, word_spans
from barloom.llm.tokens import default_path, encoder, parts_of, tokenizer

#: Parts in the table that every task holds, each of at most HOT_BYTES: 30 MB at the very most, about 12 MB for prose.
HOT_PARTS, HOT_BYTES = 1 << 19, 32
#: A part counts in a block of text from this many occurrences there; fewer don't matter for which are the most frequent,
#: and which they are changes no result.
LEAST_IN_BLOCK = 2
BLOCK_BYTES = 8 << 20
#: Answers that a task packs at once.
MOST_ASKED = 1 << 18


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, bytes and offsets of about BLOCK_BYTES of texts at a time."""
    for b in batches:
        raw, at = text_bytes(b.column("text"))
        docs, first = b.column("doc_id"), 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
            yield docs.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


_LETTERS = np.ones(256, bool)
_LETTERS[list(SPACE_BYTES)] = False


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The number of the word at each position, the distinct words, and how many positions come before each text."""
    starts, ends, first = word_spans(raw, at)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[_LETTERS[raw]])]).dictionary_encode()
    return spelt.indices.to_numpy(), spelt.dictionary.to_pylist(), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, raw, at in _slices(batches):
        index, words, _ = _words(raw, at)
        parts: Counter[bytes] = Counter()
        for w, n in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
            for part in parts_of(w):
                parts[part] += n
        kept = [(w, n) for w, n in parts.items() if n >= LEAST_IN_BLOCK and 0 < len(w) <= HOT_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["part", "n"])


def frequent_parts(texts: DataFrame, most: int = HOT_PARTS) -> DataFrame:
    """The most frequent parts, at most so many."""
    counts = texts.mapInArrow(_count, "part binary, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "part").limit(most).select("part")


def _encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = encoder(path).part
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([part(p) for p in b.column("part").to_pylist()], pa.binary())], ["part", "ids"])

    return run


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of blocks that aren't frequent, each with its block and number there."""
    for b in batches:
        parts = b.column("parts")
        n = parts.value_lengths().to_numpy()
        ks = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("block").to_numpy(), n)), pa.array(ks, pa.int32()), parts.flatten()], ["of", "k", "part"])


def _answers(path: str):
    """Rows (of, k, part) in the order of parts, to the ids of each block's parts; a distinct part is encoded once.

    A block's answers are packed by task: one row for each block that asked for any of the task's parts.
    """

    def told(blocks: dict[int, list[tuple[int, bytes]]]) -> pa.RecordBatch:
        ks = [_packed(np.array([k for k, _ in x])) for x in blocks.values()]
        lengths = [_packed(np.array([len(i) // 2 for _, i in x])) for x in blocks.values()]
        ids = [_packed(np.frombuffer(b"".join([i for _, i in x]), "<u2")) for x in blocks.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), *(pa.array(c, pa.binary()) for c in (ks, lengths, ids))], ["of", "ks", "lengths", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, ids = encoder(path).part, None, b""
        blocks: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        asked = 0
        for b in batches:
            for block, k, p in zip(b.column("of").to_pylist(), b.column("k").to_pylist(), b.column("part").to_pylist(), strict=True):
                if p != last:
                    last, ids = p, part(p)
                blocks[block].append((k, ids))
            asked += len(b)
            if asked > MOST_ASKED:
                yield told(blocks)
                blocks.clear()
                asked = 0
        yield told(blocks)

    return run


class _Hot:
    """The frequent parts, in the order of their hashes, and their ids."""

    def __init__(self, parts: list[bytes], ids: list[bytes]):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
        order = np.argsort(hashes).tolist()
        self.hashes, self.parts = hashes[order], pa.array([parts[k] for k in order], pa.binary())
        self.lengths = np.array([len(ids[k]) // 2 for k in order], np.int64)
        self.ids = np.frombuffer(b"".join([ids[k] for k in order]), "<u2")

    def places(self, parts: list[bytes]) -> np.ndarray:
        """The place of each part in the table, -1 for parts that it lacks."""
        if not len(self.hashes) or not parts:
            return np.full(len(parts), -1)
        at = np.searchsorted(self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)))
        at[at == len(self.hashes)] = 0
        return np.where(pc.equal(self.parts.take(pa.array(at)), pa.array(parts, pa.binary())).to_numpy(zero_copy_only=False), at, -1)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, one plane for each of their bytes."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(frame: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_BLOCK = "block long, docs array<long>, sizes array<long>, sequence binary, places binary, parts array<binary>"


def _split(shared):
    """Blocks of texts: their doc_ids, parts in each text, number of the part at each position, and the parts.

    Parts are numbered by falling frequency. places has a part's place in the frequent ones, plus 1; 0 for others, which
    parts lists. A block is named by a digest of these lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for docs, raw, at in _slices(batches):
            index, words, first = _words(raw, at)
            numbers: dict[bytes, int] = {}
            both = np.array([[numbers.setdefault(p, len(numbers)) if p else -1 for p in parts_of(w)] for w in words], np.int64).reshape(-1, 2)
            placed = both[index]
            sizes = np.diff(np.concatenate([[0], np.cumsum((placed >= 0).sum(1))])[first])
            sequence = placed[placed >= 0]
            parts, counts = list(numbers), np.bincount(sequence, minlength=len(numbers))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            parts = [parts[k] for k in order.tolist()]
            places = hot.places(parts)
            others = [parts[k] for k in np.flatnonzero(places < 0).tolist()]
            packed = _packed(places + 1)
            block = hashlib.blake2b(b"\0".join([packed, *others]), digest_size=8).digest()
            row = [[int.from_bytes(block, "little", signed=True)], [docs.to_pylist()], [sizes.tolist()], [_packed(rank[sequence])], [packed], [others]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block", "docs", "sizes", "sequence", "places", "parts"])

    return run


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    tok = tokenizer(path)
    return pa.array([tok.id_to_token(k) or "" for k in range(tok.get_vocab_size())], pa.large_string())


def _decoded(lists: pa.Array, pieces: pa.Array) -> pa.Array:
    """For each list of ids their pieces, joined by spaces; null for null, nothing for unknown ids."""
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), False)
    if pc.all(known).as_py() is False:
        ends = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])[ends]
        flat = flat.filter(known)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pieces.take(flat)), pa.scalar(" ", pa.large_string()))
    return pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.large_string())).cast(pa.string())


def _assembled(shared, path: str):
    """The texts of blocks: each position takes its part's ids, each id its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for r in (b.slice(k, 1).to_pylist()[0] for b in batches for k in range(len(b))):
            places, answers = _unpacked(r["places"]) - 1, r["answers"] or []
            column = lambda c: np.concatenate([*(_unpacked(x[c]) for x in answers), np.zeros(0, np.int64)])
            ks, got, own = column("ks"), column("lengths"), column("ids")
            lengths = np.concatenate([hot.lengths, got])
            before = np.cumsum(lengths) - lengths
            if len(np.unique(ks)) < (places < 0).sum():
                raise RuntimeError("texts came in another order as they were read again: write them to files first")
            where = np.empty(len(places), np.int64)
            where[places >= 0] = places[places >= 0]
            where[np.flatnonzero(places < 0)[ks]] = len(hot.lengths) + np.arange(len(ks))
            at = where[_unpacked(r["sequence"])]
            n = lengths[at]
            upto = np.concatenate([[0], np.cumsum(n)])
            flat = np.concatenate([hot.ids.astype(np.int32), own.astype(np.int32)])[np.repeat(before[at] - upto[:-1], n) + np.arange(upto[-1])]
            lists = pa.ListArray.from_arrays(pa.array(upto[np.concatenate([[0], np.cumsum(r["sizes"])]).astype(np.int64)], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(r["docs"], pa.int64()), lists, _decoded(lists, _pieces(path))], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids decode to) of every row of docs."""
    spark, path = docs.sparkSession, tokenizer_path or default_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hot = frequent_parts(texts).repartition("part").mapInArrow(_encode_parts(path), "part binary, ids binary").toArrow()
    shared = spark.sparkContext.broadcast(_Hot(hot.column("part").to_pylist(), hot.column("ids").to_pylist()))
    # one exchange, which both its readers use: they have all its columns
    blocks = texts.mapInArrow(_split(shared), _BLOCK).repartition("block")
    asked = blocks.mapInArrow(_requests, "of long, k int, part binary").repartition("part").sortWithinPartitions("part")
    answers = asked.mapInArrow(_answers(path), "of long, ks binary, lengths binary, ids binary").groupBy("of").agg(F.collect_list(F.struct("ks", "lengths", "ids")).alias("answers"))
    met = blocks.join(answers, F.col("block") == F.col("of"), "left").select(*blocks.columns, "answers")
    return met.mapInArrow(_assembled(shared, path), "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded texts."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def decode(encoded: DataFrame, tokenizer_path: str | None = None, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded: the pieces of its ids, looked up in the id-to-piece table, joined by spaces.

    Null ids give null, unknown ids give nothing.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _decoded(b.column(ids), _pieces(path))], [*b.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, decoded string")
