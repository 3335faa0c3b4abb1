"""Quality classification by attention over passages.

A document is a bag of passages. Each passage becomes a vector of surface features: shares of byte classes,
hashed pairs of byte classes, and word statistics. A small network encodes the vectors; gated attention,
tanh(V h) * sigmoid(U h), weighs the passages of a document; the weighted sum decides. Only document labels
train it: which passages matter is learned with the rest. It is fitted on a bounded sample of labelled rows;
scoring reads every passage of every text.

Defined results: texts without words (null, empty, white space) have no passage and score 0; rows without
labels are scored only; documents with contradictory labels count as both; if the sample lacks either class,
the score is the share of good labels (0.5 without labels); repeated rows score alike; a null doc_id is not
held out; of docs only doc_id and text are read, of labels doc_id and quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import mix64, text_bytes, word_hashes, word_spans

#: Words in a passage.
PASSAGE = 48
#: Labelled documents that the model is fitted on, at most, each with all its passages.
SAMPLE_DOCS = 3000
#: Bytes of text after which the sample takes no further document: some 100,000 passages of prose, 50 MB of features.
SAMPLE_BYTES = 32 << 20
FOLDS, CUT = 5, 0.3
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY, SEED = 24, 12, 30, 0.01, 1e-4, 7
#: Bytes of text whose features are worked out at once.
SLICE = 1 << 19
_PAIRS = 192
_STATS = 6

# byte classes: each ASCII mark of its own, and letters by case, digits, spaces, line ends, other bytes
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == "\n" else 5 if _b <= 32 or _b == 127 else 6 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(_c)
_CLASSES = int(_CLASS.max()) + 1
_PAIR = (mix64(np.arange(_CLASSES * _CLASSES, dtype=np.uint64) + np.uint64(11)) % np.uint64(_PAIRS)).astype(np.int64).reshape(_CLASSES, _CLASSES)
FEATURES = _CLASSES + _PAIRS + _STATS


def passage_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and how many passages come before each text (one more entry)."""
    starts, ends, first = word_spans(raw, at)
    counts = np.diff(first)
    per = -(-counts // PASSAGE)
    before = np.concatenate([[0], np.cumsum(per)])
    n = int(before[-1])
    if not n:
        return np.zeros((0, FEATURES), np.float32), before
    doc = np.repeat(np.arange(len(counts)), counts)
    passage = before[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    lo, hi = starts[head], np.concatenate([starts[head[1:]], [0]])
    words = np.diff(np.concatenate([head, [len(starts)]]))
    last = np.concatenate([head[1:], [len(starts)]]) - 1
    # a passage reaches to the next one's first word, the last one of a text to that text's end
    hi = np.where(doc[head] == np.concatenate([doc[head[1:]], [-1]]), hi, at[doc[last] + 1])
    size = (hi - lo).astype(np.float64)
    owner = np.repeat(np.arange(n), hi - lo)
    spot = np.arange(int(size.sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    kind = _CLASS[raw[spot]]
    ones = np.bincount(owner * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / size[:, None]
    same = owner[1:] == owner[:-1]
    pairs = np.bincount((owner[1:] * _PAIRS + _PAIR[kind[:-1], kind[1:]])[same], minlength=n * _PAIRS).reshape(n, _PAIRS) / size[:, None]
    h = word_hashes(raw, starts, ends)
    key = np.sort(passage.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.bincount(passage[1:][(h[1:] == h[:-1]) & (passage[1:] == passage[:-1])], minlength=n)
    length = np.bincount(passage, ends - starts, n)
    text_words = np.log1p(counts[doc[head]])
    stats = np.stack([distinct / words, again / words, length / words / 10, words / PASSAGE, text_words / 10, np.sqrt(words) / 7], 1)
    return np.concatenate([np.sqrt(ones), np.sqrt(pairs), stats], 1).astype(np.float32), before


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, features, passages before each row) of parts of a batch."""
    raw, at = text_bytes(b.column("text"))
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        yield first, last, *passage_features(raw[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = []
        for first, last, x, before in _slices(b):
            for k in range(last - first):
                blobs.append(x[before[k] : before[k + 1]].astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(blobs, pa.binary())], ["doc_id", "quality", "features"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated-attention multiple-instance learning with hand-written gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, base: float):
        rng = np.random.default_rng(SEED)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale, self.base = mean, scale, base
        self.p = {"W": init(len(mean), HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        """Everything from features to logits; every text has a passage."""
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        top = np.maximum.reduceat(e, before[:-1])
        n = np.diff(before)
        a = np.exp(e - np.repeat(top, n))
        a = a / np.repeat(np.add.reduceat(a, before[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, before[:-1])
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "n": n, "logit": z @ p["c"] + p["d"]}

    def gradients(self, f: dict[str, np.ndarray], before: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, dl = self.p, (_sigmoid(f["logit"]) - y) / len(y)
        dz = np.repeat(dl[:, None] * p["c"], f["n"], 0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, before[:-1]), f["n"]))
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        rng, m, v, step = np.random.default_rng(SEED), {}, {}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for s in range(0, len(order), 32):
                rows = order[s : s + 32]
                before = np.concatenate([[0], np.cumsum([len(bags[r]) for r in rows])])
                grads = self.gradients(self.forward(np.concatenate([bags[r] for r in rows]).astype(np.float32), before), before, y[rows])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def scores(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Each text's score; 0 without passages."""
        out = np.zeros(len(before) - 1)
        some = np.flatnonzero(np.diff(before))
        if len(some):
            out[some] = self.base if self.base is not None else _sigmoid(self.forward(x, np.append(before[some], before[-1]))["logit"].astype(np.float64))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """A model from at most SAMPLE_DOCS labelled rows that aren't held out, chosen by a hash of their ids."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_DOCS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")), "doc_id")
    # whole documents in the sample's order, until the bytes are used up
    sizes = rows.groupBy("doc_id", "quality").agg(F.sum(F.octet_length("text")).alias("bytes"))
    earlier = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).filter(F.col("before") < SAMPLE_BYTES).select("doc_id", "quality")
    told = rows.join(F.broadcast(within), ["doc_id", "quality"]).select("doc_id", "text", "quality").mapInArrow(_sample_features, "doc_id long, quality int, features binary").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    bags = [np.frombuffer(f, np.float16).reshape(-1, FEATURES) for f in told.column("features").to_pylist()]
    y = np.array(told.column("quality").to_pylist(), np.float32)
    some = [k for k, b in enumerate(bags) if len(b)]
    bags, y = [bags[k] for k in some], y[some]
    if len(set(y.tolist())) < 2:
        return AttentionModel(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), float(y.mean()) if len(y) else 0.5)
    every = np.concatenate(bags).astype(np.float32)
    model = AttentionModel(every.mean(0), 1 / (every.std(0) + 0.01), None)
    model.fit(bags, y)
    return model


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [model.scores(x, before) for _, _, x, before in _slices(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate([*parts, np.zeros(0)]))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted on labels that aren't held out, then applied to all of docs."""
    return score(docs, train(docs, labels))
