"""Word hashes, descriptions with counts, and pairs of many small blocks, against plain versions."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa

from barloom.llm import jaccard_join


def test_word_hashes_tell_all_words_apart():
    """Words of 1 to 150 bytes, zeros and near ones among them, have one hash each, wherever they stand."""
    words = [b"a" * k for k in range(1, 150)] + [b"a" * k + b"\0" for k in range(150)]
    words += [b"a" * k + b"b" + b"a" * (n - k - 1) for n in (8, 9, 16, 63, 64, 65) for k in range(n)]
    words = list(dict.fromkeys(words))
    seen = {}
    for order in (words, words[::-1]):
        raw = np.frombuffer(b" ".join(order), np.uint8)
        sizes = np.array([len(w) for w in order])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        for w, h in zip(order, jaccard_join.word_digests(raw, starts, starts + sizes).tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(words)
    assert len(jaccard_join.word_digests(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_one_pass_describes_and_counts(monkeypatch):
    """A text is tokenised once for its row and for how many sets have its tokens."""
    passes = []
    plain = jaccard_join.token_sets
    monkeypatch.setattr(jaccard_join, "token_sets", lambda raw, at, *n: passes.append(len(at) - 1) or plain(raw, at, *n))
    texts = ["a b c d e f g", "A b c d e f h", "a b c d e f g", None, "one two", "b c d e f"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, None, 6], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    rows = [r for b in jaccard_join._describe(iter([batch])) for r in b.to_pylist()]
    told, counted = [r for r in rows if r["n"] is not None], [r for r in rows if r["n"] is None]
    assert sum(passes) == len(texts)
    assert [(r["doc_id"], r["n"]) for r in told] == [(1, 3), (2, 3), (3, 3), (4, 0), (None, 1), (6, 1)]
    assert [told[0]["digest"] == r["digest"] for r in told] == [True, False, True, False, False, False]
    # a b c d e is in two different sets, b c d e f in three
    assert sorted(r["sets"] for r in counted) == [2, 3]


def plain_pairs(blocks):
    out = Counter()
    for xs, ys, base, own in blocks:
        for x in xs:
            for y in ys:
                m, n = x["n"], y["n"]
                ok = (x["rep"] < y["rep"] if own else x["rep"] != y["rep"]) and x["component"] != y["component"]
                ok = ok and 9 * min(x["room"], y["room"]) >= 4 * (m + n) + 9 * (x["extra"] + y["extra"] - base)
                ok = ok and 5 * min(m, n) >= 4 * max(m, n) and (base or x["lead"] is None or x["lead"] != y["lead"])
                if ok and 9 * (x["f0"] ^ y["f0"]).bit_count() <= m + n:
                    (a, an), (b, bn) = sorted([(x["rep"], m), (y["rep"], n)])
                    out[a, b, an, bn, base != 0] += 1
    return out


def test_many_small_blocks_are_met_at_once(monkeypatch):
    """All pairs of blocks, cut anywhere, as the plain version has them; 20,000 small blocks in less time than a loop takes."""
    rng = np.random.default_rng(1)

    def items(size):
        return [
            {"rep": int(r), "n": int(rng.integers(50, 70)), "room": int(rng.integers(40, 70)), "extra": int(rng.integers(0, 3)), "component": int(rng.integers(0, 90)), "lead": None if rng.random() < 0.5 else int(rng.integers(0, 5)), "f0": int(rng.integers(0, 1 << 20)), "f1": 0, "f2": 0, "f3": 0}
            for r in rng.integers(0, 1000, size)
        ]

    kind = pa.list_(pa.struct([(c, pa.int64()) for c in jaccard_join._ITEM + jaccard_join._FOLDS]))

    def batch(blocks):
        cols = list(zip(*blocks, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, kind, pa.int64(), pa.bool_()), strict=True)], ["xs", "ys", "base", "own"])

    def met(blocks):
        return Counter(tuple(r.values()) for b in jaccard_join._block_pairs(iter([batch(blocks)])) for r in b.to_pylist())

    blocks = []
    for _ in range(300):
        xs, own = items(rng.integers(1, 9)), bool(rng.random() < 0.5)
        blocks.append((xs, xs if own else items(rng.integers(1, 9)), int(rng.choice([0, 60])), own))
    blocks.append(([], items(3), 0, False))
    want = plain_pairs(blocks)
    assert len(want) > 100 and met(blocks) == want and not met([])
    monkeypatch.setattr(jaccard_join, "PAIRS", 7, raising=False)
    assert met(blocks) == want
    monkeypatch.undo()
    many = batch([(xs, xs, 0, True) for xs in [items(3) for _ in range(200)]] * 100)
    began = time.process_time()
    assert sum(b.num_rows for b in jaccard_join._block_pairs(iter([many]))) > 0
    assert time.process_time() - began < 0.7
