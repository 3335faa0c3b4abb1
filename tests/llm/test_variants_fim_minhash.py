"""Spelling variants, fill-in-middle and circulant MinHash against plain Python, with nulls, blanks, ties, copies and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import fill_middle, minhash, registry, spelling


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    w = {k: n for k, n in counts.items() if len(k) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    friends = {k: [] for k in w}
    for a, b in combinations(w, 2):
        if near(a, b):
            friends[a].append(b)
            friends[b].append(a)
    form = {}
    for k in w:
        best = min(friends[k], key=lambda x: (-w[x], x), default=None)
        form[k] = best if best is not None and w[best] >= 10 * w[k] else None
    out = {}
    for k in w:
        root = k
        while form[root] is not None:
            root = form[root]
        out[k] = (w[k], len(friends[k]), form[k], w.get(form[k]), root)
    return out


def got_variants(docs):
    rows = spelling.spelling_variants(docs).collect()
    told = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(told) == len(rows)
    return told


def variant_rows():
    rng = random.Random(3)
    base = ["abcdefgh", "aaaaaaaa", "ababababab", "élanvital", "ÉLANVITAL", "wordwordword", "Aåßðþÿxyz", "mississippi"]
    rows = []
    for w in base:
        edits = {w, w[1:], w[:-1], w + "x", "x" + w, w[:4] + w[3:], w[:3] + "q" + w[4:], w[:5] + w[6:], w[:2] + "zz" + w[3:]}
        for e in sorted(edits):
            rows += [" ".join([e] * rng.choice([1, 2, 3, 9, 30, 400]))] * rng.choice([1, 2])
    # chains of forms: 2, 20, 200, 2000 occurrences, one edit apart each
    rows += [" ".join(["chainedword" + "s" * k] * 2 * 10**k) for k in range(4)]
    rows += ["tiedword1 tiedworda " * 20 + " tiedwordb " * 20 + "tiedword " * 2, "", None, "×÷×÷×÷× " * 3, "x" * 50_000 + " " + "x" * 50_000 + " " + "x" * 49_999 + " " + "x" * 49_999]
    rows = [(k, t) for k, t in enumerate(rows)]
    return rows + [(None, "nobodysword nobodysword nobodyswords"), rows[3], rows[3]]


def test_variants(spark):
    rows = variant_rows()
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, key int").repartition(3)
    assert got_variants(docs) == plain_variants(rows)


def test_variants_of_dense_words_and_empty_table(spark, empty):
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randint(7, 9))) for _ in range(700)]
    rows = [(k, " ".join(rng.choices(words, k=60))) for k in range(60)]
    assert got_variants(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(rows)
    assert spelling.spelling_variants(empty).count() == 0


def plain_fim(doc_id, text, unit="(?s)."):
    text, units = text or "", re.findall(unit, text or "")
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    lo, hi = (sum(map(len, units[:k])) for k in (lo, hi))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def fim_rows():
    rng = random.Random(2)
    texts = [None, "", "a", "é\U0001f600", "x<P>y", "a<M", "<S", "P><S", "\n\r\n  a", "z" * 512, "z" * 513, "ab \U0001f600c\n" * 40_000]
    texts += ["".join(rng.choices("ab \n<>PSMé\U0001f600", k=rng.randint(1, 3000))) for _ in range(80)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (7, "another text"), (None, "no id"), (None, "no id"), (-5, "negative"), (2**62, "large " * 300)]
    return rows


@pytest.mark.parametrize(("unit", "block"), [("(?s).", 512), ("(?s).", 3), ("[ \n]*[^ \n]+", 4)])
def test_fill_in_middle(spark, unit, block):
    rows = fim_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, "f") for i, t in rows], "doc_id long, text string, n int, key int, form string").repartition(3)
    filled = fill_middle.fill_in_middle(docs, unit, block)
    got = filled.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, t or "", *plain_fim(i, t, unit)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    assert all(r.restored == r.text for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_digests(docs, rows, empty):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(tuple(r) for r in fill_middle.digests(fill_middle.fill_in_middle(docs)).collect())
    want = sorted((r[0], *(x := plain_fim(r[0], r[1]))[:4], sha(x[4]), sha(r[1] or "")) for r in rows)
    assert [[str(v) for v in r] for r in got] == [[str(v) for v in r] for r in want]
    assert fill_middle.fill_in_middle(empty).count() == 0


def shingles(t, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def plain_duplicates(rows):
    sets, node = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(a):
        while node[a] != a:
            a = node[a]
        return a

    for (i, x), (j, y) in combinations(sets, 2):
        if x and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(i), find(j)))
            node[b] = a
    return sorted((i, len(x), find(i), find(i) == i) for i, x in sets)


def test_minhash(spark, docs, rows, empty):
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == plain_duplicates([r[:2] for r in rows])
    assert minhash.near_duplicates(empty).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("n", "digest", "rep", "bucket", "component", "bands")}).limit(0).union(docs.withColumns({c: F.lit(1) for c in ("n", "digest", "rep", "bucket", "component", "bands")}))
    assert minhash.near_duplicates(clash).count() == len(rows)
    nobody = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in minhash.near_duplicates(nobody).collect()))) == ["(3, 2, 3, True)", "(None, 2, None, True)", "(None, 2, None, True)"]


def test_minhash_of_edited_copies_and_small_sets(spark):
    """A large group of copies at all distances, texts of one to six words, a very long text, and a chain that one link holds."""
    rng, texts = random.Random(5), []
    base = [f"b{k}" for k in range(80)]
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(6)}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(60)]
    long = [f"l{k}" for k in range(60_000)]
    texts += [" ".join(long), " ".join(long[:55_000]), " ".join(long[:40_000]), None, "", "one"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, "one")]
    rng.shuffle(rows)
    assert sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()) == plain_duplicates(rows)


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**63, 1500, np.uint64)
    a, b = np.sort(grams[:1000]), np.sort(grams[500:1500])
    many, one = minhash.signatures([a, b], 2000), minhash.signatures([a[:1]], 8)
    assert abs((many[0] == many[1]).mean() - 1 / 3) < 0.05
    assert (minhash.signatures([a, b, a], 40) == np.stack([many[0][:40], many[1][:40], many[0][:40]])).all()
    assert len(set(one[0].tolist())) == 8
    # shifting all places by one along the ring shifts the coordinates by one
    place = minhash._spread32(a.astype(np.uint32) ^ np.uint32(0x5BD1E995))
    assert all(many[0][k] == minhash._spread32(place - np.uint32(k)).min() for k in (0, 1, 7))


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_fill_in_middle"])
def test_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    told = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, told.fetchall()))
