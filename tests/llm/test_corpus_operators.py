"""Corpus operators against brute force on documents with nulls, blanks, repeated rows, copies and a long text."""

import hashlib
import os
import random
import re
import shutil
import zlib
from itertools import combinations
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, components, exact_dedup, jaccard_join, licenses, mixing, quality_classifier, quality_rules, registry, token_rollup, token_shards, tokens, url_filter

LABELS = "doc_id long, quality int, toxic int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets, root = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def library_ids(t):
    return tokens.tokenizer(tokens.default_path()).encode(t or "", add_special_tokens=False).ids


def test_jaccard(docs, rows, empty):
    want = plain_components(rows)
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert len({want[k][1] for k in (3, 50, 51, 52, 53)}) == 1
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_of_near_copies_at_all_distances(spark, monkeypatch):
    """Clusters around one text, edited lightly to heavily, beside texts that share a passage: blocks of 4 entries, too."""
    rng, rows = random.Random(1), []
    for length, copies in ((60, 40), (100, 30)):
        base = [f"b{length}_{i}" for i in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = rng.choice([[], [f"u{rng.random()}"], [f"x{rng.randrange(4)}"]])
            rows.append(" ".join(w))
    rows += [" ".join([f"o{rng.random()}" for _ in range(rng.randint(0, 12))] + [f"p{i}" for i in range(40)]) for _ in range(30)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_differences_from_a_leader_find_every_link():
    """Where a set doesn't link with its leader, it shares a list with each set of that leader that it links with."""
    rng, links = np.random.default_rng(3), 0
    for _ in range(400):
        base = np.arange(60)
        part = rng.choice(base, rng.integers(0, 12), replace=False)
        sets = []
        for k in (1, 2):
            gone = np.union1d(part[: rng.integers(0, len(part) + 1)], rng.choice(base, rng.integers(0, 4), replace=False))
            new = np.concatenate([1000 + np.arange(rng.integers(0, 14)), 2000 + 100 * k + np.arange(rng.integers(0, 3))])
            sets.append(np.union1d(np.setdiff1d(base, gone), new))
        rows = [{"rep": k, "n": len(s), "lead": 7, "base": 60, "missing": np.setdiff1d(base, s).astype("<i8").tobytes(), "added": np.setdiff1d(s, base).astype("<i8").tobytes(), "far": 9 * len(np.intersect1d(s, base)) < 4 * (60 + len(s))} for k, s in enumerate(sets)]
        a, b = sets
        if (rows[0]["far"] or rows[1]["far"]) and 9 * (both := len(np.intersect1d(a, b))) >= 4 * (len(a) + len(b)):
            links += 1
            # in one order of tokens, here by their keys, the first common one is in both prefixes and leaves room
            entries = [sorted(next(jaccard_join._differences(iter([pa.RecordBatch.from_pylist([r])]))).to_pylist(), key=lambda e: (e["k2"], e["k1"])) for r in rows]
            at = [{(e["k1"], e["k2"]): (e["size"] - pos, e) for pos, e in enumerate(x) if pos < e["upto"]} for x in entries]
            shared = [(*at[0][k], *at[1][k]) for k in at[0] if k in at[1]]
            assert any(9 * min(p, q) >= 4 * (x["n"] + y["n"]) + 9 * (x["extra"] + y["extra"] - x["base"]) for p, x, q, y in shared)
            assert both == 60 - either(rows, "missing", set.union) + either(rows, "added", set.intersection)
    assert links > 20


def either(rows, name, how):
    return len(how(*(set(np.frombuffer(r[name], "<i8").tolist()) for r in rows)))


def test_words_of_equal_polynomials_are_told_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 2}


def test_jaccard_of_ids_that_texts_share(spark):
    rows = [(1, "A"), (1, "B"), (2, "b"), (3, "a"), (None, "a"), (4, ""), (4, None), (5, "C")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.component_id) for r in got) == ["1", "1", "1", "1", "4", "4", "5", "None"]
    clash = spark.createDataFrame([(2, "x y", 1, 1), (1, "x Y", 2, 2), (None, "x y", 3, 3)], "doc_id long, text string, stay long, component_id long")
    assert sorted((str(r.doc_id), r.stay) for r in jaccard_join.keep_smallest(clash).collect()) == [("1", 2), ("None", 3)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 41)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(edges).collect()} == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40}


def test_exact_dedup(docs, rows, empty):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: lower(r[1]) for r in rows}
    for r in got:
        g = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(g), len(g), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    assert sum(r.kept for r in got) == len(groups)
    assert sorted(r.doc_id for r in exact_dedup.keep_largest(docs).collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_repeated_ids(spark):
    rows = [(5, "a"), (5, "b"), (9, "B"), (None, "c"), (None, "d"), (7, "D"), (None, None), (None, "")]
    got = exact_dedup.keep_largest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == [("5", "a"), ("7", "D"), ("9", "B"), ("None", ""), ("None", "c")]


def test_bpe(docs, rows, empty):
    tok = tokens.tokenizer(tokens.default_path())
    want = sorted((r[0], (ids := library_ids(r[1])), tok.decode(ids, skip_special_tokens=False)) for r in rows)
    coded = bpe.encode(docs)
    assert sorted((r.doc_id, r.ids, r.decoded) for r in coded.collect()) == want
    assert sorted((r.doc_id, r.decoded) for r in bpe.decode(coded.drop("decoded")).collect()) == sorted((d, t) for d, _, t in want)
    assert bpe.encode(empty).count() == 0


def test_bpe_of_small_blocks_without_frequent_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 300)
    monkeypatch.setattr(bpe, "frequent_parts", lambda texts: texts.select(F.encode("text", "utf-8").alias("part")).limit(0))
    assert sorted((r.doc_id, r.ids) for r in bpe.encode(docs).collect()) == sorted((r[0], library_ids(r[1])) for r in rows)


def test_decoded_text_is_that_of_the_emitted_ids(monkeypatch):
    """Lists that go wrong as they are put together show in the decoded text."""
    path, text = tokens.default_path(), b"Ta mi so, la."
    parts = sorted({p for w in text.split() for p in tokens.parts_of(w) if p})
    hot = bpe._Hot(parts, [tokens.encoder(path).part(p) for p in parts])
    sequence = [p for w in text.split() for p in tokens.parts_of(w) if p]
    names = sorted(set(sequence))
    numbers = np.array([names.index(p) for p in sequence])
    block = pa.RecordBatch.from_pylist([{"docs": [1], "sizes": [len(sequence)], "sequence": bpe._packed(numbers), "places": bpe._packed(hot.places(names) + 1), "answers": None}])
    whole = bpe._unpacked
    monkeypatch.setattr(bpe, "_unpacked", lambda frame: whole(frame)[::-1] if frame == bpe._packed(numbers) else whole(frame))
    got = next(bpe._assembled(SimpleNamespace(value=hot), path)(iter([block]))).to_pylist()[0]
    assert got["ids"] == [k for p in sequence[::-1] for k in np.frombuffer(tokens.encoder(path).part(p), "<u2").tolist()]
    assert got["decoded"] == tokens.tokenizer(path).decode(got["ids"], skip_special_tokens=False) != tokens.tokenizer(path).decode(library_ids(text.decode()), skip_special_tokens=False)


def test_decode_of_nulls_and_unknown_ids(spark):
    rows = [(1, None), (2, []), (3, [5, None, -1, 10**9, 6]), (4, [7])]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)).collect()}
    tok = tokens.tokenizer(tokens.default_path())
    assert got == {1: None, 2: "", 3: f"{tok.id_to_token(5)} {tok.id_to_token(6)}", 4: tok.id_to_token(7)}


def test_shards(spark, docs, rows, empty, tmp_path):
    token_shards.write_shards(docs, f"{tmp_path}/a", shard_ids=500)
    got = token_shards.read_documents(spark, f"{tmp_path}/a").orderBy("start").collect()
    at, want = 0, []
    for r in sorted(rows, key=lambda r: r[0]):
        ids = [*library_ids(r[1]), 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    token = library_ids("ta")[0]
    every = sorted((r[0], k) for r in rows for k, x in enumerate(library_ids(r[1])) if x == token)
    assert sorted((r.doc_id, r.position) for r in token_shards.token_occurrences(spark, f"{tmp_path}/a", token).collect()) == every
    assert token_shards.token_counts(spark, f"{tmp_path}/a", token).agg(F.sum("occurrences")).first()[0] == len(every)
    token_shards.write_shards(empty, f"{tmp_path}/b")
    assert token_shards.read_documents(spark, f"{tmp_path}/b").count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 70, 3000)
    m = token_shards.WaveletMatrix.from_bytes(token_shards.WaveletMatrix.build(ids).to_bytes())
    assert m.to_ids().tolist() == ids.tolist()
    assert [m.access(k) for k in (0, 511, 512, 2999)] == ids[[0, 511, 512, 2999]].tolist()
    assert m.rank(7, 1500) == int((ids[:1500] == 7).sum())
    where = np.flatnonzero(ids == 7).tolist()
    assert [m.select(7, k) for k in range(len(where))] == where and m.select(7, len(where)) == -1


def test_classifier(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], int(r[0] % 2), 0) for r in rows if r[0] < 40] + [(None, 1, 0), (5, None, 0)], LABELS)
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    model = quality_classifier.train(empty, labels)
    assert {r.score for r in quality_classifier.score(docs, model).collect()} == {0.0, 0.5}


def test_classifier_trains_on_every_passage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier.AttentionModel, "fit", lambda self, bags, y: seen.append(sorted(map(len, bags))))
    ids = [k for k in range(30) if zlib.crc32(str(k).encode()) % 5][:3]
    texts = spark.createDataFrame(list(zip(ids, ["a b " * 48 * 100, "c d", "e f " * 48], strict=True)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, n % 2, 0) for n, k in enumerate(ids)], LABELS)
    quality_classifier.train(texts, labels)
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 1 << 30)
    quality_classifier.train(texts, labels)
    assert seen == [[1, 2, 200]] * 2


def _plain_logit(model, bag):
    """The forward pass of one text, passage by passage."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    hidden = [np.tanh(((x - model.mean) * model.scale) @ p["W"] + p["b"]) for x in bag]
    energy = [sum(np.tanh(h @ p["V"][:, j]) * (1 / (1 + np.exp(-h @ p["U"][:, j]))) * p["w"][j] for j in range(len(p["w"]))) for h in hidden]
    weight = np.exp(np.array(energy) - max(energy))
    return float(sum(w * h for w, h in zip(weight / weight.sum(), hidden, strict=True)) @ p["c"] + p["d"][0])


def test_attention_by_plain_passes_and_numeric_gradients():
    rng = np.random.default_rng(5)
    bags, y = [rng.standard_normal((n, 6)) for n in (1, 4, 2)], np.array([1.0, 0.0, 1.0])
    model = quality_classifier.AttentionModel(rng.standard_normal(6), np.full(6, 0.7), None)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    before, x = np.cumsum([0, 1, 4, 2]), np.concatenate(bags)
    assert np.allclose(model.forward(x, before)["logit"], [_plain_logit(model, b) for b in bags])
    loss = lambda: float(np.mean([np.log1p(np.exp(-z)) if t else np.log1p(np.exp(z)) for z, t in zip((_plain_logit(model, b) for b in bags), y, strict=True)]))
    for name, g in model.gradients(model.forward(x, before), before, y).items():
        for at in [np.unravel_index(k, g.shape) for k in rng.choice(g.size, min(3, g.size), replace=False)]:
            kept, sides = model.p[name][at], []
            for step in (1e-5, -1e-5):
                model.p[name][at] = kept + step
                sides.append(loss())
            model.p[name][at] = kept
            assert abs((sides[0] - sides[1]) / 2e-5 - g[at]) < 1e-6


def test_classifier_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = registry.QUERIES["op9_quality_classifier"](spark, sf).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_rules_of_urls(spark):
    urls = ["http://a.example.com/en/7/x", "HTTP://Example.COM/en/8?q", "https://b.net/de/9#f", "https://example.net/de/8", "ftp://org/es/", "http://xorg/es/", "nothing", None, "://com/en/", "http://example.com"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, url_filter.rules_frame(spark)).collect()}
    assert got[0] == ("a.example.com", "/en/7/x", "example.com/en/7", "allow") and got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5][2:] == (None, "allow") and got[6] == got[7] == ("", "", None, "allow") and got[8][2:] == ("com/en/", "block") and got[9] == ("example.com", "", None, "allow")
    assert url_filter.url_verdicts(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_licences(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Ann\n\n" + mit.upper().replace(",", " ;"), mit + " more", "", None, licenses.KNOWN["notice-MIT"].replace("License", "licence")]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, license_id string")
    got = {r.doc_id: r.license_id for r in licenses.license_scan(df, licenses.known_licences(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: "notice-MIT"}


def test_licence_files(spark):
    """Whole files: titled, with copyright lines in several forms, wrapped otherwise; and texts that only resemble them."""
    known, holder = licenses.KNOWN, "Copyright Ann Bee 2020, 2021. All rights reserved.\n\n"
    files = {
        "MIT": "MIT License\n\nCopyright (c) 2020 X\n\n" + known["MIT"],
        "MIT ": "The MIT License (MIT)\n\nCopyright Ann Bee 2020\n\n" + known["MIT"],
        "ISC": "ISC License\n\n" + holder + known["ISC"],
        "Zlib": "zlib License\n\n(C) 1999 X\n\n" + known["Zlib"],
        "0BSD": "BSD Zero Clause License\n\nCopyright (C) 2020 X\n\n" + known["0BSD"],
        "BSD-2-Clause": "BSD 2-Clause License\n\n" + holder + known["BSD-2-Clause"],
        "BSD-3-Clause": "Copyright 2020 X\nAll rights reserved.\n\n" + " ".join(known["BSD-3-Clause"].split()),
        "Apache-2.0": known["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 X"),
        **{k: known[k] for k in ("Unlicense", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")},
    }
    others = ["MIT License", "Copyright law changed much in 1976, as all know\n" + known["MIT"], known["MIT"] + "\nMIT License"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*files.values(), *others])], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.license_scan(df, licenses.known_licences(spark)).collect()}
    assert [got[k] for k in range(len(got))] == [k.strip() for k in files] + [None] * len(others)


def test_licence_files_equal_sql(spark, tmp_path):
    known = licenses.KNOWN
    texts = ["MIT License\n\nCopyright Ann 2020\n\n" + known["MIT"], "Copyright Ann, 2020. All rights reserved\n" + known["BSD-2-Clause"], *(known[k] for k in sorted(known))]
    at = str(tmp_path)
    for name, rows, kind in (("documents", list(enumerate(texts)), "doc_id long, text string"), ("labels", [], LABELS)):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    _equal_to_sql(spark, at, "op1_license_scan")


def test_rollup(spark, tmp_path):
    kinds = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    first = spark.createDataFrame([("insert", "a", "en", "t", 10, None), ("insert", None, "en", "t", None, None)], kinds)
    second = spark.createDataFrame([("revise", "a", "en", "t", 7, 10), ("delete", None, "en", "t", 0, None)], kinds)
    assert rollup.commit("1", first) and rollup.commit("2", second) and not rollup.commit("1", first)
    assert {(r.source, r.documents, r.tokens) for r in rollup.totals(["1", "2", "2", "3"]).collect()} == {("a", 1, 7), (None, 0, 0)}
    assert rollup.compact(["1", "2"], "c") and {tuple(r) for r in rollup.totals(["c"]).collect()} == {("a", "en", "t", 1, 7)}
    assert {tuple(r) for r in rollup.totals(["c", "1", "2"]).collect()} == {("a", "en", "t", 1, 7)}
    shutil.rmtree(f"{tmp_path}/batch=1")
    assert not rollup.commit("1", first)
    assert rollup.commit("5", first.limit(0)) and rollup.totals(["5"]).count() == 0
    assert rollup.compact(["c", "5"], "d") and not rollup.commit("2", second) and {tuple(r) for r in rollup.totals(["d", "c"]).collect()} == {("a", "en", "t", 1, 7)}
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit("4", spark.createDataFrame([("other", "a", "en", "t", 1, None)], kinds))


def test_mix_deviates_by_less_than_a_block(spark, docs, rows, empty):
    targets = spark.createDataFrame([("s0", 5), ("s1", 3), ("s2", 1)], "source string, share long")
    plan = mixing.period_schedule(targets).collect()
    for r in plan:
        assert r.turn * r.period // r.share <= r.slot < -(-(r.turn + 1) * r.period // r.share)
    assert sorted(r.slot for r in plan) == list(range(9))
    placed = mixing.placed(docs, mixing.root_targets(docs), 4)
    assert placed.count() == len(rows) and placed.select("slot", "place").distinct().count() == len(rows)
    assert mixing.placed(empty, mixing.root_targets(empty)).count() == 0


def test_mix_keeps_a_hot_source_beside_thousands(spark):
    # roots 100 and 2000 times 2: all small sources have their one block in the first half of a period of 4100 slots
    rows = [(k, "hot") for k in range(10000)] + [(10000 + k, f"s{k % 2000}") for k in range(8000)]
    order = [r.source for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string")).collect()]
    last = max(k for k, s in enumerate(order) if s != "hot")
    assert len(order) == len(rows) and abs(order[:last].count("hot") - 50 * mixing.BLOCK_DOCS) <= 2 * mixing.BLOCK_DOCS


def test_mix_of_sources_without_targets(spark, docs, rows):
    targets = spark.createDataFrame([("s0", 3), ("unused", 2)], "source string, share long")
    placed = mixing.placed(docs, targets, 4).collect()
    assert sorted(str(r.doc_id) for r in placed) == sorted(str(r[0]) for r in rows) and len({(r.slot, r.place) for r in placed}) == len(rows)
    others = {r.source: [x for x in placed if x.source == r.source] for r in placed if r.source != "s0"}
    period = 3 + 2 + len(others)
    assert {(r.release, r.deadline) for x in others.values() for r in x} == {(r.block * period, (r.block + 1) * period) for x in others.values() for r in x}
    assert sorted(str(r.doc_id) for r in mixing.mixed(docs, targets).collect()) == sorted(str(r[0]) for r in rows)


def _equal_to_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    told = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((tuple(map(plain, r)) for r in told.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in registry.QUERIES[name](spark, folder).collect()), key=str) == want


@pytest.fixture(scope="session")
def folder(spark, docs, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 4 != 1), 0) for r in rows if r[0] < 30], LABELS).coalesce(1).write.parquet(f"{at}/labels.parquet")
    urls = ["http://a.example.com/en/7/x", "http://a.example.com/en/7/x", "HTTP://Example.COM/en/8?q", "https://b.net/de/9#f", "https://example.net/de/8", "ftp://org/es/", "http://é.org/es/ñ", "nothing", "", None, "://com/en/"]
    spark.createDataFrame([(k // 2, u) for k, u in enumerate(urls)], "page_id long, url string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_token_counts", "op3_quality_rules", "op4_url_filters", "op6_exact_dedup", "op7_mixing"])
def test_equals_sql(spark, folder, name):
    _equal_to_sql(spark, folder, name)


def test_good_documents_without_labels_are_kept(spark):
    """With every label, and with a tenth of them: the score of a usual document doesn't follow the amount of labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    for few, most in ((1, 0.0), (10, 0.15)):
        rows = quality_rules.quality_rules(docs, quality_rules.trusted_ids(labels.filter(f"doc_id % {few} = 0"))).select("doc_id", "kept", "base_failed").collect()
        told = [r.kept for r in rows if r.doc_id in good and not r.base_failed]
        assert told.count(False) <= most * len(told)


def test_rules_of_nothing(empty, spark):
    assert quality_rules.quality_rules(empty, spark.createDataFrame([], "doc_id long")).count() == 0


def test_pipeline(spark, folder, rows):
    """The stages' plain versions, one after the other; the mix's order from its own operator, which SQL checks above."""
    import corpus_pipeline

    good = {r.doc_id for r in registry.QUERIES["op3_quality_rules"](spark, folder).filter("kept").collect()}
    left = [r for r in rows if r[0] in good]
    best = {}
    for r in left:
        best[lower(r[1])] = max(best.get(lower(r[1]), r), r, key=lambda x: x[0])
    left = list(best.values())
    roots = plain_components(left)
    left = [r for r in left if roots[r[0]][1] == r[0]]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    order = [r.doc_id for r in mixing.mixed(spark.createDataFrame(left, names)).collect()]
    got = corpus_pipeline.run(spark, folder).collect()
    text = {r[0]: r[1] for r in left}
    tok = tokens.tokenizer(tokens.default_path())
    assert [r.doc_id for r in got] == order and [r.position for r in got] == list(range(len(order)))
    for r in got:
        ids = library_ids(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
