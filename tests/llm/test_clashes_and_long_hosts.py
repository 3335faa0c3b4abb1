"""Placing rows with clashing columns, and URLs with very long hosts."""

import time

from pyspark.sql import functions as F

from barloom.llm import mixing, url_filter


def test_placed_with_clashing_columns(docs):
    plain = docs.select("doc_id", "source")
    want = sorted(str(tuple(r)) for r in mixing.placed(plain, mixing.root_targets(plain)).collect())
    names = ("share", "period", "_slots", "_key", "_range", "_rank", "_row", "block", "place", "turn")
    clash = docs.withColumns({c: F.lit(c) for c in names})
    got = mixing.placed(clash, mixing.root_targets(clash))
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "source", *mixing.RESULTS).collect()) == want
    assert got.filter("share = 'share' and period = 'period' and _slots = '_slots' and _row = '_row' and turn = 'turn'").count() == len(want)


def test_long_hosts(spark):
    long = "a." * 30_000 + "net"
    rows = [(1, f"http://{long}/de/8"), (2, f"http://{long}.example.net/de/8"), (3, "http://net/de/"), (4, "http://.net/de/"), (5, "http://x..net./de/"), (6, None), (7, "http://" + "." * 5000 + "org/es/1")]
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rules_frame(spark)).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow"), 4: ("net/de/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("org/es/", "block")}
    assert time.time() - began < 60
    assert url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rules_frame(spark).limit(0)).filter("rule is not null").count() == 0
