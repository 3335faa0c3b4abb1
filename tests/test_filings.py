"""Feeds as published: broken documents, fallbacks in their order, links of all kinds, the newest file."""

import datetime as dt

from barloom.sources import filings


def test_put_call_ratio_takes_the_first_source_with_a_result(spark):
    chain = '{"optionChain": {"result": [{"options": [{"puts": [{"openInterest": 3}, {}], "calls": [{"openInterest": 4}]}, {"puts": [], "calls": [{"openInterest": 2}]}]}]}}'
    quote = '{"data": {"options": [{"option_type": "P", "open_interest": 13}, {"option_type": "C", "open_interest": 10}, {"option_type": "X", "open_interest": 99}]}}'
    none = '{"optionChain": {"result": [{"options": [{"puts": [{"openInterest": 3}], "calls": []}]}]}}'
    rows = [("a", 1, chain), ("a", 2, quote), ("b", 1, "<html>"), ("b", 2, quote), ("c", 1, none), ("c", 2, quote), ("d", 1, none), ("d", 2, None), ("e", 1, "{")]
    docs = spark.createDataFrame(rows, "k string, source int, body string")
    got = {r.k: (r.source, r.pcr, r.total_puts, r.total_calls, r.signal) for r in filings.put_call_ratio(docs, "k").collect()}
    other = (2, 1.3, 13, 10, "heavy_hedging")
    assert got == {"a": (1, 0.5, 3, 6, "neutral"), "b": other, "c": other}
    assert sorted((r.k, r.source) for r in filings.malformed(docs).collect()) == [("b", 1), ("d", 2), ("e", 1)]


def test_atom_links_and_forms(spark):
    at = "https://x.example/Archives/edgar/data/1/2-index.htm"
    entry = lambda inside: f"<entry><updated>2024-05-06T01:02:03Z</updated>{inside}</entry>"
    inside = [f"<filing-href>{at}</filing-href><id>no</id>", f'<content type="text/xml" href="{at}"/>', f'<link href="http://y.example/"/><link href="{at}"/>', f"<id>{at}</id>", "<id>urn:1</id>"]
    xml = f'<feed xmlns="http://www.w3.org/2005/Atom">{"".join(map(entry, inside * 3))}</feed>'
    got = filings.atom_entries(spark.createDataFrame([(1, xml)], "feed int, xml string")).collect()
    assert [(r.position, r.href, r.date) for r in got] == [(k, at, "2024-05-06") for k in range(10) if k % 5 != 4]
    pages = {'<a href="xslF345/a.xml"><a href=\'R1.xml\'><a href="http://z.example/b.xml">': "http://z.example/b.xml", '<a href="Financial.xml"><a href="/c/d.xml">': "https://x.example/c/d.xml", '<a href="e/f.xml">': "https://x.example/Archives/edgar/data/1/f.xml", "<a href='g.htm'>": None}
    df = spark.createDataFrame([(k, p, at) for k, p in enumerate(pages)], "k int, page string, at string")
    assert [r[0] for r in df.orderBy("k").select(filings.form_link(df["page"], df["at"])).collect()] == list(pages.values())


def test_files_of_a_listing_and_zeros(spark):
    listing = lambda *names: str({"directory": {"item": [{"name": n} for n in names]}}).replace("'", '"')
    rows = [(0, listing("a.xml", "X_InfoTable.XML"), "00012"), (1, listing("xsl/a.xml", "b.xml", "c.xml"), "000"), (2, listing("a.txt"), "7"), (3, "broken", "")]
    df = spark.createDataFrame(rows, "k int, listing string, n string").orderBy("k")
    got = df.select(filings.table_file(df["listing"]), filings.without_zeros(df["n"])).collect()
    assert [tuple(r) for r in got] == [("X_InfoTable.XML", "12"), ("b.xml", "0"), (None, "7"), (None, "0")]


def test_places_in_lists(spark):
    lists = spark.createDataFrame([("one", '{"feed": {"results": [{"id": "7"}, {"id": "8"}, {"id": "7"}]}}'), ("two", '{"feed": {"results": [{"id": "8"}]}}')], "list string, body string")
    got = filings.places_in_lists(lists, spark.createDataFrame([("7",), ("8",), ("9",)], "id string")).collect()
    assert sorted(map(tuple, got)) == [("7", 1, None), ("8", 2, 1), ("9", None, None)]


def test_newest_short_volume_is_chosen_by_file_name(spark, tmp_path):
    now = dt.date(2024, 1, 10)  # a Wednesday
    for k in range(1, 11):
        day = now - dt.timedelta(days=k)
        text = {1: "Date|Symbol|Short\n", 2: f"{day:%Y%m%d}|OTHER|1|0|2|Q\n", 5: f"{day:%Y%m%d}|me|60.0|0|100.0|Q\n"}.get(k, f"{day:%Y%m%d}|ME|{k}|0|100|Q\n{day:%Y%m%d}|ME|99|0|100|Q\n")
        (tmp_path / f"short{day:%Y%m%d}.txt").write_text(text)
    # neither of the two newest has the symbol, and 6 and 7 January are a weekend
    got = filings.newest_short_volume(spark, str(tmp_path), "ME", now)
    assert [tuple(r) for r in got.collect()] == [("2024-01-05", 60, 100, 60.0, "high_short")]
    assert len(got.inputFiles()) == 1 or "short20240105.txt" in got._jdf.queryExecution().toString()
    assert filings.newest_short_volume(spark, str(tmp_path), "NOBODY", now) is None
