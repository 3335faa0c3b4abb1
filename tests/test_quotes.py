"""Quotes, notes and summaries: nulls, short lists, few confirmed bars, sessions, answers that can't be read."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import notes
from barloom.sources import quotes, summaries

MONDAY = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)


def _charts(spark, charts):
    rows = []
    for symbol, (at, close, volume) in charts.items():
        told = {"timestamp": [int(t.timestamp()) for t in at], "indicators": {"quote": [{"close": close, "volume": volume}]}}
        rows.append((symbol, json.dumps({"chart": {"result": [told]}})))
    return quotes.chart_bars(spark.createDataFrame(rows, "symbol string, body string"), "symbol")


def _moments(spark, moments):
    return spark.createDataFrame([(k, t.strftime("%Y-%m-%d %H:%M")) for k, t in moments.items()], "symbol string, t string").select("symbol", F.to_timestamp("t").alias("now"))


def _days(*back):
    return [MONDAY - dt.timedelta(days=b) for b in back]


def test_charts_with_short_lists_nulls_and_none(spark):
    docs = [("a", '{"chart": {"result": [{"timestamp": [0, 86400], "indicators": {"quote": [{"close": [1.5, null], "volume": [3]}]}}]}}'), ("b", "busy"), ("c", None), ("d", '{"chart": {"result": null}}'), ("e", '{"chart": {"result": []}}')]
    got = quotes.chart_bars(spark.createDataFrame(docs, "k string, body string"), "k")
    assert [(r.k, r.position, str(r.ts), r.open, r.close, r.volume) for r in got.orderBy("position").collect()] == [("a", 0, "1970-01-01 00:00:00", None, 1.5, 3.0), ("a", 1, "1970-01-02 00:00:00", None, None, None)]


def test_null_policies(spark):
    bars = spark.createDataFrame([(1, 1.0, 2.0, 0.5, 1.5, 9.0), (2, 1.0, None, 0.5, 1.5, 9.0), (3, 1.0, 2.0, 0.5, 1.125, None)], "k int, open double, high double, low double, close double, volume double")
    assert [r.k for r in quotes.clean_bars(bars).orderBy("k").collect()] == [1, 3]
    assert [(r.high, r.volume) for r in quotes.clean_bars(bars, "zero").orderBy("k").collect()] == [(2.0, 9), (0.0, 9), (2.0, 0)]
    with pytest.raises(ValueError):
        quotes.clean_bars(bars, "none")


def test_snapshots_by_session_and_with_few_confirmed_bars(spark):
    hour = lambda h: MONDAY + dt.timedelta(hours=h)
    full = (_days(4, 3, 2, 0), [10.0, 20.0, None, 99.0], [7, 8, 9, 5])
    few = (_days(1, 0), [10.0, 12.0], [4, 6])
    daily = _charts(spark, {"pre": full, "post": full, "closed": full, "quiet": full, "few": few, "one": (_days(0), [5.0], [1]), "zero": (_days(2, 1), [3.0, 0.0], [1, 2])})
    minute = ([hour(-1), hour(9), hour(9.5)], [1.0, 22.004, None], [50, 3, 4])
    quiet = ([hour(-1), hour(9)], [1.0, None], [50, 3])
    minutes = _charts(spark, {"pre": minute, "post": minute, "closed": minute, "quiet": quiet, "few": minute, "one": minute, "zero": minute})
    at = _moments(spark, {"pre": hour(10), "post": hour(21), "closed": hour(2), "quiet": hour(10), "few": hour(10), "one": hour(10), "zero": hour(10)})
    got = {r.symbol: tuple(r)[1:] for r in quotes.snapshot(daily, minutes, at, "symbol").collect()}
    assert got == {
        "pre": ("PRE", 22.0, 20.0, 10.0, 7, 7), "post": ("POST", 22.0, 20.0, 10.0, 7, 7), "closed": ("CLOSED", 20.0, 20.0, 0.0, 9, 7), "quiet": ("PRE", 20.0, 20.0, 0.0, 0, 7),
        "few": ("PRE", 22.0, 12.0, 83.33, 7, 4), "zero": ("PRE", 22.0, 0.0, 0.0, 7, 1),
    }
    close = {r.symbol: (r.current, r.prev_close, r.volume) for r in quotes.snapshot(daily, minutes, at, "symbol", realtime=False).collect()}
    assert close["pre"] == (99.0, 20.0, 9) and close["few"] == (12.0, 10.0, 6)
    change = {r.symbol: r.change_pct for r in quotes.ticker_change(daily, minutes, at, "symbol").collect()}
    # after the session the day's own bar counts; one bar of today alone has nothing before it
    assert change == {"pre": 10.02, "post": 395.0, "closed": 395.0, "quiet": None, "few": 120.04, "one": None, "zero": None}


def test_notes_by_position(spark):
    items = spark.createDataFrame([(f, p, f"t{f}{p}") for f in (1, 2, 3) for p in range(3)], "feed int, position int, title string")
    told = [{"idx": 1, "relevant": True, "summary": "a"}, {"idx": 2, "summary": "b"}, {"idx": 3, "relevant": True, "summary": "c", "sentiment": "negative"}, {"idx": 3, "relevant": True, "summary": "d"}, {"idx": 9, "relevant": True}, {"relevant": True, "summary": "x"}]
    answers = spark.createDataFrame([(1, f"```json\n{json.dumps(told)}\n```"), (2, "```json\n[{\"idx\": 1, \"rel"), (4, "[]")], "feed int, body string")
    got = notes.annotated(items, answers)
    assert {(r.feed, r.position): (r.skip, r.summary, r.sentiment) for r in got.collect()} == {(1, 0): (False, "a", "neutral"), (1, 1): (True, None, None), (1, 2): (False, "d", "neutral")} | {(f, p): (False, None, None) for f in (2, 3) for p in range(3)}
    assert [(r.feed, r.place, r.summary, r.mark) for r in notes.shown(got, 1).collect()] == [(1, 1, "a", "o")]
    assert notes.annotated(items.limit(0), answers).count() == 0


def test_bars_of_scores_and_coverage(spark):
    df = spark.createDataFrame([("x", 0), ("x", 57), ("y", 100), ("y", None)], "g string, s int")
    assert [r[0] for r in df.filter("s is not null").orderBy("s").select(notes.bar_of(F.col("s"))).collect()] == ["░" * 10, "█" * 5 + "░" * 5, "█" * 10]
    assert sorted(map(tuple, notes.coverage(df, "g", F.col("s").isNotNull()).collect())) == [("x", 2, 2, "2/2"), ("y", 1, 2, "1/2")]


def test_summaries_are_read_back(spark, tmp_path):
    plan = spark.createDataFrame([("a", 1.5, 2.0, 300.0, 310.0, 0.0333, 99.5, -0.25)], "symbol string, shares double, cash_left double, total_input double, final_value double, total_return double, avg_cost double, mdd double")
    best = spark.createDataFrame([], "symbol string, bucket string, avg double, winrate double, ev double")
    told = summaries.study_summary(spark.createDataFrame([("a", 3, 41.67), ("b", 1, 20.0)], "symbol string, n_samples long, score_mean double"), best, plan, plan.filter("false"))
    path = f"file://{tmp_path}/out"
    summaries.write_summaries(told, path)
    got = summaries.read_summaries(spark, path)
    assert sorted(got.collect(), key=str) == sorted(told.select(got.columns).collect(), key=str)
    with pytest.raises(Exception, match="exists|EXISTS"):
        summaries.write_summaries(told, path)
