"""Streams give what their batch twins give."""

import datetime as dt
import time

import pytest

from pyspark.sql import functions as F

from barloom.operators import alerts as batch
from barloom.operators import profile
from barloom.streaming import alerts, windows


@pytest.fixture
def ticks(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("AB"[k % 2], start + dt.timedelta(minutes=7 * k), float(k * 37 % 11), 1, float(k * 53 % 13 - 6)) for k in range(400)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume long, change_pct double")
    df.coalesce(1).write.parquet(f"{tmp_path}/ticks")
    return df, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/ticks")


def finished(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_alerts(spark, ticks):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.STATE_STORE)
    try:
        got = finished(alerts.price_alerts(ticks[1]), "alerts", "append")
        key = lambda df: sorted((r.symbol, r.ts, r.change_pct) for r in df.collect())
        assert key(got) == key(batch.price_alerts(ticks[0])) != []
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_late_rows_of_an_earlier_day_change_no_alert(spark, tmp_path):
    days = [[(2, 9.0)], [(3, 5.0)], [(2, 20.0)], [(3, 5.5)]]
    kinds = "symbol string, ts timestamp, change_pct double"
    for k, rows in enumerate(days):
        spark.createDataFrame([("A", dt.datetime(2024, 1, d, 9, k), c) for d, c in rows], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        time.sleep(1.1)  # files are read in the order of their times
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.STATE_STORE)
    try:
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
        assert sorted(r.change_pct for r in finished(alerts.price_alerts(stream), "late", "append").collect()) == [5.0, 9.0]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_bars(spark, ticks):
    key = lambda df: {(r.symbol, r.start): r[2:] for r in df.collect()}
    got, want = key(finished(windows.bars(ticks[1]), "bars", "append")), key(profile.bars_from_ticks(ticks[0]))
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 4


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.STATE_STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def in_steps(spark, tmp_path, parts, kinds, stream, mode):
    """What comes out of each part, read by a stream that is started anew for it from one checkpoint."""
    out = []
    for rows in parts:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = []
        q = stream(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True)
        q.foreachBatch(lambda df, _, got=got: got.extend(df.collect())).start().awaitTermination(180)
        out.append([tuple(r) for r in got])
    return out


def test_deferred_alerts_are_told_once_whatever_restarts(spark, rocks, tmp_path):
    at = lambda d, h=20: dt.datetime(2024, 1, d, h)
    parts = [
        [("A", at(2), 5.04), ("B", at(2), 1.0), ("C", at(2), -4.0)],  # pending: A and C
        [("A", at(3), 1.0), ("B", at(3), -9.26)],  # the morning between them tells A and C
        [("A", at(3), 1.0), ("A", at(2), 7.0), ("B", at(4), 0.0)],  # repeated and late rows; B is told
        [("A", at(5), 4.5), ("A", at(5, 21), 0.0), ("B", at(6), 0.0)],  # a second close of one day clears the alert
        [("A", at(8), 6.0), ("A", at(9), -6.0), ("A", at(10), 6.0), ("D", at(20), 0.0)],  # three mornings in one batch
    ]
    got = in_steps(spark, tmp_path, parts, "symbol string, ts timestamp, change_pct double", alerts.deferred_alerts, "append")
    told = sorted((r[0], r[1], r[2], *r[3:]) for part in got for r in part)
    m = lambda d: dt.datetime(2024, 1, d, 23)
    assert told == [("A", "2024-01-02", m(2), 5.0, 5.0, "up"), ("A", "2024-01-08", m(8), 6.0, 6.0, "up"), ("A", "2024-01-09", m(9), -6.0, 6.0, "down"), ("A", "2024-01-10", m(10), 6.0, 6.0, "up"), ("B", "2024-01-03", m(3), -9.3, 9.3, "down"), ("C", "2024-01-02", m(2), -4.0, 4.0, "down")]
    # the stream's alerts are those of the batch twin
    closes = spark.createDataFrame([(s, ts.date(), c) for p in parts for s, ts, c in p if ts.hour == 20 and (s, ts.day, c) not in (("A", 2, 7.0), ("A", 5, 4.5))], "symbol string, d date, change_pct double").distinct()
    assert {(r.symbol, str(r.d), r.change_pct) for r in batch.deferred_alerts(closes).collect()} == {(t[0], t[1], t[3]) for t in told}
    assert {str(r.alert_on) for r in batch.deferred_alerts(closes).filter("symbol = 'B'").collect()} == {"2024-01-04"}


def test_price_alerts_begin_anew_at_the_close(spark, rocks, tmp_path):
    at = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    rows = [("A", at(2, 15), 4.2), ("A", at(2, 16), 4.9), ("A", at(2, 17), 5.3), ("A", at(2, 18), -4.1), ("A", at(2, 18, 30), -4.6), ("A", at(2, 19), -5.2), ("A", at(2, 20), -5.3), ("A", at(2, 21), -5.9), ("A", at(3, 9), -6.4), ("A", at(3, 14), 4.0), ("A", at(3, 15), 4.0)]
    kinds = "symbol string, ts timestamp, change_pct double"
    want = [4.2, 5.3, -4.1, -5.2, -5.3, -6.4, 4.0, 4.0]
    assert [r.change_pct for r in batch.price_alerts(spark.createDataFrame(rows, kinds)).orderBy("ts").collect()] == want
    got = in_steps(spark, tmp_path, [rows[:7], rows[7:]], kinds, alerts.price_alerts, "append")
    assert [r[3] for part in got for r in sorted(part, key=lambda r: r[2])] == want


def test_items_that_come_back_are_new(spark, rocks, tmp_path):
    day = lambda k: dt.datetime(2024, 1, 1 + k)
    readings = [["a", "b"], ["a", "b"], ["c", "a"], ["b", "c"], ["d"], ["a", "b", "c", "d", "e"], ["e", "d", "d"]]
    sizes, seen, want = {"news": 3}, [], []
    for k, hashes in enumerate(readings):
        fresh = [(k, h) for h in hashes if h not in seen]
        want += fresh
        seen = hashes[:3] if fresh else seen
    rows = [[("news", day(k), i, h) for i, h in enumerate(hashes)] for k, hashes in enumerate(readings)]
    parts = [rows[0], rows[1] + rows[2], rows[3], rows[4] + rows[5] + rows[6]]
    got = in_steps(spark, tmp_path, parts, "feed string, read_at timestamp, position int, hash string", lambda df: alerts.new_in_feed(df, sizes), "append")
    assert sorted((r[1].day - 1, r[3]) for part in got for r in part) == sorted(want)
    assert (3, "b") in want  # it was in the first two readings, but not in the third


def test_weekly_tails_begin_anew(spark, rocks, tmp_path):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k), ("alerts_fired", "insider_trades")[k % 2], float(k % 23)) for k in range(90)]
    kinds = "ts timestamp, name string, value double"
    got = in_steps(spark, tmp_path, [rows[:10], rows[10:50], rows[50:]], kinds, alerts.weekly_readings, "update")
    last = {(r[0], r[1]): r[2:] for part in got for r in part}
    want = {(str(r.week), r.name_): (r.n, r.average, r.last) for r in batch.weekly_readings(spark.createDataFrame(rows, kinds)).withColumnRenamed("name", "name_").collect()}
    assert last == want and {len(v[2].split(",")) for k, v in want.items() if v[0] >= 8} == {8, 5}


def test_ledger_and_windows(spark, rocks, ticks, tmp_path):
    trades = [[("A", 1896.0, 101.13), ("B", 1.0, 2.0)], [("A", 4.0, 69.65), ("A", 69.0, 67.89)]]
    got = in_steps(spark, tmp_path, trades, "symbol string, shares double, price double", alerts.ledger, "update")
    assert ("A", 1969.0, 99.9012) in got[1] and ("A", 1896.0, 101.13) in got[0]
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    batch_of = {"volume_by_price": windows.volume_by_price, "today": windows.today}
    for name, fn in batch_of.items():
        stream = key(finished(fn(ticks[1]), name, "complete"))
        assert stream == key(fn(ticks[0])) != []
    readings = lambda df: df.select("ts", F.col("symbol").alias("name"), F.col("close").alias("value"))
    assert key(finished(windows.weekly_averages(readings(ticks[1])), "weekly", "complete")) == key(windows.weekly_averages(readings(ticks[0])))


def test_seen_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at, "a"), (at, "b"), (at + dt.timedelta(hours=5), "a"), (at + dt.timedelta(days=1), "b"), (at + dt.timedelta(days=2), "c")]
    spark.createDataFrame(rows, "ts timestamp, hash string").coalesce(1).write.parquet(f"{tmp_path}/n")
    got = finished(alerts.seen_once(spark.readStream.schema("ts timestamp, hash string").parquet(f"{tmp_path}/n")), "seen", "append")
    assert sorted(r.hash for r in got.collect()) == ["a", "b", "c"]
