"""Operators against plain Python on small series, at their guards and thresholds."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import maths, text
from barloom.operators import alerts, analysis, recursive, rolling, scoring, simulate
from barloom.sources import feeds

BARS = "symbol string, sector string, d date, open double, high double, low double, close double, volume double"


def make_bars(n, seed=1, symbol="A", flat=()):
    rng, out, p = random.Random(seed), [], 100.0
    for k in range(n):
        p = max(1.0, p + rng.choice([-2.0, -1.0, 0.0, 1.0, 2.5]))
        lo, hi = (p, p) if k in flat else (p - rng.random(), p + rng.random())
        out.append((symbol, "S", dt.date(2024, 1, 1) + dt.timedelta(k), p, hi, lo, p, float(rng.choice([0, 10, 20, 35]))))
    return out


def plain_rsi(c, n=14):
    if len(c) < n + 1:
        return 50.0
    d = [b - a for a, b in zip(c, c[1:], strict=False)]
    g, loss = sum(max(x, 0) for x in d[:n]) / n, sum(max(-x, 0) for x in d[:n]) / n
    for x in d[n:]:
        g, loss = (g * (n - 1) + max(x, 0)) / n, (loss * (n - 1) + max(-x, 0)) / n
    return 100.0 if loss == 0 else 100 - 100 / (1 + g / loss)


def test_rsi_is_the_loop(spark):
    bars = make_bars(60)
    closes = [b[6] for b in bars]
    got = [r.rsi for r in recursive.with_rsi(spark.createDataFrame(bars, BARS)).orderBy("d").collect()]
    assert got == pytest.approx([plain_rsi(closes[: k + 1]) for k in range(60)], abs=0.0051)
    assert recursive.rsi(np.arange(1.0, 40.0))[-1] == 100.0
    assert recursive.rsi(np.arange(1.0, 15.0))[-1] == 50.0


def test_divergence_restarts_its_rsi():
    c = np.array([b[6] for b in make_bars(120, 5)])
    got = recursive.rsi_divergence(c)
    for t in range(len(c)):
        if t < 33:
            assert not got[t]
            continue
        w = c[t - 33 : t + 1].tolist()
        r = [round(plain_rsi(w[: k + 1]), 2) for k in range(14, 34)]
        p = w[14:]
        assert got[t] == (min(p[10:]) < min(p[:10]) and min(r[10:]) > min(r[:10]))


def test_rolling_is_free_of_lookahead_and_of_scale(spark):
    bars = make_bars(80, 3, flat=(7, 8, 40))
    run = lambda rows: [tuple(r) for r in rolling.with_mfi(rolling.with_stochastic(rolling.with_cmf(spark.createDataFrame(rows, BARS)))).select("cmf", "cmf_skip", "stoch_k", "mfi").orderBy("d").collect()]
    whole = run(bars)
    assert run(bars[:50]) == whole[:50]
    assert run([(b[0], b[1], b[2], *(4 * x for x in b[3:7]), b[7]) for b in bars]) == whole
    assert all(-1 <= r[0] <= 1 for r in whole)
    assert whole[19][0] == 0.0 and whole[19][1] is None


def test_scores_round_halves_to_even(spark):
    rows = [(a, b, v, above) for a, b in ((50, 0), (50, 8), (30, 0), (30, 8), (10, 0), (5, 22)) for v, above in ((0.0, False), (25.0, True), (24.9, True))]
    df = spark.createDataFrame(rows, "layer_A int, layer_B int, vix double, btc_above boolean").withColumn("evsr", F.lit(1.0))
    for r in scoring.with_score(df).collect():
        mult = 0.8 if r.vix >= 25 else 1.2 if r.btc_above else 1.0
        assert r.score == min(100, round((r.layer_A + r.layer_B) * mult / 80 * 100))


def test_ladders_at_their_thresholds(spark):
    got = spark.createDataFrame([(s,) for s in (80, 79, 60, 40, 20, 19)], "s int").select(maths.grade(F.col("s")).alias("g")).collect()
    assert [r.g for r in got] == ["Strong Buy", "Buy", "Buy", "Neutral", "Caution", "Avoid"]
    at = ["2024-01-05 07:59:00", "2024-01-05 08:00:00", "2024-01-05 13:30:00", "2024-01-05 20:00:00", "2024-01-06 12:00:00"]
    got = spark.createDataFrame([(t,) for t in at], "t string").select(text.market_session(F.col("t").cast("timestamp")).alias("s")).collect()
    assert [r.s for r in got] == ["CLOSED", "PRE", "REGULAR", "POST", "CLOSED"]


def test_closed_form_plan_is_the_loop(spark):
    rng = random.Random(2)
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(k), rng.choice([10, 40, 60, 80, 95]), 10 + rng.random()) for k in range(300)]
    got = simulate.dynamic_plan(spark.createDataFrame(rows, "symbol string, d date, score int, close double")).orderBy("d").collect()
    cash = spent = 0.0
    for r, g in zip(rows, got, strict=True):
        cash += 100
        buy = min(cash, 200 if r[2] >= 80 else 100 if r[2] >= 60 else 50 if r[2] >= 40 else 0)
        cash, spent = cash - buy, spent + buy
        assert (g.buy, g.cash) == pytest.approx((buy, cash)) and g.cash + spent == pytest.approx(g.total_input)


def test_alerts_in_the_order_of_the_state_machine(spark):
    day = [4.2, 4.9, 5.3, -4.1, -4.6, -5.2]
    # before the market opens and at the weekend nothing alerts
    rows = [("A", dt.datetime(2024, 1, 2, 1, 0), 9.0), ("A", dt.datetime(2024, 1, 6, 12, 0), 9.0)]
    rows += [("A", dt.datetime(2024, 1, 2, 9, k), c) for k, c in enumerate(day)] + [("A", dt.datetime(2024, 1, 2, 20, 0), 4.0), ("A", dt.datetime(2024, 1, 2, 20, 1), 3.9)]
    got = alerts.price_alerts(spark.createDataFrame(rows, "symbol string, ts timestamp, change_pct double")).orderBy("ts").collect()
    assert [r.change_pct for r in got] == [4.2, 5.3, -4.1, -5.2, 4.0]


def test_ledger(spark):
    rows = [("A", 1896.0, 101.13), ("A", 4.0, 69.65), ("A", 69.0, 67.89)]
    assert simulate.ledger(spark.createDataFrame(rows, "symbol string, shares double, price double")).first()[1:] == (1969.0, 99.9012)


def test_constant_columns_have_no_correlation(spark):
    rows = [("A", 1, 5, *(0.1 * k for _ in range(5))) for k in range(12)]
    df = spark.createDataFrame(rows, "symbol string, layer_A int, layer_B int, return_5d double, return_10d double, return_20d double, return_30d double, return_60d double")
    assert {r.spearman for r in analysis.rank_correlation(df, ["layer_A"]).collect()} == {None}


FORM4 = """<ns:ownershipDocument xmlns:ns="urn:x"><ns:reportingOwner><ns:reportingOwnerId><ns:rptOwnerName>Ann</ns:rptOwnerName></ns:reportingOwnerId><ns:reportingOwnerRelationship><ns:isDirector>1</ns:isDirector></ns:reportingOwnerRelationship></ns:reportingOwner><ns:nonDerivativeTable>{}</ns:nonDerivativeTable></ns:ownershipDocument>"""
TRADE = "<ns:nonDerivativeTransaction><ns:transactionCoding><ns:transactionCode>{}</ns:transactionCode></ns:transactionCoding><ns:transactionAmounts><ns:transactionShares><ns:value>{}</ns:value></ns:transactionShares><ns:transactionPricePerShare><ns:value>2.5</ns:value></ns:transactionPricePerShare><ns:transactionAcquiredDisposedCode><ns:value>{}</ns:value></ns:transactionAcquiredDisposedCode></ns:transactionAmounts></ns:nonDerivativeTransaction>"


def test_filings(spark):
    cases = [("P", 10, "A"), ("S", 20, "D"), ("A", 30, "A"), ("G", 5, "D"), ("M", 6, "A"), ("F", 7, "D"), ("P", 0, "A")]
    xml = FORM4.format("".join(TRADE.format(*c) for c in cases))
    got = feeds.form4_trades(spark.createDataFrame([("2024-01-02", "u", xml)], "date string, url string, xml string")).collect()
    assert [(r.trade_type, r.shares, r.total_value, r.title, r.filer) for r in got] == [("Purchase", 10, 25.0, "Director", "Ann"), ("Sale", 20, 50.0, "Director", "Ann"), ("Award", 30, 75.0, "Director", "Ann"), ("Sale", 7, 17.5, "Director", "Ann")]
    row = "<infoTable><nameOfIssuer>{}</nameOfIssuer><value>{}</value><putCall>{}</putCall><shrsOrPrnAmt><sshPrnamt>{}</sshPrnamt></shrsOrPrnAmt></infoTable>"
    xml = "<informationTable>" + row.format("Acme Corp", 1, "Put", 1) + row.format("ACME CORP", 7, "", 70) + row.format("Acme", 9, "", 90) + "</informationTable>"
    tables = spark.createDataFrame([("u", xml)], "url string, xml string")
    assert feeds.infotable_position(tables, "acme").first()[:] == ("u", 70, 7000.0)
    assert feeds.infotable_position(tables, "acme", compat=True).first()[1] == 0


def test_short_volume_and_fallbacks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Date|Symbol|Short|Exempt|Total\n20240102|abc|10.0|0|40\n20240103|ABC|30.0|0|40\n20240103|X|1|0|1\n")
    assert feeds.short_volume(spark, str(tmp_path), "abc").first()[:] == ("20240103", 30, 40, 75.0, "high_short")
    a, b = spark.createDataFrame([], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert sorted(r.x for r in feeds.first_source([a, b]).collect()) == [1, 2]
