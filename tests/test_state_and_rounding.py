"""Exact rounding, scores as of each day, and state tables."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.maths import places
from barloom.operators import recursive, scoring
from barloom.sources.state import StateTable
from test_operators import BARS, make_bars, plain_rsi


def test_places_is_pythons_round(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-1000, 1000) for _ in range(50_000)] + [round(rng.uniform(-100, 100), 3) for _ in range(30_000)]
    xs += [rng.randint(-(10**6), 10**6) / 2 ** rng.randint(0, 12) for _ in range(30_000)] + [struct.unpack("d", rng.randbytes(8))[0] for _ in range(5000)]
    # raw scores whose scaled value is a tie, and numbers near ties or too large for places
    xs += [v / 80 * 100 for v in (50, 58, 30, 38, 10)] + [27 * 1.2 / 80 * 100, 2.675, 1.005, 0.125, -0.375, 1e15 + 0.5, 2.0**52 + 0.5, 1e300, -1e300, 0.0]
    xs = [x for x in xs if x == x and abs(x) != float("inf")]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(places("x", n).alias(f"p{n}") for n in (0, 1, 2, 4, 6, 12))).collect()
    assert all(r[f"p{n}"] == round(r.x, n) for r in got for n in (0, 1, 2, 4, 6, 12))
    assert [round(v / 80 * 100) for v in (50, 58, 30, 38, 10)] == [62, 72, 38, 48, 12]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(places("x", 2).alias("p")).collect()
    assert odd[0].p is None and str(odd[1].p) == "nan" and odd[2].p == float("inf")
    assert (recursive.rounded(np.array([2.675, 0.125]), 2) == [2.67, 0.12]).all()


def plain_histogram(c):
    """The last MACD histogram of closes, which start the means."""
    if len(c) < 35:
        return None

    def mean(x, n):
        y, out = x[0], [x[0]]
        for v in x[1:]:
            y += (v - y) * 2 / (n + 1)
            out.append(y)
        return out

    line = [a - b for a, b in zip(mean(c, 12), mean(c, 26), strict=True)]
    return line[-1] - mean(line, 9)[-1]


def test_week_to_date_is_the_fold_of_closed_weeks_and_the_bar():
    bars = make_bars(330, 9)
    close, days = [b[6] for b in bars], [b[2] for b in bars]
    week = np.array([(d.toordinal() - 1) // 7 for d in days])
    got = recursive.week_to_date(np.array(close), week)
    for t in range(len(bars)):
        weeks = [close[max(k for k in range(t + 1) if week[k] == w)] for w in sorted(set(week[: t + 1]))]
        assert got["weeks"][t] == len(weeks)
        assert got["week_rsi"][t] == pytest.approx(plain_rsi(weeks), abs=0.0051)
        for name, x in (("week_hist", weeks), ("week_hist_before", weeks[:-1])):
            h = plain_histogram(x)
            assert np.isnan(got[name][t]) if h is None else got[name][t] == pytest.approx(h, abs=6e-5)


def test_technical_score_of_a_day_needs_no_later_bar(spark):
    bars = make_bars(290, 4) + make_bars(40, 6, "B")
    run = lambda rows: {(r.symbol, r.d): tuple(r) for r in scoring.technical_items(spark.createDataFrame(rows, BARS)).collect()}
    every = run(bars)
    assert len(every) == 261 + 11
    for cut in (33, 100, 251, 264, 287):  # within weeks, before and after there are 35 of them
        part = run(bars[:cut])
        assert len(part) == cut - 29 and all(every[k] == v for k, v in part.items())


def test_snapshots_are_published_whole(spark, tmp_path):
    kept = StateTable(spark, str(tmp_path / "s"))
    wanted = {"k": ("string", ""), "n": ("long", 0), "note": ("string", "-")}
    assert kept.read(wanted).count() == 0 and kept.read(wanted).columns == ["k", "n", "note"]
    assert kept.write(spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")) == 1
    assert sorted(map(tuple, kept.read(wanted).collect())) == [("a", 1, "-"), ("b", 0, "-")]
    # a writer that died before it published
    spark.createDataFrame([("z", 9)], "k string, n int").write.parquet(str(tmp_path / "s" / "data" / "2-dead"))
    assert sorted(r.k for r in kept.read(wanted).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="k"):
        kept.write(spark.createDataFrame([("a",)], "k string").select(F.raise_error(F.lit("k")).alias("k")))
    assert kept.versions() == [1]
    assert kept.write(kept.read(wanted).filter("k = 'a'").withColumn("n", F.col("n") + 1)) == 2
    assert [tuple(r) for r in kept.read(wanted).collect()] == [("a", 2, "-")]
    # another writer of the same version gets an error, and nothing of it is read
    late = StateTable(spark, str(tmp_path / "s"))
    late.versions = lambda: [1]
    with pytest.raises(Exception, match="exist"):
        late.write(spark.createDataFrame([("y", 1, "")], "k string, n long, note string"))
    assert [tuple(r) for r in kept.read(wanted).collect()] == [("a", 2, "-")]


def test_keys_are_computed_once(spark, tmp_path):
    kept, asked = StateTable(spark, str(tmp_path / "s")), []

    def compute(missing):
        rows = sorted(r.d for r in missing.collect())
        asked.append(rows)
        return spark.createDataFrame([(d, d * d) for d in rows], "d long, v long")

    days = lambda *x: spark.createDataFrame([(d,) for d in x], "d long")
    read = lambda df: sorted(map(tuple, df.collect()))
    assert read(kept.once(days(1, 2, 2), compute)) == [(1, 1), (2, 4)]
    assert read(kept.once(days(2, 3), compute)) == [(2, 4), (3, 9)]
    assert read(kept.once(days(1, 3), compute)) == [(1, 1), (3, 9)]
    assert asked == [[1, 2], [3]]
    kept.write(spark.createDataFrame([(1, -1)], "d long, v long"))  # a writer that came later
    assert read(kept.once(days(1), compute)) == [(1, 1)]
