"""Charts as quote services publish them: JSON documents with epoch seconds beside lists of prices, in which any value may be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.maths import places, ratio
from barloom.functions.text import market_session

PRICES = ("open", "high", "low", "close", "volume")
CHART = f"chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<{', '.join(f'{c}: array<double>' for c in PRICES)}>>>>>>"


def chart_bars(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, position, ts, open, high, low, close, volume of charts (keys, body), a row for each place in the lists.

    Lists shorter than the longest end in nulls; documents that aren't charts have no rows.
    """
    told = docs.select(*keys, F.get(F.from_json("body", CHART)["chart"]["result"], F.lit(0)).alias("r"))
    told = told.select(*keys, F.col("r.timestamp").alias("at"), F.get("r.indicators.quote", F.lit(0)).alias("q"))
    none = F.array().cast("array<double>")
    lists = F.arrays_zip(F.coalesce("at", F.array().cast("array<bigint>")).alias("at"), *(F.coalesce(F.col(f"q.{c}"), none).alias(c) for c in PRICES))
    rows = told.select(*keys, F.posexplode(lists).alias("position", "b"))
    return rows.select(*keys, "position", F.timestamp_seconds("b.at").alias("ts"), *(F.col(f"b.{c}") for c in PRICES))


def clean_bars(bars: DataFrame, null_policy: str = "drop") -> DataFrame:
    """Bars without nulls: those that lack a price go (drop), or every null becomes 0 (zero). Volumes are whole, 0 where null.

    With zero, lows and closes of 0 reach whatever is computed of them, as in the original definition.
    """
    if null_policy not in ("drop", "zero"):
        raise ValueError(f"null_policy is drop or zero, not {null_policy}")
    kept = bars.na.drop(subset=list(PRICES[:4])) if null_policy == "drop" else bars.na.fill(0.0, list(PRICES[:4]))
    return kept.withColumn("volume", F.coalesce(F.col("volume").cast("long"), F.lit(0).cast("long")))


def close_history(bars: DataFrame, *keys: str) -> DataFrame:
    """keys, position, close to 2 places, of the bars that have one."""
    return bars.filter("close is not null").select(*keys, "position", places("close", 2).alias("close"))


def _told(daily: DataFrame, moments: DataFrame, keys: tuple[str, ...], least: int) -> DataFrame:
    """keys, now, and what daily bars tell at that moment; confirmed bars are those of days before it.

    last, last2: the newest closes of all bars; n_all: how many there are; confirmed: the newest close of the confirmed
    bars, of all bars where fewer than `least` are confirmed; volume and volume_avg: the newest volume of the same bars and
    the mean of the five before it (of that one where there are no others). One exchange by keys serves all of it.
    """
    rows = daily.join(moments, list(keys)).withColumn("_before", F.to_date("ts") < F.to_date("now"))
    whole = Window.partitionBy(*keys)
    back = whole.orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0)
    closed = F.col("_before") & F.col("close").isNotNull()
    rows = rows.withColumn("_n", F.count(F.when(closed, 1)).over(whole)).withColumn("_use", F.coalesce(F.col("_before"), F.lit(False)) | (F.col("_n") < least))
    with_close, with_volume = F.col("_use") & F.col("close").isNotNull(), F.col("_use") & F.col("volume").isNotNull()
    rows = rows.withColumn("_all", F.count("close").over(back)).withColumn("_c", F.count(F.when(with_close, 1)).over(back)).withColumn("_v", F.count(F.when(with_volume, 1)).over(back))
    number = F.col("volume").cast("long")
    pick = lambda condition, value: F.max(F.when(condition, value))
    out = rows.groupBy(*keys, "now").agg(
        pick(F.col("close").isNotNull() & (F.col("_all") == 1), F.col("close")).alias("last"),
        pick(F.col("close").isNotNull() & (F.col("_all") == 2), F.col("close")).alias("last2"),
        F.count("close").alias("n_all"),
        F.max("_n").alias("n_confirmed"),
        pick(with_close & (F.col("_c") == 1), F.col("close")).alias("confirmed"),
        pick(with_volume & (F.col("_v") == 1), number).alias("volume"),
        F.floor(F.avg(F.when(with_volume & F.col("_v").between(2, 6), number))).cast("long").alias("_past"),
    )
    zero = F.lit(0).cast("long")
    return out.withColumn("volume", F.coalesce("volume", zero)).withColumn("volume_avg", F.coalesce("_past", "volume", zero)).drop("_past")


def _today(minutes: DataFrame, moments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, minute: the newest close of the minutes of the moment's day, and minute_volume: their volume."""
    rows = minutes.join(moments, list(keys)).filter(F.to_date("ts") == F.to_date("now"))
    known = F.col("close").isNotNull()
    return rows.groupBy(*keys).agg(F.max_by(F.when(known, F.col("close")), F.when(known, F.col("position"))).alias("minute"), F.sum(F.coalesce(F.col("volume").cast("long"), F.lit(0))).alias("minute_volume"))


def _change(now: Column, before: Column) -> Column:
    return places(ratio(now - before, before) * 100, 2)


def snapshot(daily: DataFrame, minutes: DataFrame, moments: DataFrame, *keys: str, realtime: bool = True) -> DataFrame:
    """keys, state, current, prev_close, change_pct, volume, volume_avg at each moment (keys, now), from bars with the same keys.

    The close before is that of the newest confirmed bar; where fewer than two are confirmed, all bars count, and keys with
    fewer than two closes have no row. Before, in and after the session the price is the newest close of the day's minutes
    and the volume theirs, or the close before and 0 where no minute has a close. When closed nothing changes. Without
    realtime, the two newest closes of all bars are compared, whatever the session.
    """
    rows = _told(daily, moments, keys, 2).join(_today(minutes, moments, keys), list(keys), "left").filter("n_confirmed >= 2 or n_all >= 2")
    state = market_session(F.col("now"))
    none = F.col("minute").isNull()
    if realtime:
        prev = places("confirmed", 2)
        current = F.when((state == "CLOSED") | none, prev).otherwise(places("minute", 2))
        volume = F.when(state == "CLOSED", F.col("volume")).when(none, F.lit(0).cast("long")).otherwise(F.col("minute_volume"))
    else:
        prev, current, volume = places("last2", 2), places("last", 2), F.col("volume")
    told = rows.select(*keys, state.alias("state"), current.alias("current"), prev.alias("prev_close"), volume.alias("volume"), "volume_avg")
    change = F.when(F.col("prev_close") == 0, 0.0).otherwise(_change(F.col("current"), F.col("prev_close")))
    return told.select(*keys, "state", "current", "prev_close", change.alias("change_pct"), "volume", "volume_avg")


def ticker_change(daily: DataFrame, minutes: DataFrame, moments: DataFrame, *keys: str) -> DataFrame:
    """keys, state, change_pct against the newest confirmed close, or where there is none the newest but one of all.

    Before and in the session the price is the newest close of the day's minutes, after it and when closed the newest daily
    close. Null where either is missing or 0.
    """
    rows = _told(daily, moments, keys, 1).join(_today(minutes, moments, keys), list(keys), "left")
    state = market_session(F.col("now"))
    prev = F.when(F.col("n_confirmed") > 0, F.col("confirmed")).otherwise(F.col("last2"))
    current = F.when(state.isin("PRE", "REGULAR"), F.col("minute")).otherwise(F.col("last"))
    told = rows.select(*keys, state.alias("state"), current.alias("_now"), prev.alias("_prev"))
    return told.select(*keys, "state", F.when((F.col("_now") != 0) & (F.col("_prev") != 0), _change(F.col("_now"), F.col("_prev"))).alias("change_pct"))
