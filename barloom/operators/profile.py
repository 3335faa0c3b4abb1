"""Volume profiles and prices near a time, over ticks (symbol, ts, close, volume).

"Now" is a symbol's last tick. Conditions on time are aggregates and windows per symbol: no rows are paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.maths import places, ratio


def _with_now(ticks: DataFrame) -> DataFrame:
    """ticks with now, from an aggregate of one row for each symbol."""
    return ticks.join(ticks.groupBy("symbol").agg(F.max("ts").alias("now"), F.max_by("close", F.struct("ts", "close")).alias("current")), "symbol")


def volume_profile(ticks: DataFrame, minutes: int = 30, bucket: float = 0.10, least: int = 5) -> DataFrame:
    """symbol, poc_price, vol_recent, poc_signal: the price bucket with the most volume in the last minutes; ties to the bucket met first."""
    recent = _with_now(ticks).filter(F.col("ts") >= F.col("now") - F.expr(f"interval {minutes} minutes"))
    sums = recent.groupBy("symbol", "current", places(F.rint(F.col("close") / bucket) * bucket, 2).alias("price")).agg(F.sum("volume").alias("v"), F.count("*").alias("n"), F.min("ts").alias("at"))
    best = sums.groupBy("symbol", "current").agg(F.max_by("price", F.struct("v", (-F.unix_micros("at")).alias("at"))).alias("poc_price"), F.sum("v").alias("vol_recent"), F.sum("n").alias("n"))
    return best.filter(F.col("n") >= least).select("symbol", "poc_price", "vol_recent", F.when(F.col("current") < F.col("poc_price"), "resistance").otherwise("support").alias("poc_signal"))


def same_time_volume(ticks: DataFrame, minutes: int = 30, whale: float = 1.5) -> DataFrame:
    """symbol, vol_recent, vol_avg, vol_ratio, whale: recent volume against the mean of earlier days at the same minutes."""
    minute = lambda c: F.hour(c) * 60 + F.minute(c)
    rows = _with_now(ticks).withColumn("since", F.col("now") - F.expr(f"interval {minutes} minutes"))
    recent = F.when(F.col("ts") >= F.col("since"), F.col("volume"))
    past = (F.to_date("ts") != F.to_date("now")) & minute("ts").between(minute("since"), minute("now"))
    days = rows.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum(recent).alias("recent"), F.sum(F.when(past, F.col("volume"))).alias("past"))
    out = days.groupBy("symbol").agg(F.coalesce(F.sum("recent"), F.lit(0)).alias("vol_recent"), F.coalesce(F.floor(F.avg("past")), F.lit(0)).cast("long").alias("vol_avg"))
    out = out.withColumn("vol_ratio", F.when(F.col("vol_avg") > 0, places(ratio(F.col("vol_recent"), F.col("vol_avg")), 2)).otherwise(0.0))
    return out.withColumn("whale", F.col("vol_ratio") >= whale)


def momentum(ticks: DataFrame, tolerance: int = 180) -> DataFrame:
    """symbol, current, price_30m, price_60m, mom_curr, mom_prev, momentum: prices nearest to 30 and 60 minutes ago, if within the tolerance in seconds."""
    rows = _with_now(ticks)
    aggs = []
    for m in (30, 60):
        off = F.abs(F.unix_micros("ts") - F.unix_micros("now") + m * 60_000_000)
        near = off <= tolerance * 1_000_000
        aggs.append(F.min_by(F.when(near, F.col("close")), F.when(near, F.struct(off, "ts", "close"))).alias(f"price_{m}m"))
    out = rows.groupBy("symbol", "current").agg(*aggs)
    known = (F.col("price_30m") > 0) & (F.col("price_60m") > 0)
    change = lambda a, b: F.when(known, ratio(F.col(a) - F.col(b), F.col(b)) * 100).otherwise(0.0)
    out = out.withColumn("_c", change("current", "price_30m")).withColumn("_p", change("price_30m", "price_60m"))
    c, p = F.col("_c"), F.col("_p")
    signal = F.when((c < 0) & (p < 0), F.when(c < p, "accelerating").otherwise("decelerating")).when((c > 0) & (p < 0), "decelerating").otherwise("stable")
    return out.select("symbol", "current", "price_30m", "price_60m", places("_c", 2).alias("mom_curr"), places("_p", 2).alias("mom_prev"), signal.alias("momentum"))


def bars_from_ticks(ticks: DataFrame, every: str = "1 hour") -> DataFrame:
    """symbol, start, open, high, low, close, volume in tumbling windows."""
    by = ticks.groupBy("symbol", F.window("ts", every).alias("w"))
    at = F.struct("ts", "close")
    out = by.agg(F.min_by("close", at).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def price_snapshot(ticks: DataFrame) -> DataFrame:
    """symbol, current, prev_close, change_pct, today_volume, avg_volume (of five days before the last full one): the last day is today."""
    days = ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("close", F.struct("ts", "close")).alias("close"), F.sum("volume").alias("volume"))
    w = Window.partitionBy("symbol").orderBy("day")
    out = days.withColumn("prev_close", F.lag("close").over(w)).withColumn("avg_volume", F.floor(F.avg("volume").over(w.rowsBetween(-6, -2))).cast("long")).withColumn("_last", F.lead("day").over(w).isNull())
    change = places(ratio(F.col("close") - F.col("prev_close"), F.col("prev_close")) * 100, 2)
    return out.filter("_last").select("symbol", F.col("close").alias("current"), "prev_close", change.alias("change_pct"), F.col("volume").alias("today_volume"), "avg_volume")
