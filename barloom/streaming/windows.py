"""Windowed streams of ticks (symbol, ts, close, volume): bars, recent volume by price, day totals, weekly readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.maths import places
from barloom.operators.profile import bars_from_ticks


def bars(ticks: DataFrame, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Bars that are complete: in append mode a window comes out once the watermark has passed it."""
    return bars_from_ticks(ticks.withWatermark("ts", delay), every)


def volume_by_price(ticks: DataFrame, length: str = "30 minutes", slide: str = "1 minute", bucket: float = 0.10, delay: str = "10 minutes") -> DataFrame:
    """symbol, start, price, volume over sliding windows; the profile's peak is the row with the most volume."""
    price = places(F.rint(F.col("close") / bucket) * bucket, 2)
    by = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length, slide).alias("w"), price.alias("price")).agg(F.sum("volume").alias("volume"))
    return by.select("symbol", F.col("w.start").alias("start"), "price", "volume")


def today(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """symbol, day, current, volume, updated as ticks come in."""
    by = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.max_by("close", F.struct("ts", "close")).alias("current"), F.sum("volume").alias("volume"))
    return by.select("symbol", F.to_date("w.start").alias("day"), "current", "volume")


def weekly_averages(readings: DataFrame, delay: str = "1 day") -> DataFrame:
    """week, name, n, average of readings (ts, name, value) in windows of 7 days from Mondays."""
    by = readings.withWatermark("ts", delay).groupBy("name", F.window("ts", "7 days", "7 days", "4 days").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("average"))
    return by.select(F.to_date("w.start").alias("week"), "name", "n", "average")
