"""Bars, macro history, ticks and feeds as DataFrames over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.maths import places

#: The order priority whose orders stand for the second asset of the macro history.
SECOND_ASSET = "1-URGENT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector, d, open, high, low, close, volume: one bar per nation and shipping day.

    Quantities of 0 have no price and make no bar. Rows are summed per (symbol, day) before they are shuffled.
    """
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity <> 0").select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("q"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    places = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), "d").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("q").alias("volume")
    )


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Bars resampled to weeks that begin on Mondays."""
    week = F.date_trunc("week", "d").cast("date")
    return bars.groupBy("symbol", "sector", week.alias("week")).agg(F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))


def macro_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, btc_close, btc_sma20, btc_above, vix for each day of the second asset.

    One aggregate gives both series; vix is carried forward onto the asset's days. The result has a row per
    calendar day, so ordering it as a whole is a matter of thousands of rows at any scale.
    """
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg((F.avg("o_totalprice") / 10000).alias("vix"), F.avg(F.when(F.col("o_orderpriority") == SECOND_ASSET, F.col("o_totalprice"))).alias("btc_close"))
    by_day = Window.orderBy("d")
    carried = days.withColumn("vix", F.last("vix", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0))).filter("btc_close is not null")
    last20 = by_day.rowsBetween(-19, 0)
    sma = F.when(F.count("btc_close").over(last20) == 20, F.avg("btc_close").over(last20))
    return carried.withColumn("btc_sma20", sma).select("d", "btc_close", "btc_sma20", F.coalesce(F.col("btc_close") > F.col("btc_sma20"), F.lit(False)).alias("btc_above"), "vix")


def macro_point(macro: DataFrame) -> DataFrame:
    """One row: the latest macro values, with defaults where there are none."""
    last = macro.agg(F.max_by("btc_above", "d").alias("btc_above"), F.max_by("vix", "d").alias("vix"), F.max_by("btc_close", "d").alias("btc_price"), F.max_by("btc_sma20", "d").alias("btc_sma20"))
    return last.select(F.coalesce("btc_above", F.lit(False)).alias("btc_above"), *(places(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("vix", "btc_price", "btc_sma20")))


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, close, volume of every line with a quantity, at minute orderkey % 1440 of its shipping day."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity <> 0")
    ts = F.col("l_shipdate").cast("date").cast("timestamp") + F.make_interval(mins=(F.col("l_orderkey") % 1440).cast("int"))
    rows = lines.select("l_suppkey", ts.alias("ts"), places(F.try_divide("l_extendedprice", "l_quantity"), 4).alias("close"), F.col("l_quantity").cast("long").alias("volume"))
    sites = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.join(sites, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("n_name").alias("symbol"), "ts", "close", "volume")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, close, volume (1 per event)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), places("value", 4).alias("close"), F.lit(1).cast("long").alias("volume"), "event_id").filter("close is not null")
