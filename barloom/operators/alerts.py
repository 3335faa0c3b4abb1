"""Price alerts with hysteresis, in batch; streaming.alerts keeps the same rules in a state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.maths import places
from barloom.functions.text import market_session

#: The zone whose calendar day resets an alert: nine hours ahead of UTC.
DAY_SHIFT = "interval 9 hours"
LEAST, STEP = 4.0, 1.0
#: Hours of that zone at which the market closes and at which the morning's alerts go out.
CLOSE_HOUR, MORNING_HOUR = 5, 8
#: The most recent values that a week's report shows, by reading.
TAILS = {"alerts_fired": 8, "insider_trades": 5, "news_headlines": 5}


def alert_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr(DAY_SHIFT))


def after_close(ts: Column) -> Column:
    """Whether the market has closed since that calendar day began: 20:00 UTC is its hour 5."""
    return F.hour(ts + F.expr(DAY_SHIFT)) >= CLOSE_HOUR


def price_alerts(changes: DataFrame, least: float = LEAST, step: float = STEP) -> DataFrame:
    """symbol, day, ts, change_pct, direction of the changes (symbol, ts, change_pct) that alert.

    Changes while the market is closed never alert. A change of `least` percent or more alerts if it is the first of the day
    or since the market's close, turns the direction, or exceeds the last alert by `step`. So the alerts of one run of large changes in one direction depend on that run alone, and
    there only new extremes count: those are few, however long the run, and one fold over them finds the alerts.
    """
    big = changes.filter((F.abs("change_pct") >= least) & (market_session(F.col("ts")) != "CLOSED")).select("symbol", "ts", "change_pct", F.when(F.col("change_pct") > 0, "up").otherwise("down").alias("direction"), alert_day(F.col("ts")).alias("day"), after_close(F.col("ts")).alias("closed"))
    by_time = Window.partitionBy("symbol", "day", "closed").orderBy("ts", "change_pct")
    turned = F.coalesce((F.lag("direction").over(by_time) != F.col("direction")).cast("int"), F.lit(1))
    runs = big.withColumn("_turned", turned).withColumn("run", F.sum("_turned").over(by_time)).withColumn("size", F.abs("change_pct"))
    before = Window.partitionBy("symbol", "day", "closed", "run").orderBy("ts", "change_pct").rowsBetween(Window.unboundedPreceding, -1)
    extremes = runs.withColumn("_top", F.max("size").over(before)).filter("_top is null or size > _top")
    lists = extremes.groupBy("symbol", "day", "closed", "run", "direction").agg(F.sort_array(F.collect_list(F.struct("ts", "size", "change_pct"))).alias("all"))
    none = F.slice("all", 1, 0)
    fired = F.aggregate("all", F.struct(none.alias("out"), F.lit(-step).alias("top")), lambda s, x: F.when((F.size(s["out"]) == 0) | (x["size"] >= s["top"] + step), F.struct(F.concat(s["out"], F.array(x)).alias("out"), x["size"].alias("top"))).otherwise(s), lambda s: s["out"])
    return lists.select("symbol", "day", "direction", F.explode(fired).alias("x")).select("symbol", "day", "x.ts", "x.change_pct", "direction")


def deferred_alerts(closes: DataFrame, least: float = LEAST) -> DataFrame:
    """symbol, d, alert_on, change_pct, abs_pct, direction: days (symbol, d, change_pct) that closed with a large change.

    A close leaves an alert or clears the one before; the next morning, at MORNING_HOUR of alert_on, takes it. Mornings
    follow closes by three hours, so every large close is told once; streaming.alerts.deferred_alerts keeps the pending one.
    """
    change = places("change_pct", 2)
    told = closes.withColumn("change_pct", change).filter(F.abs("change_pct") >= least)
    return told.select("symbol", "d", F.date_add("d", 1).alias("alert_on"), places("change_pct", 1).alias("change_pct"), places(F.abs("change_pct"), 1).alias("abs_pct"), F.when(F.col("change_pct") > 0, "up").otherwise("down").alias("direction"))


def new_by_hash(items: DataFrame, stored: DataFrame) -> DataFrame:
    """The items whose hash isn't stored, one row of each hash: the one with the smallest id."""
    first = items.groupBy("hash").agg(F.min_by(F.struct(*items.columns), "id").alias("r")).select("r.*")
    return first.join(stored.select("hash").distinct(), "hash", "left_anti")


def rank_trend(ranks: DataFrame, step: int = 3, top: int = 5) -> DataFrame:
    """ranks (symbol, period, rank) with prev_rank (of the period just before), trend and in_top."""
    prev = F.when(F.lag("period").over(Window.partitionBy("symbol").orderBy("period")) == F.col("period") - 1, F.lag("rank").over(Window.partitionBy("symbol").orderBy("period")))
    out = ranks.withColumn("prev_rank", prev)
    diff = F.col("prev_rank") - F.col("rank")
    return out.withColumn("trend", F.when(diff >= step, "up").when(diff <= -step, "down").otherwise("")).withColumn("in_top", F.col("rank") <= top)


def weekly_readings(readings: DataFrame, tails: dict[str, int] = TAILS, tail: int = 5) -> DataFrame:
    """week, name, n, average, last values of readings (ts, name, value): a week's accumulators.

    As many last values as tails says for the reading, else `tail`; only that many of a task's rows are ranked with others.
    """
    week = F.date_trunc("week", "ts").cast("date")
    by = readings.groupBy(week.alias("week"), "name").agg(F.count("*").alias("n"), places(F.avg("value"), 2).alias("average"))
    late = Window.partitionBy("week", "name").orderBy(F.desc("ts"), F.desc("value"))
    own = F.lit(tail)
    for name, k in tails.items():
        own = F.when(F.col("name") == name, k).otherwise(own)
    ranked = readings.select(week.alias("week"), "name", "ts", "value").withColumn("_r", F.row_number().over(late)).filter(f"_r <= {max([tail, *tails.values()])}").filter(F.col("_r") <= own)
    shown = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("at"), places("value", 2).alias("v")))), lambda x: x["v"].cast("string"))
    return by.join(ranked.groupBy("week", "name").agg(F.array_join(shown, ",").alias("last")), ["week", "name"])
