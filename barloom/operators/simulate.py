"""Score-driven periodic investment, in closed form.

With 100 a day coming in and a target of purchases by score, the cash left is max(cash + 100 - target, 0): a
reflected walk, which is the sum of 100 - target less its running minimum (and 0). No loop over days is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.maths import places, ratio
from barloom.operators.rolling import by_day
from barloom.operators.scoring import buy_amount

DAILY = 100.0


def _ever():
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def dynamic_plan(scored: DataFrame) -> DataFrame:
    """symbol, d, score, close, buy, cash, shares, portfolio, total_input for each day with a price above 0."""
    days = scored.filter("close > 0").select("symbol", "d", "score", "close").withColumn("_s", F.sum(DAILY - buy_amount(F.col("score"))).over(_ever()))
    days = days.withColumn("cash", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(_ever())))
    days = days.withColumn("buy", F.coalesce(F.lag("cash").over(by_day()), F.lit(0.0)) + DAILY - F.col("cash"))
    return _with_portfolio(days.drop("_s"))


def baseline_plan(scored: DataFrame) -> DataFrame:
    """The same columns for buying the whole amount every day."""
    return _with_portfolio(scored.filter("close > 0").select("symbol", "d", "score", "close", F.lit(0.0).alias("cash"), F.lit(DAILY).alias("buy")))


def _with_portfolio(days: DataFrame) -> DataFrame:
    days = days.withColumn("shares", F.sum(F.col("buy") / F.col("close")).over(_ever())).withColumn("total_input", F.count(F.lit(1)).over(_ever()) * DAILY)
    return days.withColumn("portfolio", F.col("shares") * F.col("close") + F.col("cash")).select("symbol", "d", "score", "close", "buy", "cash", "shares", "portfolio", "total_input")


def summary(plan: DataFrame) -> DataFrame:
    """symbol, shares, cash_left, total_input, final_value, total_return, avg_cost, mdd."""
    peak = F.max("portfolio").over(_ever())
    days = plan.withColumn("_fall", ratio(F.col("portfolio") - peak, peak))
    end = days.groupBy("symbol").agg(F.max_by(F.struct("shares", "cash", "total_input", "portfolio"), "d").alias("e"), F.min("_fall").alias("mdd"))
    return end.select(
        "symbol",
        places("e.shares", 4).alias("shares"),
        places("e.cash", 2).alias("cash_left"),
        F.col("e.total_input").alias("total_input"),
        places("e.portfolio", 2).alias("final_value"),
        places(ratio(F.col("e.portfolio") - F.col("e.total_input"), F.col("e.total_input")), 4).alias("total_return"),
        places(ratio(F.col("e.total_input"), F.col("e.shares")), 4).alias("avg_cost"),
        places("mdd", 4).alias("mdd"),
    )


def compared(dynamic: DataFrame, baseline: DataFrame) -> DataFrame:
    """symbol and the dynamic plan's return, drawdown and mean cost less the baseline's."""
    a, b = (df.select("symbol", *(F.col(c).alias(f"{k}_{c}") for c in ("total_return", "mdd", "avg_cost"))) for k, df in (("a", dynamic), ("b", baseline)))
    return a.join(b, "symbol").select("symbol", *(places(F.col(f"a_{c}") - F.col(f"b_{c}"), 4).alias(f"{c}_diff") for c in ("total_return", "mdd", "avg_cost")))


def ledger(trades: DataFrame) -> DataFrame:
    """symbol, shares, avg_price of trades (symbol, shares, price)."""
    return trades.groupBy("symbol").agg(F.sum("shares").alias("shares"), places(F.try_divide(F.sum(F.col("shares") * F.col("price")), F.sum("shares")), 4).alias("avg_price"))
