"""Rolling-window indicators: bars (symbol, d, open, high, low, close, volume) in, bars with more columns out.

All windows share one partitioning and order, so a chain of them takes one shuffle and one sort. Results are
null, or the indicator's own default, until a symbol has enough bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.maths import clamp, places, ratio


def by_day():
    """A symbol's bars in order; the one window specification of the library."""
    return Window.partitionBy("symbol").orderBy("d")


def last(n: int):
    return by_day().rowsBetween(1 - n, 0)


def full(value: Column, n: int, default: object = None) -> Column:
    """value once there are n bars, before that the default."""
    return F.when(F.count(F.lit(1)).over(last(n)) == n, value).otherwise(F.lit(default))


def lag(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(by_day())


def with_change(bars: DataFrame) -> DataFrame:
    """prev_close and change_pct."""
    prev = lag("close")
    return bars.withColumn("prev_close", prev).withColumn("change_pct", places(ratio(F.col("close") - prev, prev) * 100, 4))


def with_true_range(bars: DataFrame) -> DataFrame:
    """tr: null on the first bar."""
    prev = lag("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return bars.withColumn("tr", F.when(prev.isNotNull(), tr))


def with_atr(bars: DataFrame, n: int = 14, to: str = "atr") -> DataFrame:
    """The plain mean of n true ranges."""
    return with_true_range(bars).withColumn(to, full(F.avg("tr").over(last(n)), n + 1)).drop("tr")


def with_bands(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """sma, bb_upper, bb_lower, pct_from_lower, bb_signal."""
    mean, sd = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    out = bars.withColumn("sma", full(mean, n)).withColumn("bb_upper", full(places(mean + width * sd, 2), n)).withColumn("bb_lower", full(places(mean - width * sd, 2), n))
    out = out.withColumn("pct_from_lower", places(ratio(F.col("close") - F.col("bb_lower"), F.col("bb_lower")) * 100, 2))
    signal = F.when(F.col("bb_lower").isNull(), None).when(F.col("close") < F.col("bb_lower"), "extreme_oversold").when(F.col("close") > F.col("bb_upper"), "overbought").when(F.col("pct_from_lower") < 2, "oversold").otherwise("normal")
    return out.withColumn("bb_signal", signal)


def with_squeeze(bars: DataFrame, n: int = 20) -> DataFrame:
    """squeeze, bb_pos, below_lower, near_lower: bands inside Keltner channels of 1.5 mean true ranges.

    Without a mean true range the channel counts as the wider one.
    """
    mean, sd = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    out = with_atr(bars, n, "_atr").withColumn("_m", full(mean, n)).withColumn("_s", full(sd, n))
    squeeze = F.when(F.col("_m").isNull(), False).when(F.col("_atr") > 0, 4 * F.col("_s") < 3 * F.col("_atr")).otherwise(True)
    pos = clamp(ratio(F.col("close") - F.col("_m"), 2 * F.col("_s"), 0.0), -1.0, 1.0)
    lower = F.col("_m") - 2 * F.col("_s")
    out = out.withColumn("squeeze", squeeze).withColumn("bb_pos", F.when(F.col("_m").isNotNull(), places(pos, 2)).otherwise(0.0))
    return out.withColumn("below_lower", F.coalesce(F.col("close") < lower, F.lit(False))).withColumn("near_lower", F.coalesce(F.col("close") < lower * 1.03, F.lit(False))).drop("_atr", "_m", "_s")


def money_flow(n: int = 21, skip_flat: bool = False) -> Column:
    """Chaikin money flow. Bars with high = low count with their volume, or are left out of both sums."""
    span = F.col("high") - F.col("low")
    place = ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), span, 0.0)
    volume = F.when(span != 0, F.col("volume")).otherwise(0.0) if skip_flat else F.col("volume")
    return places(ratio(F.sum(place * F.col("volume")).over(last(n)), F.sum(volume).over(last(n)), 0.0), 4)


def with_cmf(bars: DataFrame, n: int = 21) -> DataFrame:
    """cmf (flat bars count; 0 until there are n bars) and cmf_skip (flat bars don't; null until then)."""
    return bars.withColumn("cmf", full(money_flow(n), n, 0.0)).withColumn("cmf_skip", full(money_flow(n, True), n))


def with_cmf_turning(bars: DataFrame, n: int = 21, back: int = 5) -> DataFrame:
    """cmf_now, cmf_prev, turning, positive."""
    out = bars.withColumn("_c", money_flow(n))
    out = out.withColumn("cmf_now", full(F.col("_c"), n + back, 0.0)).withColumn("cmf_prev", full(lag("_c", back), n + back, 0.0)).drop("_c")
    return out.withColumn("turning", (F.col("cmf_prev") < -0.02) & (F.col("cmf_now") > F.col("cmf_prev"))).withColumn("positive", F.col("cmf_now") > 0.02)


def with_evsr(bars: DataFrame, n: int = 20) -> DataFrame:
    """evsr: effort (volume against its mean) over result (move against the mean true range)."""
    out = with_atr(bars, n, "_atr").withColumn("_mean", F.avg("volume").over(last(n))).withColumn("_move", F.abs(F.col("close") - lag("close")))
    effort = ratio(F.col("volume"), F.col("_mean"))
    value = F.when(F.col("_move") == 0, F.least(2 * effort, F.lit(5.0))).otherwise(places(ratio(effort, ratio(F.col("_move"), F.col("_atr"))), 2))
    return out.withColumn("evsr", F.when((F.col("_atr") > 0) & (F.col("_mean") > 0), value).otherwise(0.0)).drop("_atr", "_mean", "_move")


def with_upvol(bars: DataFrame, n: int = 10) -> DataFrame:
    """upvol: volume of rising days over that of falling days."""
    prev = lag("close")
    out = bars.withColumn("_u", F.when(F.col("close") > prev, F.col("volume")).otherwise(0.0)).withColumn("_d", F.when(F.col("close") < prev, F.col("volume")).otherwise(0.0))
    up, down = F.sum("_u").over(last(n)), F.sum("_d").over(last(n))
    return out.withColumn("upvol", full(F.when(down != 0, places(ratio(up, down), 2)).otherwise(F.least(up, F.lit(5.0))), n + 1, 1.0)).drop("_u", "_d")


def with_mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    """mfi: money flow index; unchanged typical prices count as falling."""
    out = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumn("_up", F.when(lag("_tp").isNull(), None).otherwise(F.when(F.col("_tp") > lag("_tp"), F.col("_tp") * F.col("volume")).otherwise(0.0)))
    out = out.withColumn("_down", F.when(lag("_tp").isNull(), None).otherwise(F.when(F.col("_tp") > lag("_tp"), 0.0).otherwise(F.col("_tp") * F.col("volume"))))
    up, down = F.sum("_up").over(last(n)), F.sum("_down").over(last(n))
    value = F.when(down == 0, 100.0).otherwise(places(100 - ratio(F.lit(100.0), 1 + ratio(up, down)), 2))
    return out.withColumn("mfi", full(value, n + 1)).drop("_tp", "_up", "_down")


def with_stochastic(bars: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """stoch_k, stoch_d: smoothed twice; 50 in a flat range."""
    lo, hi = F.min("low").over(last(n)), F.max("high").over(last(n))
    out = bars.withColumn("_raw", F.when(hi == lo, 50.0).otherwise(ratio(F.col("close") - lo, hi - lo) * 100))
    out = out.withColumn("_k", F.avg("_raw").over(last(smooth))).withColumn("_d", F.avg("_k").over(last(smooth)))
    least = n + 2 * smooth
    return out.withColumn("stoch_k", full(places("_k", 2), least)).withColumn("stoch_d", full(places("_d", 2), least)).drop("_raw", "_k", "_d")


def with_obv(bars: DataFrame, back: int = 5) -> DataFrame:
    """obv, and obv_points: 10 for a falling price with rising volume balance, 5 both rising, 0 both falling, 2 else."""
    prev = lag("close")
    signed = F.when(F.col("close") > prev, F.col("volume")).when(F.col("close") < prev, -F.col("volume")).otherwise(0.0)
    out = bars.withColumn("_s", signed).withColumn("obv", F.sum("_s").over(by_day().rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    p, o = F.col("close") - lag("close", back), F.col("obv") - lag("obv", back)
    points = F.when(p.isNull(), 0).when((p < 0) & (o > 0), 10).when((p < 0) & (o < 0), 0).when((p > 0) & (o > 0), 5).otherwise(2)
    return out.withColumn("obv_points", points)


def with_contraction(bars: DataFrame) -> DataFrame:
    """vol_contraction: mean volume of 3 days over that of 20."""
    positive = F.greatest(F.col("volume"), F.lit(0.0))
    return bars.withColumn("_v", positive).withColumn("vol_contraction", full(ratio(F.sum("_v").over(last(3)) / 3, F.sum("_v").over(last(20)) / 20, 1.0), 20)).drop("_v")


def with_drawdown_atr(bars: DataFrame) -> DataFrame:
    """drawdown_atr: distance from the highest close of 20 bars in mean true ranges."""
    out = with_atr(bars, 14, "_atr")
    return out.withColumn("drawdown_atr", full(F.when(F.col("_atr") > 0, ratio(F.abs(F.col("close") - F.max("close").over(last(20))), places("_atr", 4))), 20)).drop("_atr")


def with_volume_surge(bars: DataFrame, n: int = 5, surge: float = 1.5) -> DataFrame:
    """avg_volume of the n bars before, volume_ratio, surge."""
    before = by_day().rowsBetween(-n, -1)
    out = bars.withColumn("avg_volume", F.floor(F.avg("volume").over(before)).cast("long")).withColumn("volume_ratio", places(ratio(F.col("volume"), F.col("avg_volume")), 2))
    return out.withColumn("surge", F.coalesce(F.col("volume_ratio") >= surge, F.lit(False)))


def with_forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 30, 60)) -> DataFrame:
    """return_{h}d: the return over the next h bars; null where they aren't there yet."""
    return bars.select("*", *(ratio(F.lead("close", h).over(by_day()) - F.col("close"), F.col("close")).alias(f"return_{h}d") for h in horizons))
