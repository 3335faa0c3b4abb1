"""Indicators whose value depends on all bars before: smoothed averages and what is made of them.

A symbol's bars are one group, which the calendar bounds (some 250 rows a year), whatever the number of rows
that the bars were made of. Each group is one pass in a grouped map; a group's own work is linear.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.maths import places

from barloom.operators.rolling import by_day, lag, with_true_range

NAN = float("nan")


def rounded(x: np.ndarray, n: int) -> np.ndarray:
    """To n places by the exact values, as functions.maths.places."""
    return np.array([round(v, n) for v in np.asarray(x, float).ravel().tolist()]).reshape(np.shape(x))


def smoothed(x: np.ndarray, decay: float, gain: float, seed: float, start: int) -> np.ndarray:
    """y[start] = seed, then y[t] = decay * y[t - 1] + gain * x[t]; NaN before start."""
    out = np.full(len(x), NAN)
    if len(x) <= start:
        return out
    y = out[start] = seed
    for t, v in enumerate(x[start + 1 :].tolist(), start + 1):
        y = decay * y + gain * v
        out[t] = y
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean seeded with the mean of the first n values."""
    k = 2 / (n + 1)
    return smoothed(x, 1 - k, k, float(x[:n].mean()) if len(x) >= n else NAN, n - 1)


def ema_from_first(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean seeded with the first value."""
    k = 2 / (n + 1)
    return smoothed(x, 1 - k, k, float(x[0]) if len(x) else NAN, 0)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Relative strength by Wilder's smoothing, rounded to 2 places; 50 until there are n + 1 closes, 100 without losses."""
    d = np.diff(close)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    mean = lambda x: smoothed(x, (n - 1) / n, 1 / n, float(x[:n].mean()) if len(x) >= n else NAN, n - 1)
    gain, loss = mean(up), mean(down)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(loss == 0, 100.0, rounded(100 - 100 / (1 + gain / loss), 2))
    return np.concatenate([[50.0], np.where(np.isnan(gain), 50.0, value)])[: len(close)]


def macd(close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, signal and histogram, unrounded."""
    line = ema_from_first(close, 12) - ema_from_first(close, 26)
    signal = ema_from_first(line, 9)
    return line, signal, line - signal


def week_to_date(close: np.ndarray, week: np.ndarray) -> dict[str, np.ndarray]:
    """Of every bar: weeks so far, and RSI, MACD histogram and last week's histogram of the weekly closes as of that bar.

    The running week counts with the bar's own close. Closed weeks are folded once into states (the means of an RSI, three
    exponential means), one for each week, and every bar takes one tentative step from the state before its week.
    """
    last = np.flatnonzero(np.append(week[1:] != week[:-1], True)) if len(week) else np.zeros(0, int)
    closed, before = close[last], np.searchsorted(last, np.arange(len(close)))
    d, n = np.diff(closed, prepend=NAN), 14
    steps = []
    # a step's mean: of the first n moves, or of the mean before and the move
    for move, now in ((np.maximum(d, 0), lambda x: np.maximum(x, 0)), (np.maximum(-d, 0), lambda x: np.maximum(-x, 0))):
        state = np.concatenate([[NAN], smoothed(move, (n - 1) / n, 1 / n, float(move[1 : n + 1].mean()) if len(move) > n else NAN, n)])
        own = now(close - np.concatenate([[NAN], closed])[before])
        first = (move[1:n].sum() + own) / n if len(move) >= n else np.full(len(close), NAN)
        steps.append(np.where(before > n, state[before] * ((n - 1) / n) + own / n, np.where(before == n, first, NAN)))
    gain, loss = steps
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(np.isnan(gain), 50.0, np.where(loss == 0, 100.0, rounded(100 - 100 / (1 + gain / loss), 2)))
    fast, slow = ema_from_first(closed, 12), ema_from_first(closed, 26)
    line = fast - slow
    signal = ema_from_first(line, 9)

    def step(means: np.ndarray, own: np.ndarray, span: int) -> np.ndarray:
        k = 2 / (span + 1)
        return np.where(before == 0, own, (1 - k) * np.concatenate([[0.0], means])[before] + k * own)

    own_line = step(fast, close, 12) - step(slow, close, 26)
    hist = np.where(before < 34, NAN, rounded(own_line - step(signal, own_line, 9), 4))
    of_weeks = np.where(np.arange(len(closed)) < 34, NAN, rounded(line - signal, 4))
    return {"weeks": before + 1, "week_rsi": value, "week_hist": hist, "week_hist_before": np.concatenate([[NAN], of_weeks])[before]}


def misaligned_histogram(close: np.ndarray) -> np.ndarray:
    """The histogram of means that are subtracted by their place in their series, 14 bars apart; NaN until 35 closes."""
    slow = ema(close, 26)[25:]
    fast = ema(close, 12)[11:][: len(slow)]
    line = fast - slow
    out = np.full(len(close), NAN)
    out[25:] = line - ema(line, 9)
    out[:34] = NAN
    return out


def adx(tr: np.ndarray, high: np.ndarray, low: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend strength and the two directional indicators; 0 until there are 2 n + 1 bars."""
    up, down = np.diff(high), -np.diff(low)
    moves = (tr[1:], np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0))
    sums = [smoothed(x, 1 - 1 / n, 1.0, float(x[:n].sum()), n - 1) for x in moves]
    with np.errstate(divide="ignore", invalid="ignore"):
        plus, minus = (np.where(sums[0] == 0, 0.0, 100 * s / sums[0]) for s in sums[1:])
        dx = np.where(plus + minus == 0, 0.0, 100 * np.abs(plus - minus) / (plus + minus))
    counts = (sums[0] != 0) & ~np.isnan(sums[0])
    means = pd.Series(dx[counts]).rolling(n).mean()
    strength = pd.Series(NAN, index=range(len(tr)))
    strength.iloc[np.flatnonzero(counts) + 1] = means.to_numpy()
    early = (np.arange(len(tr)) < 2 * n) | strength.ffill().isna().to_numpy()
    told = lambda x: rounded(np.where(early, 0.0, x), 2)
    return told(strength.ffill().to_numpy()), told(np.append(NAN, plus)[: len(tr)]), told(np.append(NAN, minus)[: len(tr)])


def rsi_divergence(close: np.ndarray, back: int = 20, n: int = 14) -> np.ndarray:
    """Whether the later half of `back` closes has the lower low but the higher low of an RSI that starts anew n bars earlier."""
    out = np.zeros(len(close), bool)
    if len(close) < back + n:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(close, back + n)
    d = np.diff(windows, axis=1)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    gain, loss, values = up[:, :n].mean(1), down[:, :n].mean(1), []
    for t in range(n - 1, back + n - 1):
        if t >= n:
            gain, loss = (gain * (n - 1) + up[:, t]) / n, (loss * (n - 1) + down[:, t]) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            values.append(np.where(loss == 0, 100.0, rounded(100 - 100 / (1 + gain / loss), 2)))
    r, p, half = np.stack(values, 1), windows[:, n:], back // 2
    out[back + n - 1 :] = (p[:, half:].min(1) < p[:, :half].min(1)) & (r[:, half:].min(1) > r[:, :half].min(1))
    return out


def volume_node(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, n: int = 60, least: int = 20, bucket: float = 0.005) -> np.ndarray:
    """Where volume gathers among the last n bars, in percent of the close; of equal buckets the first met. NaN until there are `least` bars."""
    out = np.full(len(close), NAN)
    before = lambda x, fill: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, fill), x]), n)
    price, volumes = before((high + low + close) / 3, NAN), before(volume, 0.0)
    for lo in range(0, len(close), 256):
        part = slice(lo, lo + 256)
        with np.errstate(divide="ignore", invalid="ignore"):
            keys = np.rint((price[part] / close[part, None] - 1) / bucket)
        # each bar's bucket's volume, so that the first largest one is the first met
        sums = ((keys[:, :, None] == keys[:, None, :]) * volumes[part][:, None, :]).sum(2)
        best = np.take_along_axis(keys, np.where(np.isnan(price[part]), -1.0, sums).argmax(1)[:, None], 1)[:, 0]
        out[part] = rounded(best * bucket * 100, 2)
    return np.where((np.arange(len(close)) >= least - 1) & (close > 0), out, NAN)


def by_symbol(df: DataFrame, columns: list[str], time: str, outputs: dict[str, str], fn: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """symbol, time, columns and fn's outputs (name: type), fn given one symbol's rows in order; NaN becomes null."""
    names = ["symbol", time, *columns]
    kinds = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time, ignore_index=True)
        return group.assign(**fn(group))[[*names, *outputs]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), *(f"{c} {k}" for c, k in outputs.items())])
    out = df.select(*names).groupBy("symbol").applyInPandas(run, schema)
    return out.select(*names, *((F.when(~F.isnan(c), F.col(c)) if k == "double" else F.col(c)).alias(c) for c, k in outputs.items()))


def with_rsi(bars: DataFrame, time: str = "d") -> DataFrame:
    """symbol, time, close, rsi."""
    return by_symbol(bars, ["close"], time, {"rsi": "double"}, lambda g: {"rsi": rsi(g["close"].to_numpy())})


def with_emas(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """symbol, d, close, ema20, ema50, ema200, structure points, and whether the close has reclaimed the shortest mean."""
    out = by_symbol(bars, ["close"], "d", {f"ema{n}": "double" for n in spans}, lambda g: {f"ema{n}": ema(g["close"].to_numpy(), n) for n in spans})
    c, e20 = F.col("close"), F.col("ema20")
    out = out.withColumn("structure_points", structure_points())
    crossed = (F.lag("close").over(by_day()) < F.lag("ema20").over(by_day())) & (c >= e20)
    enough = F.count("ema20").over(by_day().rowsBetween(-5, 0)) == 6
    out = out.withColumn("_crossed", F.coalesce(crossed, F.lit(False)))
    just = F.max("_crossed").over(by_day().rowsBetween(-4, 0))
    return out.withColumn("above", enough & (c > e20)).withColumn("just_crossed", enough & just).withColumn("distance_pct", F.when(enough, places((c - e20) / e20 * 100, 2)).otherwise(0.0)).drop("_crossed")


def with_macd(bars: DataFrame, time: str = "d") -> DataFrame:
    """symbol, time, close, macd, signal, hist (null until 35 closes), macd_alert and convergence points."""
    by_time = Window.partitionBy("symbol").orderBy(time)

    def run(g: pd.DataFrame) -> dict:
        parts = macd(g["close"].to_numpy())
        early = np.arange(len(g)) < 34
        return {k: rounded(np.where(early, NAN, x), 4) for k, x in zip(("macd", "signal", "hist"), parts, strict=True)}

    out = by_symbol(bars, ["close"], time, {"macd": "double", "signal": "double", "hist": "double"}, run)
    before = lambda c: F.lag(c).over(by_time)
    alert = F.when((before("macd") < before("signal")) & (F.col("macd") > F.col("signal")), "bullish_cross").when((before("macd") > before("signal")) & (F.col("macd") < F.col("signal")), "bearish_cross")
    return out.withColumn("macd_alert", alert).withColumn("convergence_points", convergence_points(time))


def convergence_points(time: str) -> Column:
    """By how the histogram (hist) has moved over the bars before; histograms that aren't there yet count as 0."""
    h = [F.coalesce(F.lag("hist", k).over(Window.partitionBy("symbol").orderBy(time)), F.lit(0.0)) for k in (3, 2, 1)]
    rising = (h[1] > h[0]) & (h[2] > h[1])
    return F.when(F.col("hist").isNull(), 2).when(rising & (F.col("hist") < 0), 10).when(rising & (F.col("hist") > 0), 7).when(F.col("hist") > 0, 5).otherwise(2)


def structure_points() -> Column:
    """By the order of close, ema20, ema50 and ema200, as far as they are there."""
    c, e20, e50, e200 = (F.col(x) for x in ("close", "ema20", "ema50", "ema200"))
    whole = F.when((c < e20) & (e20 > e50) & (e50 > e200), 10).when((c < e50) & (e50 > e200), 7).when((c > e20) & (e20 > e50), 5).when(e20 < e50, 2).otherwise(4)
    return F.when(e200.isNotNull(), whole).when(e50.isNotNull(), F.when((c < e20) & (e20 > e50), 7).otherwise(3)).otherwise(3)


def with_scan_histogram(bars: DataFrame) -> DataFrame:
    """symbol, d, close, macd_hist and that of the bar before; 0 until 35 closes."""
    out = by_symbol(bars, ["close"], "d", {"macd_hist": "double"}, lambda g: {"macd_hist": rounded(misaligned_histogram(g["close"].to_numpy()), 6)})
    return out.withColumn("macd_hist_prev", F.coalesce(lag("macd_hist"), F.col("macd_hist"), F.lit(0.0))).withColumn("macd_hist", F.coalesce("macd_hist", F.lit(0.0)))


def with_adx(bars: DataFrame) -> DataFrame:
    """symbol, d, tr, high, low, adx, plus_di, minus_di."""

    def run(g: pd.DataFrame) -> dict:
        return dict(zip(("adx", "plus_di", "minus_di"), adx(g["tr"].to_numpy(float), g["high"].to_numpy(), g["low"].to_numpy()), strict=True))

    return by_symbol(with_true_range(bars), ["tr", "high", "low"], "d", {"adx": "double", "plus_di": "double", "minus_di": "double"}, run)


def with_divergence(bars: DataFrame) -> DataFrame:
    """symbol, d, close, divergence."""
    return by_symbol(bars, ["close"], "d", {"divergence": "boolean"}, lambda g: {"divergence": rsi_divergence(g["close"].to_numpy())})


def with_hvn(bars: DataFrame) -> DataFrame:
    """symbol, d, high, low, close, volume, hvn_pct."""
    return by_symbol(bars, ["high", "low", "close", "volume"], "d", {"hvn_pct": "double"}, lambda g: {"hvn_pct": volume_node(*(g[c].to_numpy(float) for c in ("high", "low", "close", "volume")))})
