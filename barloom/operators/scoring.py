"""Rule-based scores of bars, their history without lookahead, and what a scan of a universe reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.maths import at_least, clamp, grade, ladder, places, sector_grade
from barloom.operators import recursive, rolling
from barloom.operators.rolling import by_day

_A_STATES = {50: "held_positive", 30: "turning", 10: "turned", 5: "neutral"}


def with_layers(bars: DataFrame) -> DataFrame:
    """cmf_now, evsr, upvol and the points layer_A (money flow) and layer_B (absorption) of every bar, 0 in the first 29."""
    out = rolling.with_upvol(rolling.with_evsr(rolling.with_cmf_turning(bars)))
    positive, turning, now = F.col("positive"), F.col("turning"), F.col("cmf_now")
    a = F.when(positive & ~turning, 50).when(turning & ~positive, 30).when(positive & turning, 10).when(now > -0.05, 5).otherwise(0)
    b = at_least(F.col("evsr"), {2.5: 30, 2.0: 22, 1.5: 15, 1.0: 8}, 0)
    return out.withColumn("layer_A", a).withColumn("layer_B", b).withColumn("scored", rolling.full(F.lit(True), 30, False))


def with_score(layers: DataFrame) -> DataFrame:
    """raw, macro_mult, score, grade, cmf_state, evsr_tier from the layers and the macro columns btc_above and vix."""
    vix, above = F.col("vix"), F.col("btc_above")
    out = layers.withColumn("raw", F.col("layer_A") + F.col("layer_B")).withColumn("macro_mult", F.when(vix >= 25, 0.8).when(above, 1.2).otherwise(1.0))
    # halves go to the even neighbour
    out = out.withColumn("score", F.least(F.lit(100), F.rint(F.col("raw") * F.col("macro_mult") / 80 * 100).cast("int")))
    state = ladder([(F.col("layer_A") == k, v) for k, v in _A_STATES.items()], "sell_pressure")
    return out.withColumn("grade", grade(F.col("score"))).withColumn("cmf_state", state).withColumn("evsr_tier", at_least(F.col("evsr"), {2.5: ">=2.5", 2.0: ">=2.0", 1.5: ">=1.5", 1.0: ">=1.0"}, "<1.0"))


def market_scan(bars: DataFrame, macro_point: DataFrame) -> DataFrame:
    """The latest bar of every symbol with 30 bars or more, scored under the latest macro values (one row)."""
    newest = F.lead("d").over(by_day()).isNull()
    latest = with_layers(bars).withColumn("_newest", newest).filter("_newest and scored").drop("_newest", "scored")
    point = macro_point.select("btc_above", "vix")
    return with_score(latest.withColumn("btc_above", point.select("btc_above").scalar()).withColumn("vix", point.select("vix").scalar()))


def ranked(scan: DataFrame, n: int, best: bool = True) -> DataFrame:
    """The n best (or worst) of a scan; ties by symbol."""
    order = F.desc("score") if best else F.asc("score")
    return scan.orderBy(order, "symbol").limit(n)


def sector_rollup(scan: DataFrame) -> DataFrame:
    """sector, average (halves to even), count, grade, tickers."""
    by = scan.groupBy("sector").agg(F.rint(F.avg("score")).cast("int").alias("average"), F.count("*").alias("count"), F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("tickers"))
    return by.withColumn("grade", sector_grade(F.col("average")))


def layer_champions(scan: DataFrame) -> DataFrame:
    """For each layer the sector with the highest rounded mean points; ties by sector average, then name."""
    points = scan.select("sector", "score", F.explode(F.create_map(F.lit("A"), "layer_A", F.lit("B"), "layer_B")).alias("layer", "points"))
    means = points.groupBy("layer", "sector").agg(F.rint(F.avg("points")).cast("int").alias("points"), F.rint(F.avg("score")).alias("_average"))
    first = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("points"), F.desc("_average"), "sector"))
    return means.withColumn("_r", first).filter("_r = 1").select("layer", "sector", "points")


def rolling_scores(bars: DataFrame, macro: DataFrame, years: int = 2, warmup: int = 130) -> DataFrame:
    """Every bar after the warm-up, scored with what was known at its end; days without macro values count as neutral."""
    i = F.row_number().over(by_day()) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    kept = with_layers(rolling.with_forward_returns(bars)).withColumn("_i", i).withColumn("_n", n).filter((F.col("_i") >= warmup) & (F.col("_i") >= F.col("_n") - 252 * years))
    met = kept.drop("_i", "_n", "scored").join(macro.select("d", "btc_above", "vix"), "d", "left").withColumn("btc_above", F.coalesce("btc_above", F.lit(False))).withColumn("vix", F.coalesce("vix", F.lit(0.0)))
    return with_score(met)


def buy_amount(score: Column) -> Column:
    """The day's purchase by score."""
    return at_least(score, {80: 200.0, 60: 100.0, 40: 50.0}, 0.0)


_RECURSIVE = {"hvn_pct": "double", "hist": "double", "rsi": "double", "divergence": "boolean", "ema20": "double", "ema50": "double", "ema200": "double", "weeks": "long", "week_rsi": "double", "week_hist": "double", "week_hist_before": "double"}
_FLOW = ("obv_points", "mfi", "vol_contraction", "cmf_skip", "stoch_k", "stoch_d", "drawdown_atr", "_m")


def _recursive(g) -> dict:
    """All that depends on every bar before, of one symbol's bars in order."""
    close = g["close"].to_numpy(float)
    _, _, hist = recursive.macd(close)
    hist = np.where(np.arange(len(close)) < 34, np.nan, recursive.rounded(hist, 4))
    means = {f"ema{n}": recursive.ema(close, n) for n in (20, 50, 200)}
    node = recursive.volume_node(g["high"].to_numpy(float), g["low"].to_numpy(float), close, g["volume"].to_numpy(float))
    return {"hvn_pct": node, "hist": hist, "rsi": recursive.rsi(close), "divergence": recursive.rsi_divergence(close), **means, **recursive.week_to_date(close, g["week"].to_numpy())}


def technical_items(bars: DataFrame) -> DataFrame:
    """symbol, d, and the points of 14 items in five layers, for every bar from the 30th on.

    Weekly items take the closed weeks and the running one up to the bar, so a bar's score depends on no later one. Windows
    and one grouped map share the partitioning by symbol: bars are read and shuffled once.
    """
    flow = rolling.with_drawdown_atr(rolling.with_bands(rolling.with_stochastic(rolling.with_cmf(rolling.with_contraction(rolling.with_mfi(rolling.with_obv(bars)))))))
    flow = flow.withColumn("_ok", rolling.full(F.lit(True), 30, False)).withColumn("_m", F.avg("close").over(rolling.last(20)) - 2 * F.stddev_pop("close").over(rolling.last(20)))
    flow = flow.withColumn("week", F.datediff(F.date_trunc("week", "d").cast("date"), F.lit("1970-01-05")))
    rows = recursive.by_symbol(flow, ["high", "low", "close", "volume", "week", "_ok", *_FLOW], "d", _RECURSIVE, _recursive)
    rows = rows.withColumn("B1", recursive.convergence_points("d")).withColumn("B2", recursive.structure_points()).filter("_ok")
    mfi, ratio, cmf, hvn, rsi, k, d = (F.col(c) for c in ("mfi", "vol_contraction", "cmf_skip", "hvn_pct", "rsi", "stoch_k", "stoch_d"))
    below = (F.col("close") - F.col("_m")) / F.col("_m") * 100
    both_low, crossed = (k < 20) & (d < 20), k > d
    return rows.select(
        "symbol",
        "d",
        F.col("obv_points").alias("A1"),
        ladder([(mfi.isNull(), 0), (mfi < 20, 10), (mfi < 30, 7), (mfi < 40, 4), (mfi > 80, 0)], 1).alias("A2"),
        ladder([(ratio.isNull(), 0), (ratio < 0.70, 8), (ratio < 0.85, 5), (ratio < 1.0, 2)], 0).alias("A3"),
        ladder([(cmf.isNull(), 2), (cmf > 0.15, 7), (cmf > 0.05, 5), (cmf > -0.05, 2), (cmf > -0.15, 1)], 0).alias("A4"),
        "B1",
        "B2",
        ladder([(hvn.isNull(), 2), (hvn < -3, 5), (hvn < -1, 4), (hvn < 1, 2), (hvn < 4, 1)], 0).alias("B3"),
        ladder([(rsi <= 25, 8), (rsi <= 30, 7), (rsi <= 40, 5), (rsi <= 50, 2), (rsi >= 70, 0)], 1).alias("C1"),
        ladder([(k.isNull(), 1), (both_low & crossed, 7), (both_low, 4), ((k < 50) & crossed, 2), (k > 80, 0)], 1).alias("C2"),
        F.when(F.col("divergence"), 5).otherwise(0).alias("C3"),
        F.when(F.col("close") < F.col("_m"), 7).when((F.col("_m") <= 0) | (below < 3), 5).otherwise(2).alias("D1"),
        ladder([(F.col("drawdown_atr").isNull(), 2), (F.col("drawdown_atr") < 1.5, 5), (F.col("drawdown_atr") < 2.5, 2)], 0).alias("D2"),
        weekly_rsi_points("week_rsi", "weeks").alias("E1"),
        weekly_macd_points("week_hist", "week_hist_before").alias("E2"),
    )


def weekly_rsi_points(rsi: str = "rsi", weeks: str = "_n") -> Column:
    rsi = F.col(rsi)
    return ladder([(F.col(weeks) < 14, 1), (rsi < 30, 4), (rsi < 40, 3), (rsi < 50, 2), (rsi >= 70, 0)], 1)


def weekly_macd_points(hist: str = "hist", before: str = "_prev") -> Column:
    """A histogram that has just begun counts as unchanged."""
    hist = F.col(hist)
    return ladder([(hist.isNull(), 1), (hist > 0, 4), (hist > F.coalesce(before, hist), 3)], 0)


#: The items of each layer.
ITEMS = {"A": ("A1", "A2", "A3", "A4"), "B": ("B1", "B2", "B3"), "C": ("C1", "C2", "C3"), "D": ("D1", "D2"), "E": ("E1", "E2")}


def technical_total(items: DataFrame) -> DataFrame:
    """symbol, d, the layers' sums, total and grade."""
    sums = {k: sum((F.col(c) for c in names[1:]), F.col(names[0])) for k, names in ITEMS.items()}
    total = clamp(sum(list(sums.values())[1:], sums["A"]), 0, 100).cast("int")
    return items.select("symbol", "d", *(v.alias(f"layer_{k}") for k, v in sums.items()), total.alias("total")).withColumn("grade", grade(F.col("total")))


def safety_margin(bars: DataFrame, changes: DataFrame, beta: DataFrame, momentum: DataFrame, market: str, peers: tuple[str, ...]) -> DataFrame:
    """symbol, d, bands, beta_expected_pct, beta_excess_pct, momentum, diverges and attraction (1 to 10) of the latest bar of every symbol.

    changes: symbol, change_pct (one row for each symbol: the market's and the peers' are taken from it); beta: symbol, beta;
    momentum: symbol, momentum by the minute, stable where there is none. A fall that accelerates takes a point off, and
    another one if the symbol has lost more than 2 % while all peers gain.
    """
    newest = F.lead("d").over(by_day()).isNull()
    # one grouped map after the windows: bars are read once
    rows = recursive.by_symbol(rolling.with_bands(bars).withColumn("_newest", newest), ["close", "_newest", "sma", "bb_upper", "bb_lower", "bb_signal", "pct_from_lower"], "d", {"rsi": "double"}, lambda g: {"rsi": recursive.rsi(g["close"].to_numpy())})
    rows = rows.filter("_newest and sma is not null").join(beta.select("symbol", "beta"), "symbol", "left").join(momentum.select("symbol", "momentum"), "symbol", "left")
    of = lambda name: F.max(F.when(F.col("symbol") == name, F.col("change_pct")))
    all_gain = [F.coalesce(of(p), F.lit(0.0)) > 0 for p in peers]
    beside = changes.agg(F.coalesce(of(market), F.lit(0.0)).alias("_market"), *(g.alias(f"_p{k}") for k, g in enumerate(all_gain)))
    beside = beside.select("_market", F.forall(F.array(*(f"_p{k}" for k in range(len(peers)))), lambda g: g).alias("_peers_gain"))
    # one row of aggregates beside each symbol's row
    rows = rows.join(changes.select("symbol", F.col("change_pct").alias("_actual")), "symbol", "left").withColumn("_market", beside.select("_market").scalar()).withColumn("_peers_gain", beside.select("_peers_gain").scalar())
    rows = rows.withColumn("_actual", F.coalesce("_actual", F.lit(0.0)))
    actual, known = F.col("_actual"), (F.coalesce("beta", F.lit(0.0)) != 0) & (F.col("_actual") != 0)
    rows = rows.withColumn("beta_expected_pct", F.when(known, places(F.col("beta") * F.col("_market"), 2)).otherwise(0.0))
    rows = rows.withColumn("beta_excess_pct", F.when(known, places(actual - F.col("beta_expected_pct"), 2)).otherwise(0.0)).withColumn("momentum", F.coalesce("momentum", F.lit("stable")))
    rows = rows.withColumn("diverges", (F.col("momentum") == "accelerating") & (actual < -2) & F.col("_peers_gain"))
    rsi, excess = F.col("rsi"), F.col("beta_excess_pct")
    points = ladder([(rsi <= 25, 4), (rsi <= 30, 3), (rsi <= 40, 2), (rsi <= 50, 1)], 0)
    points += F.when(F.col("bb_signal") == "extreme_oversold", 3).when(F.col("bb_signal") == "oversold", 2).when(F.col("pct_from_lower") < 5, 1).otherwise(0)
    points += ladder([(excess <= -5, 3), (excess <= -3, 2), (excess <= -1, 1)], 0)
    points = F.greatest(points - (F.col("momentum") == "accelerating").cast("int"), F.lit(0))
    points = F.greatest(points - F.col("diverges").cast("int"), F.lit(0))
    return rows.select("symbol", "d", places("sma", 2).alias("sma20"), "bb_upper", "bb_lower", "bb_signal", "pct_from_lower", "beta_expected_pct", "beta_excess_pct", "momentum", "diverges", clamp(points, 1, 10).cast("int").alias("attraction"))
