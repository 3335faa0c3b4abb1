"""Studies of scored bars with forward returns: buckets, tiers, rank correlations, cross tables, betas.

Each symbol is studied by itself. Statistics over a symbol (quantiles, medians, ranks) are aggregates or windows
per symbol; nothing is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.maths import correlation, ladder, places, ratio
from barloom.operators.rolling import by_day

HORIZONS = (5, 10, 20, 30, 60)
BUCKETS = ((0, 10), (11, 20), (21, 30), (31, 40), (41, 50), (51, 60), (61, 75), (76, 100))
LAYERS = ("A", "B")
#: Thresholds and labels of indicator tiers; a value belongs to the first threshold that it doesn't exceed.
TIERS = {
    "cmf_now": ((-0.15, "strong selling"), (-0.05, "selling"), (0.05, "neutral"), (0.15, "buying"), (None, "strong buying")),
    "evsr": ((1.0, "none"), (1.5, "weak"), (2.0, "medium"), (2.5, "strong"), (None, "strongest")),
    "upvol": ((0.75, "strong down"), (1.0, "down"), (1.5, "neutral"), (2.0, "up"), (None, "strong up")),
}


def labelled(scored: DataFrame, clip: float = 0.01, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Scored bars that have all forward returns; returns outside the clip quantiles of their symbol become null."""
    names = [f"return_{h}d" for h in horizons]
    whole = scored.na.drop(subset=names)
    bounds = whole.groupBy("symbol").agg(*(F.percentile(c, F.array(F.lit(clip), F.lit(1 - clip))).alias(f"_{c}") for c in names))
    met = whole.join(bounds, "symbol")
    for c in names:
        met = met.withColumn(c, F.when(F.col(c).between(F.col(f"_{c}")[0], F.col(f"_{c}")[1]), F.col(c))).drop(f"_{c}")
    return met


def long_returns(df: DataFrame, *columns: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """columns, horizon, r: one row per horizon."""
    pairs = ", ".join(f"{h}, return_{h}d" for h in horizons)
    return df.select(*columns, F.expr(f"stack({len(horizons)}, {pairs}) as (horizon, r)"))


def bucket_of(score: Column) -> Column:
    return ladder([(score.between(lo, hi), f"{lo}-{hi}") for lo, hi in BUCKETS], None)


def _statistics(least: int) -> list[Column]:
    """count, avg, winrate, ev of r, null where there are too few returns."""
    n, avg, wins = F.count("r"), F.avg("r"), F.avg((F.col("r") > 0).cast("double"))
    guard = lambda c: F.when(n >= least, places(c, 6))
    return [n.alias("count"), guard(avg).alias("avg"), guard(wins).alias("winrate"), guard(avg * wins).alias("ev")]


def bucket_analysis(df: DataFrame, least: int = 3) -> DataFrame:
    """symbol, bucket, horizon, bucket_count, count, avg, median, winrate, ev, std: every bucket of every symbol, rows or none."""
    rows = long_returns(df.withColumn("bucket", bucket_of(F.col("score"))), "symbol", "bucket")
    n = F.count("r")
    found = rows.groupBy("symbol", "bucket", "horizon").agg(F.count("*").alias("bucket_count"), *_statistics(least), F.when(n >= least, places(F.percentile("r", 0.5), 6)).alias("median"), F.when(n >= least, places(F.stddev_samp("r"), 6)).alias("std"))
    grid = df.select("symbol").distinct().withColumn("bucket", F.explode(F.array(*(F.lit(f"{lo}-{hi}") for lo, hi in BUCKETS)))).withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    return grid.join(found, ["symbol", "bucket", "horizon"], "left").na.fill(0, ["bucket_count", "count"])


def sweet_spots(buckets: DataFrame, horizon: int = 10) -> DataFrame:
    """symbol, bucket, avg, winrate, ev: the bucket with the highest expected value among those with 5 returns that win."""
    good = buckets.filter((F.col("horizon") == horizon) & (F.col("count") >= 5) & (F.col("winrate") >= 0.5) & (F.col("avg") > 0))
    place = F.split("bucket", "-")[0].cast("int")
    first = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ev"), place))
    return good.withColumn("_r", first).filter("_r = 1").select("symbol", "bucket", "avg", "winrate", "ev")


def rank_correlation(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """symbol, name, horizon, count, spearman, edge: columns against returns. Ties share their mean rank; edge is the mean
    return at or above the column's median less that below."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    wide = df.select("symbol", *(f"return_{h}d" for h in HORIZONS), F.expr(f"stack({len(columns)}, {pairs}) as (name, x)"))
    rows = long_returns(wide, "symbol", "name", "x").filter("x is not null and r is not null")
    group = ["symbol", "name", "horizon"]
    rank = lambda c: F.rank().over(Window.partitionBy(*group).orderBy(c)) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2
    medians = rows.groupBy(*group).agg(F.percentile("x", 0.5).alias("median"))
    ranked = rows.withColumn("rx", rank("x")).withColumn("ry", rank("r")).join(medians, group)
    n, high = F.count("*"), F.col("x") >= F.col("median")
    guard = lambda c: F.when(n >= least, places(c, 4))
    return ranked.groupBy(*group).agg(n.alias("count"), guard(correlation("rx", "ry")).alias("spearman"), guard(F.avg(F.when(high, F.col("r"))) - F.avg(F.when(~high, F.col("r")))).alias("edge"))


def layer_tiers(df: DataFrame, compat: bool = False, least: int = 3) -> DataFrame:
    """symbol, layer, tier, horizon, tier_count, count, avg, winrate, ev by terciles of each layer's points.

    compat: LOW is the rows at the minimum and HIGH those above the maximum, so none.
    """
    q = (0.0, 0.33, 0.67, 1.0)
    points = F.expr("stack(2, 'A', layer_A, 'B', layer_B) as (layer, x)")
    rows = df.select("symbol", *(f"return_{h}d" for h in HORIZONS), points)
    cuts = rows.groupBy("symbol", "layer").agg(F.percentile("x", F.array(*map(F.lit, q))).alias("q"))
    x, low, mid, top = F.col("x"), F.col("q")[1], F.col("q")[2], F.col("q")[3]
    if compat:
        # three masks that overlap: a row may be in LOW and MID, or in none
        tiers = F.array(F.when(x <= F.col("q")[0], F.lit("LOW")), F.when((x > low) & (x <= mid), F.lit("MID")), F.when(x > top, F.lit("HIGH")))
    else:
        tiers = F.array(F.when(x <= low, F.lit("LOW")).when(x <= mid, F.lit("MID")).otherwise(F.lit("HIGH")))
    tagged = rows.join(cuts, ["symbol", "layer"]).withColumn("tier", F.explode(tiers)).filter("tier is not null")
    return long_returns(tagged, "symbol", "layer", "tier").groupBy("symbol", "layer", "tier", "horizon").agg(F.count("*").alias("tier_count"), *_statistics(least))


def layer_combinations(df: DataFrame, least: int = 5) -> DataFrame:
    """symbol, a_high, b_high, count, avg_10d, wr_10d, ev_10d: rows by whether each layer is at its median or above; not those where neither is."""
    medians = df.groupBy("symbol").agg(*(F.percentile(f"layer_{x}", 0.5).alias(f"_{x}") for x in LAYERS))
    flagged = df.join(medians, "symbol").withColumn("a_high", (F.col("layer_A") >= F.col("_A")).cast("int")).withColumn("b_high", (F.col("layer_B") >= F.col("_B")).cast("int"))
    by = flagged.filter("a_high + b_high > 0").select("symbol", "a_high", "b_high", F.col("return_10d").alias("r")).groupBy("symbol", "a_high", "b_high").agg(*_statistics(least))
    return by.filter(F.col("count") >= least).select("symbol", "a_high", "b_high", "count", places("avg", 4).alias("avg_10d"), places("winrate", 4).alias("wr_10d"), places("ev", 4).alias("ev_10d"))


def best_combinations(combinations: DataFrame, n: int = 12) -> DataFrame:
    """The n combinations of all symbols with the highest positive expected value."""
    return combinations.filter("ev_10d > 0").orderBy(F.desc("ev_10d"), "symbol", "a_high", "b_high").limit(n)


def tier_of(value: Column, tiers: tuple) -> Column:
    return ladder([(value <= t, name) for t, name in tiers[:-1]], tiers[-1][1])


def indicator_tiers(df: DataFrame, least: int = 3) -> DataFrame:
    """symbol, indicator, tier, count, avg, winrate, ev of 10-day returns."""
    pairs = [F.struct(F.lit(c).alias("indicator"), tier_of(F.col(c), tiers).alias("tier")) for c, tiers in TIERS.items()]
    rows = df.select("symbol", F.col("return_10d").alias("r"), F.explode(F.array(*pairs)).alias("t")).select("symbol", "r", "t.*")
    return rows.groupBy("symbol", "indicator", "tier").agg(*_statistics(least))


def best_tiers(tiers: DataFrame, least: int = 5) -> DataFrame:
    """For each symbol and indicator, the tier with the highest expected value among those with enough returns."""
    first = F.row_number().over(Window.partitionBy("symbol", "indicator").orderBy(F.desc("ev"), "tier"))
    return tiers.filter(F.col("count") >= least).withColumn("_r", first).filter("_r = 1").drop("_r")


def cross_table(df: DataFrame, least: int = 3) -> DataFrame:
    """symbol, cmf_state, evsr_tier (null: the state's total), count, avg_10d, wr_10d, ev_10d (cells), avg_20d (totals)."""
    total = F.grouping("evsr_tier") == 1
    n, avg, wins = F.count("return_10d"), F.avg("return_10d"), F.avg((F.col("return_10d") > 0).cast("double"))
    enough = total | (n >= least)
    sets = df.groupingSets([["symbol", "cmf_state", "evsr_tier"], ["symbol", "cmf_state"]], "symbol", "cmf_state", "evsr_tier")
    return sets.agg(
        n.alias("count"),
        F.when(enough, places(avg, 4)).alias("avg_10d"),
        F.when(enough, places(wins, 4)).alias("wr_10d"),
        F.when(~total & (n >= least), places(avg * wins, 4)).alias("ev_10d"),
        F.when(total, places(F.avg("return_20d"), 4)).alias("avg_20d"),
    )


def score_distribution(df: DataFrame, high: int = 61) -> DataFrame:
    """symbol, n, mean, median, high_share."""
    return df.groupBy("symbol").agg(F.count("*").alias("n"), places(F.avg("score"), 6).alias("mean"), F.percentile("score", 0.5).alias("median"), places(F.avg((F.col("score") >= high).cast("double")), 6).alias("high_share"))


def return_histogram(df: DataFrame, bins: int = 40, high: int = 61, low: int = 40) -> DataFrame:
    """side (high or low score), bin (from 0), n: 10-day returns in equal bins over both sides' range; the last bin has its upper end."""
    sides = df.withColumn("side", F.when(F.col("score") >= high, "high").when(F.col("score") <= low, "low")).filter("side is not null and return_10d is not null").select("side", F.col("return_10d").alias("r"))
    ends = sides.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("r") - F.col("lo"), width)), F.lit(0))).cast("int")
    # a scalar of one row
    return sides.withColumn("lo", ends.select("lo").scalar()).withColumn("hi", ends.select("hi").scalar()).groupBy("side", place.alias("bin")).agg(F.count("*").alias("n"))


def beta_by_date(bars: DataFrame, market: str, least: int = 20) -> DataFrame:
    """symbol, n, beta: slope of daily returns on those that the market symbol has on the same days."""
    prev = F.lag("close").over(by_day())
    returns = bars.withColumn("r", ratio(F.col("close") - prev, prev)).filter("r is not null").select("symbol", "d", "r")
    base = returns.filter(F.col("symbol") == market).select("d", F.col("r").alias("m"))
    slope = F.try_divide(F.covar_pop("r", "m"), F.var_pop("m"))
    return returns.join(base, "d").groupBy("symbol").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, places(slope, 3)).alias("beta"))


def beta_by_position(bars: DataFrame, market: str, least: int = 30) -> DataFrame:
    """symbol, n, beta: as above, but returns are paired by their place from the start, up to the shorter series' length, and
    the first return of each is that from its last close to its first one."""
    by_place = Window.partitionBy("symbol").orderBy("d")
    whole = Window.partitionBy("symbol").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev = F.coalesce(F.lag("close").over(by_place), F.last("close").over(whole))
    returns = bars.withColumn("r", ratio(F.col("close") - prev, prev)).withColumn("i", F.row_number().over(by_place)).select("symbol", "i", "r")
    base = returns.filter(F.col("symbol") == market).select("i", F.col("r").alias("m"))
    slope = F.try_divide(F.covar_pop("r", "m"), F.var_pop("m"))
    return returns.join(base, "i").groupBy("symbol").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, places(slope, 3)).alias("beta"))


def tail_correlation(bars: DataFrame, other: DataFrame, n: int = 30) -> DataFrame:
    """symbol, corr, signal: the last n daily returns against those of another series (d, close), paired by place from the end."""
    def tail(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("d") if keys else Window.orderBy("d")
        r = df.withColumn("r", ratio(F.col("close") - F.lag("close").over(order), F.lag("close").over(order)))
        back = Window.partitionBy(*keys).orderBy(F.desc("d")) if keys else Window.orderBy(F.desc("d"))
        return r.withColumn("i", F.row_number().over(back)).filter(f"i <= {n} and r is not null").select(*keys, "i", "r")

    met = tail(bars.select("symbol", "d", "close"), "symbol").join(tail(other.select("d", "close")).withColumnRenamed("r", "m"), "i")
    out = met.groupBy("symbol").agg(F.when(F.count("*") == n, places(correlation("r", "m"), 3)).alias("corr"))
    return out.withColumn("signal", F.when(F.col("corr") >= 0.7, "high").when(F.col("corr") >= 0.4, "moderate").when(F.col("corr").isNotNull(), "low"))


def beta_divergence(changes: DataFrame, beta: DataFrame, market: str, peers: tuple[str, ...]) -> DataFrame:
    """symbol, expected, divergence, signal, peer_avg, peer_diff, peer_signal from changes (symbol, change_pct) and beta (symbol, beta)."""
    base = changes.agg(F.max(F.when(F.col("symbol") == market, F.col("change_pct"))).alias("m"), F.avg(F.when(F.col("symbol").isin(*peers), F.col("change_pct"))).alias("p"))
    rows = changes.join(beta, "symbol").withColumn("_m", base.select("m").scalar()).withColumn("_p", base.select("p").scalar())
    rows = rows.withColumn("expected", places(F.col("beta") * F.col("_m"), 2)).withColumn("divergence", places(F.col("change_pct") - F.col("expected"), 2))
    rows = rows.withColumn("peer_avg", places("_p", 2)).withColumn("peer_diff", places(F.col("change_pct") - F.col("peer_avg"), 2))
    of = lambda c, strong, some: F.when(F.col(c) >= strong, "much stronger").when(F.col(c) >= some, "stronger").when(F.col(c) <= -strong, "much weaker").when(F.col(c) <= -some, "weaker").otherwise("in line")
    return rows.select("symbol", "expected", "divergence", of("divergence", 3, 1).alias("signal"), "peer_avg", "peer_diff", of("peer_diff", 2, 0.5).alias("peer_signal"))
