"""Registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import text
from barloom.functions.maths import places
from barloom.operators import alerts, analysis, notes, profile, recursive, rolling, scoring, simulate
from barloom.plans.oracle import ORACLE_SQL, exactly_rounded
from barloom.plans.oracle_feeds import FEED_SQL
from barloom.plans.oracle_quotes import QUOTE_SQL
from barloom.sources import feeds, filings, quotes, state, summaries, tables
from barloom.sources.tables import daily_bars, macro_history, macro_point, table, ticks, weekly_bars

MARKET, PEERS = "NATION_0", ("NATION_1", "NATION_2")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query; its dates come out as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*(F.col(c).cast("string").alias(c) if k == "date" else F.col(c) for c, k in df.dtypes))

    QUERIES[f.__name__.removesuffix("_query")] = run
    return f


def _of_bars(name: str, fn: Callable[[DataFrame], DataFrame], *columns: str, n: int = 6) -> None:
    """Register a query: symbol, d and the columns that fn adds to daily bars, doubles to n places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(daily_bars(spark, sf_dir)).select("symbol", "d", *columns), n)

    run.__name__ = name
    query(run)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(places(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


_of_bars("day_change", rolling.with_change, "prev_close", "change_pct")
_of_bars("sma_bbands", rolling.with_bands, "sma", "bb_upper", "bb_lower", "pct_from_lower", "bb_signal")
_of_bars("bb_squeeze", rolling.with_squeeze, "squeeze", "bb_pos", "below_lower", "near_lower")
_of_bars("atr", rolling.with_atr, "atr")
_of_bars("cmf", rolling.with_cmf, "cmf", "cmf_skip")
_of_bars("cmf_turning", rolling.with_cmf_turning, "cmf_now", "cmf_prev", "turning", "positive")
_of_bars("evsr", rolling.with_evsr, "evsr")
_of_bars("upvol", rolling.with_upvol, "upvol")
_of_bars("mfi", rolling.with_mfi, "mfi")
_of_bars("stoch", rolling.with_stochastic, "stoch_k", "stoch_d")
_of_bars("obv", rolling.with_obv, "obv", "obv_points")
_of_bars("vol_contraction", rolling.with_contraction, "vol_contraction")
_of_bars("drawdown_atr", rolling.with_drawdown_atr, "drawdown_atr")
_of_bars("volume_surge", rolling.with_volume_surge, "avg_volume", "volume_ratio", "surge")
_of_bars("daily_hvn", recursive.with_hvn, "hvn_pct")
_of_bars("forward_returns", rolling.with_forward_returns, *(f"return_{h}d" for h in analysis.HORIZONS))
_of_bars("rsi", recursive.with_rsi, "rsi")
_of_bars("ema_stack", recursive.with_emas, "ema20", "ema50", "ema200", "structure_points", n=3)
_of_bars("ema_reclaim", recursive.with_emas, "above", "just_crossed", "distance_pct")
_of_bars("macd", recursive.with_macd, "macd", "signal", "hist")
_of_bars("macd_signals", recursive.with_macd, "macd_alert", "convergence_points")
_of_bars("macd_hist_scan", recursive.with_scan_histogram, "macd_hist", "macd_hist_prev")
_of_bars("adx", recursive.with_adx, "adx", "plus_di", "minus_di")
_of_bars("rsi_divergence", recursive.with_divergence, "divergence")


@query
def daily_bars_query(spark, sf_dir):
    return rounded(daily_bars(spark, sf_dir))


@query
def weekly_bars_query(spark, sf_dir):
    return rounded(weekly_bars(daily_bars(spark, sf_dir)))


@query
def macro(spark, sf_dir):
    return rounded(macro_history(spark, sf_dir))


@query
def macro_now(spark, sf_dir):
    return macro_point(macro_history(spark, sf_dir))


@query
def weekly_rsi_macd(spark, sf_dir):
    weeks = weekly_bars(daily_bars(spark, sf_dir))
    by_week = Window.partitionBy("symbol").orderBy("week")
    r = recursive.with_rsi(weeks, "week").withColumn("_n", F.row_number().over(by_week))
    m = recursive.with_macd(weeks, "week").withColumn("_prev", F.lag("hist").over(by_week)).select("symbol", "week", "hist", "_prev")
    return r.join(m, ["symbol", "week"]).select("symbol", "week", "rsi", "hist", scoring.weekly_rsi_points().alias("rsi_points"), scoring.weekly_macd_points().alias("macd_points"))


def _scan(spark, sf_dir):
    return scoring.market_scan(daily_bars(spark, sf_dir), macro_point(macro_history(spark, sf_dir)))


_SCAN = ("symbol", "sector", "d", "close", "cmf_now", "evsr", "upvol", "layer_A", "layer_B", "raw", "macro_mult", "score", "grade", "cmf_state", "evsr_tier")


@query
def market_scan(spark, sf_dir):
    return rounded(_scan(spark, sf_dir).select(*_SCAN))


@query
def scan_top15(spark, sf_dir):
    return scoring.ranked(_scan(spark, sf_dir), 15).select("symbol", "sector", "score", "grade")


@query
def scan_bottom10(spark, sf_dir):
    return scoring.ranked(_scan(spark, sf_dir), 10, best=False).select("symbol", "sector", "score", "grade")


@query
def sector_rollup(spark, sf_dir):
    return scoring.sector_rollup(_scan(spark, sf_dir))


@query
def layer_champion(spark, sf_dir):
    return scoring.layer_champions(_scan(spark, sf_dir))


def _scored(spark, sf_dir):
    return scoring.rolling_scores(daily_bars(spark, sf_dir), macro_history(spark, sf_dir))


def _labelled(spark, sf_dir):
    return analysis.labelled(_scored(spark, sf_dir))


@query
def rolling_scores(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select(*_SCAN, scoring.buy_amount(F.col("score")).alias("buy_target")))


@query
def score_distribution(spark, sf_dir):
    return analysis.score_distribution(_scored(spark, sf_dir))


@query
def forward_returns_clipped(spark, sf_dir):
    return rounded(_labelled(spark, sf_dir).select("symbol", "d", "score", *(f"return_{h}d" for h in analysis.HORIZONS)))


@query
def bucket_analysis(spark, sf_dir):
    return analysis.bucket_analysis(_labelled(spark, sf_dir))


@query
def sweet_spot(spark, sf_dir):
    return analysis.sweet_spots(analysis.bucket_analysis(_labelled(spark, sf_dir)))


@query
def layer_spearman(spark, sf_dir):
    return analysis.rank_correlation(_labelled(spark, sf_dir), ["layer_A", "layer_B"])


@query
def indicator_spearman(spark, sf_dir):
    return analysis.rank_correlation(_labelled(spark, sf_dir), ["cmf_now", "evsr", "upvol"])


@query
def layer_tiers(spark, sf_dir):
    return analysis.layer_tiers(_labelled(spark, sf_dir))


@query
def layer_tiers_compat(spark, sf_dir):
    return analysis.layer_tiers(_labelled(spark, sf_dir), compat=True)


@query
def layer_combos(spark, sf_dir):
    return analysis.layer_combinations(_labelled(spark, sf_dir))


@query
def best_combos(spark, sf_dir):
    return analysis.best_combinations(analysis.layer_combinations(_labelled(spark, sf_dir)))


@query
def indicator_tiers(spark, sf_dir):
    return analysis.indicator_tiers(_labelled(spark, sf_dir))


@query
def best_indicator_tiers(spark, sf_dir):
    return analysis.best_tiers(analysis.indicator_tiers(_labelled(spark, sf_dir)))


@query
def cmf_evsr_cross(spark, sf_dir):
    return analysis.cross_table(_labelled(spark, sf_dir))


@query
def return_histogram(spark, sf_dir):
    return analysis.return_histogram(_labelled(spark, sf_dir))


@query
def dca_dynamic(spark, sf_dir):
    return rounded(simulate.dynamic_plan(_scored(spark, sf_dir)), 3)


@query
def dca_baseline(spark, sf_dir):
    return rounded(simulate.baseline_plan(_scored(spark, sf_dir)), 3)


@query
def dca_summary(spark, sf_dir):
    return simulate.summary(simulate.dynamic_plan(_scored(spark, sf_dir)))


@query
def dca_compared(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return simulate.compared(simulate.summary(simulate.dynamic_plan(scored)), simulate.summary(simulate.baseline_plan(scored)))


@query
def beta_by_date(spark, sf_dir):
    return analysis.beta_by_date(daily_bars(spark, sf_dir), MARKET)


@query
def beta_compat(spark, sf_dir):
    return analysis.beta_by_position(daily_bars(spark, sf_dir), MARKET)


@query
def btc_corr(spark, sf_dir):
    return analysis.tail_correlation(daily_bars(spark, sf_dir), macro_history(spark, sf_dir).select("d", F.col("btc_close").alias("close")))


def _last_changes(bars):
    return rolling.with_change(bars).withColumn("_last", F.lead("d").over(rolling.by_day()).isNull()).filter("_last").select("symbol", places("change_pct", 2).alias("change_pct"))


@query
def beta_divergence(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return analysis.beta_divergence(_last_changes(bars), analysis.beta_by_date(bars, MARKET).select("symbol", "beta"), MARKET, PEERS)


@query
def technical_score_items(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return scoring.technical_items(bars)


@query
def technical_score_total(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return scoring.technical_total(scoring.technical_items(bars))


@query
def safety_margin(spark, sf_dir):
    """Minutes of a symbol are its lines, each at a minute of its shipping day that follows from its order."""
    bars = daily_bars(spark, sf_dir)
    minutes = profile.momentum(tables.line_ticks(spark, sf_dir), tolerance=1800)
    return scoring.safety_margin(bars, _last_changes(bars), analysis.beta_by_date(bars, MARKET).select("symbol", "beta"), minutes, MARKET, PEERS)


@query
def volume_profile(spark, sf_dir):
    return profile.volume_profile(ticks(spark, sf_dir), minutes=24 * 60)


@query
def same_time_volume(spark, sf_dir):
    return profile.same_time_volume(ticks(spark, sf_dir), minutes=180)


@query
def nearest_price(spark, sf_dir):
    return profile.momentum(ticks(spark, sf_dir), tolerance=1800)


@query
def hourly_bars(spark, sf_dir):
    return rounded(profile.bars_from_ticks(ticks(spark, sf_dir)))


@query
def price_snapshot(spark, sf_dir):
    return profile.price_snapshot(ticks(spark, sf_dir))


@query
def market_session(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("symbol", text.market_session(F.col("ts")).alias("session")).agg(F.count("*").alias("n"))


@query
def alert_hysteresis(spark, sf_dir):
    return alerts.price_alerts(_tick_changes(ticks(spark, sf_dir)))


def _tick_changes(t: DataFrame) -> DataFrame:
    """Each tick's change from its symbol's last close of the day before."""
    days = t.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("close", F.struct("ts", "close")).alias("last"))
    prev = days.select("symbol", "day", F.lag("last").over(Window.partitionBy("symbol").orderBy("day")).alias("prev")).filter("prev > 0")
    return t.withColumn("day", F.to_date("ts")).join(prev, ["symbol", "day"]).select("symbol", "ts", places((F.col("close") - F.col("prev")) / F.col("prev") * 100, 2).alias("change_pct"))


@query
def alert_deferred(spark, sf_dir):
    return alerts.deferred_alerts(rolling.with_change(daily_bars(spark, sf_dir)))


@query
def weekly_accumulators(spark, sf_dir):
    readings = ticks(spark, sf_dir).select("ts", F.col("symbol").alias("name"), F.col("close").alias("value"))
    return alerts.weekly_readings(readings, {"click": 8})


@query
def ledger_state(spark, sf_dir):
    """Positions after two states: what was bought before 1998, then that read back and the rest added to it."""
    bars = daily_bars(spark, sf_dir).select("symbol", "d", F.col("volume").alias("shares"), (F.col("volume") * F.col("close")).alias("paid"))
    kept = state.StateTable(spark, state.new_folder(spark))
    total = lambda df: df.groupBy("symbol").agg(F.sum("shares").alias("shares"), F.sum("paid").alias("paid"), F.sum("days").alias("days"))
    # the first state has no days yet: a column that came later
    kept.write(total(bars.filter("d < '1998-01-01'").withColumn("days", F.lit(0))).drop("days"))
    before = kept.read({"symbol": ("string", ""), "shares": ("double", 0.0), "paid": ("double", 0.0), "days": ("long", 0)})
    kept.write(total(before.unionByName(bars.filter("d >= '1998-01-01'").withColumn("days", F.lit(1).cast("long")).drop("d"))))
    now = kept.read({"symbol": ("string", ""), "shares": ("double", 0.0), "paid": ("double", 0.0), "days": ("long", 0), "note": ("string", "none")})
    return now.select("symbol", "shares", places(F.try_divide("paid", "shares"), 4).alias("avg_price"), "days", "note")


@query
def day_totals_once(spark, sf_dir):
    """Each day's volume and symbols, computed for the days that aren't stored: those of 1995 first, then the others."""
    bars = daily_bars(spark, sf_dir)
    kept = state.StateTable(spark, state.new_folder(spark))
    compute = lambda days: bars.join(days, "d").groupBy("d").agg(F.sum("volume").alias("volume"), F.count("*").alias("symbols"))
    kept.once(bars.select("d").filter("year(d) = 1995"), compute)
    return kept.once(bars.select("d"), compute)


@query
def pcr(spark, sf_dir):
    """Put to call ratio by day: purchases stand for puts, clicks for calls."""
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("put"), F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("call"))
    ratio = F.try_divide("put", "call")
    return rows.select("day", places(ratio, 4).alias("pcr"), F.when(ratio > 1.2, "heavy_hedging").when(ratio < 0.5, "bullish").when(ratio.isNotNull(), "neutral").alias("signal"))


@query
def short_pct(spark, sf_dir):
    """Returned lines stand for short sales."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).cast("long").alias("short_volume"), F.sum("l_quantity").cast("long").alias("total_volume"))
    return feeds.with_short_share(rows)


def _trades(spark, sf_dir):
    """Orders as trades: the status is the code, and orders of 100,000 or more dispose."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("d"))
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    kind = text.trade_type(F.col("o_orderstatus"), F.when(F.col("o_totalprice") >= 100_000, "D").otherwise("A"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("filer"), kind.alias("trade_type"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("shares"), F.col("o_totalprice").alias("total_value"), "d").filter("trade_type is not null")


@query
def insider_classify(spark, sf_dir):
    rows = _trades(spark, sf_dir).withColumn("size", text.size_band(F.col("total_value"), F.col("shares")))
    return rows.groupBy("trade_type", "size").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"), places(F.sum("total_value"), 2).alias("total_value"))


@query
def insider_new(spark, sf_dir):
    """Trades since 2000 of filers and kinds that weren't seen before."""
    rows = _trades(spark, sf_dir).withColumn("hash", text.title_hash(F.concat("filer", F.lit("|"), "trade_type")))
    return alerts.new_by_hash(rows.filter("d >= '2000-01-01'"), rows.filter("d < '2000-01-01'").select("hash")).select("hash", "id", "filer", "trade_type", "d")


@query
def news_dedup(spark, sf_dir):
    """Texts once each, in their first row, of languages other than German where a German text has the same hash."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", text.title_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    return alerts.new_by_hash(docs.filter("lang <> 'de'"), docs.filter("lang = 'de'")).select("hash", "id", "lang")


@query
def html_excerpt(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.is_blocked(F.col("url"), ["example.net"]).alias("blocked"), F.when(~text.is_blocked(F.col("url"), ["example.net"]), text.html_excerpt(F.col("html"))).alias("excerpt"))


@query
def app_rank_trend(spark, sf_dir):
    """Symbols by monthly volume, with changes of rank from the month before."""
    months = daily_bars(spark, sf_dir).groupBy("symbol", (F.year("d") * 12 + F.month("d")).alias("period")).agg(F.sum("volume").alias("v"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("v"), "symbol"))
    return alerts.rank_trend(months.select("symbol", "period", rank.alias("rank")))


@query
def weighted_cost(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return simulate.ledger(bars.select("symbol", F.col("volume").alias("shares"), F.col("close").alias("price")))


@query
def event_props(spark, sf_dir):
    """JSON properties: events and their mean value by key."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return rows.groupBy("event_type", (F.col("k") % 10).alias("k_class")).agg(F.count("*").alias("n"), places(F.avg("value"), 6).alias("mean_value"))


@query
def conversation_tails(spark, sf_dir):
    """The last five turns of each conversation, with the first turn's role beside them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "n_chars")
    first = turns.groupBy("conv_id").agg(F.min_by("role", F.struct("turn", "role")).alias("first_role"))
    return turns.withColumn("back", F.row_number().over(back)).filter("back <= 5").join(first, "conv_id").select("conv_id", "turn", "role", "n_chars", "back", "first_role")


@query
def sector_universe(spark, sf_dir):
    """Symbols per sector, and how many have bars; those without are in sector Unknown's list of one row each."""
    bars = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"))
    return tables.universe(spark, sf_dir).join(bars, "symbol", "left").select("symbol", F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.coalesce("bars", F.lit(0)).alias("bars"))


@query
def option_chain_pcr(spark, sf_dir):
    """Each day's put to call ratio from the option chains of two publishers, made of the day's events.

    Purchases are puts and clicks calls, in ten classes. The first publisher has even days, with a broken document every
    seventh day; the second has all days, with twice the puts.
    """
    events = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'click')")
    kind = F.when(F.col("event_type") == "purchase", "P").otherwise("C")
    sums = events.groupBy(F.to_date("ts").alias("day"), (F.col("event_id") % 10).alias("class"), kind.alias("kind")).agg(F.coalesce(F.sum(F.floor(F.col("value") * 100)), F.lit(0)).cast("bigint").alias("n"))
    # a day has no more than 20 sums
    of = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("n").alias("openInterest"))))
    chain = F.struct(F.struct(F.array(F.struct(F.array(F.struct(of("P").alias("puts"), of("C").alias("calls"))).alias("options"))).alias("result")).alias("optionChain"))
    quote = F.struct(F.struct(F.collect_list(F.struct(F.col("kind").alias("option_type"), F.when(F.col("kind") == "P", 2 * F.col("n")).otherwise(F.col("n")).alias("open_interest"))).alias("options")).alias("data"))
    days = sums.groupBy("day").agg(F.to_json(chain).alias("chain"), F.to_json(quote).alias("quote")).withColumn("number", F.datediff("day", F.lit("1970-01-01")))
    first = days.filter("number % 2 = 0").select("day", F.lit(1).alias("source"), F.when(F.col("number") % 7 == 0, F.lit("<html>busy</html>")).otherwise(F.col("chain")).alias("body"))
    return filings.put_call_ratio(first.union(days.select("day", F.lit(2), "quote")), "day")


@query
def app_ranks(spark, sf_dir):
    """Places of small parts among the 200 dearest parts, and among the 200 dearest ones of one brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")

    def listed(name: str, parts: DataFrame) -> DataFrame:
        top = parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(200)
        ids = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("p_retailprice")).alias("a"), "p_partkey"))), lambda x: F.struct(x["p_partkey"].cast("string").alias("id")))
        return top.agg(F.to_json(F.struct(F.struct(ids.alias("results")).alias("feed"))).alias("body")).select(F.lit(name).alias("list"), "body")

    lists = listed("overall", part).union(listed("brand", part.filter("p_brand = 'Brand#1'")))
    return filings.places_in_lists(lists, part.filter("p_size <= 5").select(F.col("p_partkey").cast("string").alias("id")))


@query
def filing_links(spark, sf_dir):
    """Forms' addresses by way of Atom feeds of 20 pages each and the pages that they link to."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    n = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://forms.example.com/Archives/edgar/data/"), n, F.lit("/i"), n, F.lit("-index.htm"))
    tags = [F.concat(F.lit("<filing-href>"), url, F.lit("</filing-href>")), F.concat(F.lit('<content type="text/xml" href="'), url, F.lit('"/>')), F.concat(F.lit('<content type="text/xml">none</content><link rel="alternate" href="http://example.org/"/><link href="'), url, F.lit('"/>')), F.concat(F.lit("<id>"), url, F.lit("</id>"))]
    tag = F.lit("<id>urn:none</id>")
    for k, t in enumerate(tags):
        tag = F.when(F.col("page_id") % 5 == k, t).otherwise(tag)
    entry = F.concat(F.lit("<entry><title>4</title><updated>"), F.date_add(F.lit("2020-01-01"), (F.col("page_id") % 1000).cast("int")).cast("string"), F.lit("T10:00:00-04:00</updated>"), tag, F.lit("</entry>"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "\n")
    feeds_of = pages.groupBy(F.floor(F.col("page_id") / 20).alias("feed")).agg(F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">'), parts, F.lit("</feed>")).alias("xml"))
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://other.example.com/a"), n, F.lit(".xml"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/Archives/x/b"), n, F.lit(".xml"))).otherwise(F.concat(F.lit("sub/c"), n, F.lit(".xml")))
    index = pages.select(url.alias("href"), F.concat("html", F.lit('<a href="xslF345X05/form.xml">x</a><a href=\'R2.xml\'>r</a><a href="Financial_Report.xml">f</a><a href="'), link, F.lit('">form</a><a href="later.xml">l</a>')).alias("page"))
    met = filings.atom_entries(feeds_of).join(index, "href")
    return met.select("feed", "position", "href", "date", filings.form_link(F.col("page"), F.col("href")).alias("form"))


@query
def filing_positions(spark, sf_dir):
    """Positions in one issuer by way of search results, filings' listings and their tables, made of customers."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.floor(F.abs("c_acctbal")).cast("long").alias("value"))
    k = F.col("c_custkey")
    digits = F.lpad(k.cast("string"), 10, "0")
    accession = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("0001-24-"), digits))
    source = F.struct(
        F.when(k % 3 == 1, F.array("c_name", F.lit("CIK"))).otherwise(F.array().cast("array<string>")).alias("display_names"), F.when(k % 3 == 2, F.concat("c_name", F.lit(" Inc"))).alias("entity_name"),
        F.date_sub(F.lit("2024-06-01"), (k % 150).cast("int")).cast("string").alias("file_date"), accession.alias("accession_no"), F.when(k % 13 == 0, F.lit("")).otherwise(digits).alias("entity_id"),
    )
    hits = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", source.alias("_source")))), lambda x: F.struct(x["_source"].alias("_source")))
    results = rows.groupBy(F.floor(k / 15).alias("page")).agg(F.to_json(F.struct(F.struct(hits.alias("hits")).alias("hits"))).alias("body"))
    names = F.when(k % 4 == 0, F.array(F.lit("primary_doc.xml"), F.lit("Form13F_InfoTable.xml"))).when(k % 4 == 1, F.array(F.lit("xslForm/a.xml"), F.lit("infotable.html"), F.lit("form13f.xml"))).when(k % 4 == 2, F.array(F.lit("readme.txt"))).otherwise(F.array(F.lit("a-infotable.xml")))
    listing = F.to_json(F.struct(F.struct(F.transform(names, lambda x: F.struct(x.alias("name"))).alias("item")).alias("directory")))
    row = lambda issuer, value, shares, kind="": F.concat(F.lit(f"<ns1:infoTable><ns1:nameOfIssuer>{issuer}</ns1:nameOfIssuer><ns1:value>"), value.cast("string"), F.lit("</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>"), shares.cast("string"), F.lit(f"</ns1:sshPrnamt></ns1:shrsOrPrnAmt>{kind}</ns1:infoTable>"))
    xml = F.concat(F.lit('<ns1:informationTable xmlns:ns1="http://www.example.com/ns">'), row("OTHER CO", F.lit(5), F.lit(6)), row("Wanted Corp", F.lit(7), F.lit(8), "<ns1:putCall>Put</ns1:putCall>"), row("Wanted Corp Class A", F.col("value"), k * 7), F.lit("</ns1:informationTable>"))
    published = rows.select(k.cast("string").alias("cik"), F.replace(accession, F.lit("-"), F.lit("")).alias("accession"), listing.alias("listing"), xml.alias("xml"))
    found = filings.search_hits(results, dt.date(2024, 6, 1)).join(published, ["cik", "accession"], "left").withColumn("file", filings.table_file(F.col("listing")))
    url = F.concat_ws("/", "cik", "accession", "file")
    held = feeds.infotable_position(found.filter("file is not null").select("xml", url.alias("url")), "wanted")
    met = found.withColumn("url", url).join(held, "url", "left")
    return met.select("institution", "filing_date", "cik", "accession", "file", F.coalesce("shares", F.lit(0)).cast("long").alias("shares"), F.coalesce("value_usd", F.lit(0.0)).alias("value_usd"))


@query
def news_items(spark, sf_dir):
    """The first 15 items of news feeds of 20 documents each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    n = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title>Item "), n, F.lit(" in "), "lang", F.lit("</title><pubDate>day "), n, F.lit("</pubDate><link>https://news.example.com/"), n, F.lit("</link></item>"))
    items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("i")))), lambda x: x["i"]), "")
    return feeds.rss_items(docs.groupBy(F.floor(F.col("doc_id") / 20)).agg(F.concat(F.lit('<rss version="2.0"><channel><title>all</title>'), items, F.lit("</channel></rss>")).alias("xml")).select("xml"))


@query
def insider_forms(spark, sf_dir):
    """Trades in ownership forms, one form for each order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 10).cast("long").alias("shares"), F.col("o_orderdate").cast("date").cast("string").alias("date"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, "PSAGMF")), (k % 6 + 1).cast("int"))
    role = F.element_at(F.array(*map(F.lit, ("<officerTitle>Chief</officerTitle>", "<isDirector>1</isDirector>", "<isTenPercentOwner>true</isTenPercentOwner>", "<isOfficer>0</isOfficer>"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    deal = lambda tag, code, shares, price, way: F.concat(F.lit(f"<{tag}><transactionCoding><transactionCode>"), code, F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"), shares.cast("string"), F.lit("</value></transactionShares><transactionPricePerShare><value>"), price.cast("string"), F.lit("</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>"), way, F.lit(f"</value></transactionAcquiredDisposedCode></transactionAmounts></{tag}>"))
    plain = deal("nonDerivativeTransaction", code, F.col("shares"), k % 100 + 0.25, F.when(k % 4 == 0, "D").otherwise("A"))
    other = F.when(k % 3 == 0, F.concat(F.lit("<derivativeTable>"), deal("derivativeTransaction", F.lit("M"), F.lit("12.0"), F.lit("0.5"), F.when(k % 2 == 0, "D").otherwise("A")), F.lit("</derivativeTable>"))).otherwise("")
    xml = F.concat(F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>"), "c_name", F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>"), role, F.lit("</reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"), plain, F.lit("</nonDerivativeTable>"), other, F.lit("</ownershipDocument>"))
    return feeds.form4_trades(rows.select("date", k.cast("string").alias("url"), xml.alias("xml")))


def _chart(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, body: charts made of rows (keys, ts, prices and volumes as they are named in charts), a document for each key."""
    names = [c for c in rows.columns if c in quotes.PRICES]
    every = F.sort_array(F.collect_list(F.struct(F.unix_seconds("ts").alias("at"), *names)))
    lists = rows.groupBy(*keys).agg(every.alias("x"))
    told = F.struct(F.col("x.at").alias("timestamp"), F.struct(F.array(F.struct(*(F.col(f"x.{c}").alias(c) for c in names))).alias("quote")).alias("indicators"))
    return lists.select(*keys, F.to_json(F.struct(F.struct(F.array(told).alias("result")).alias("chart"))).alias("body"))


def _quotes(spark, sf_dir):
    """Daily bars, minutes and moments with the keys symbol and day, read from charts made of events.

    Each day is seen at an hour that follows from its number, from a chart of the ten days up to it and one of its minutes
    so far, behind one of the day before. Every seventh day and fifth minute has no close, every eleventh day no volume.
    """
    t = ticks(spark, sf_dir).withColumn("day", F.to_date("ts"))
    number = F.datediff("day", F.lit("1970-01-01"))
    last = F.max_by("close", F.struct("ts", "close"))
    days = t.groupBy("symbol", "day").agg(last.alias("close"), F.sum("volume").alias("volume"))
    days = days.select("symbol", "day", F.when(number % 7 != 3, F.col("close")).alias("close"), F.when(number % 11 != 5, F.col("volume")).alias("volume"))
    # a bar is told in the charts of its own day and the nine after it that the symbol has
    ahead = Window.partitionBy("symbol").orderBy("day").rowsBetween(0, 9)
    told = days.withColumn("seen", F.collect_list("day").over(ahead)).select("symbol", F.explode("seen").alias("day"), F.col("day").cast("timestamp").alias("ts"), "close", "volume")
    moments = days.select("symbol", "day", (F.col("day").cast("timestamp") + F.make_dt_interval(hours=number * 5 % 24, mins=F.lit(30))).alias("now"))
    minutes = t.groupBy("symbol", "day", F.date_trunc("minute", "ts").alias("ts")).agg(last.alias("close"), F.sum("volume").alias("volume"))
    minutes = minutes.withColumn("close", F.when(F.minute("ts") % 5 != 0, F.col("close"))).join(moments, ["symbol", "day"]).filter("ts <= now").drop("now")
    before = moments.select("symbol", "day", (F.col("day").cast("timestamp") - F.expr("interval 1 hour")).alias("ts"), F.lit(1.0).alias("close"), F.lit(99).cast("long").alias("volume"))
    read = lambda rows: quotes.chart_bars(_chart(rows, "symbol", "day"), "symbol", "day")
    return read(told), read(minutes.unionByName(before)), moments


@query
def quote_snapshot(spark, sf_dir):
    return quotes.snapshot(*_quotes(spark, sf_dir), "symbol", "day")


@query
def quote_snapshot_close(spark, sf_dir):
    return quotes.snapshot(*_quotes(spark, sf_dir), "symbol", "day", realtime=False)


@query
def quote_change(spark, sf_dir):
    return quotes.ticker_change(*_quotes(spark, sf_dir), "symbol", "day")


def _yearly_charts(spark, sf_dir):
    """Bars read from one chart for each symbol and year; some have no close, volume or high."""
    n = F.datediff("d", F.lit("1970-01-01"))
    bars = daily_bars(spark, sf_dir).withColumn("close", F.when(n % 7 != 3, F.col("close"))).withColumn("volume", F.when(n % 11 != 5, F.col("volume"))).withColumn("high", F.when(n % 13 != 1, F.col("high")))
    return quotes.chart_bars(_chart(bars.select("symbol", F.year("d").alias("year"), F.col("d").cast("timestamp").alias("ts"), *quotes.PRICES), "symbol", "year"), "symbol", "year")


@query
def close_history(spark, sf_dir):
    return quotes.close_history(_yearly_charts(spark, sf_dir), "symbol", "year")


@query
def bars_zero_filled(spark, sf_dir):
    return rounded(quotes.clean_bars(_yearly_charts(spark, sf_dir), "zero").select("symbol", F.to_date("ts").alias("d"), *quotes.PRICES))


@query
def bars_nulls_dropped(spark, sf_dir):
    return rounded(quotes.clean_bars(_yearly_charts(spark, sf_dir)).select("symbol", F.to_date("ts").alias("d"), *quotes.PRICES))


def _annotated(spark, sf_dir):
    """Items of 20 documents a feed with notes by their place; every fifth feed's answer can't be read."""
    k, feed = F.col("doc_id"), F.floor(F.col("doc_id") / 20).alias("feed")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    items = docs.select(feed, (k % 20).cast("int").alias("position"), F.concat(F.lit("Item "), k.cast("string"), F.lit(" in "), F.coalesce("lang", F.lit(""))).alias("title"))
    said = lambda word: F.concat(F.lit(word), k.cast("string"))
    idx = (k % 20 + 1).cast("int")
    note = F.struct(
        idx.alias("idx"), F.when(k % 3 != 0, True).when(k % 2 == 0, False).alias("relevant"), F.when(k % 4 != 0, said("note ")).alias("summary"),
        F.when(k % 5 != 0, said("text ")).alias("translation"), F.when(k % 3 == 1, "positive").when(k % 7 == 0, "negative").alias("sentiment"),
    )
    none = F.lit(None).cast("string")
    more = lambda at: F.struct(at.cast("int").alias("idx"), F.lit(True).alias("relevant"), said("again ").alias("summary"), none.alias("translation"), none.alias("sentiment"))
    each = F.when(k % 10 == 4, F.array(note, more(idx))).when(k % 20 == 0, F.array(more(F.lit(0)), note, more(F.lit(99)))).otherwise(F.array(note))
    # a feed has no more than 20 documents
    answers = docs.select(feed, "doc_id", each.alias("each")).groupBy("feed").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "each"))), lambda x: x["each"])).alias("notes"))
    text_of = F.to_json("notes")
    answers = answers.select("feed", F.when(F.col("feed") % 5 == 4, F.concat(F.lit("```json\n"), F.substring(text_of, 1, 30))).otherwise(F.concat(F.lit("```json\n"), text_of, F.lit("\n```"))).alias("body"))
    return notes.annotated(items, answers)


@query
def news_notes(spark, sf_dir):
    return _annotated(spark, sf_dir)


@query
def news_shown(spark, sf_dir):
    return notes.shown(_annotated(spark, sf_dir)).select("feed", "place", "title", "summary", "mark")


@query
def score_bars(spark, sf_dir):
    return _scan(spark, sf_dir).select("symbol", "score", "grade", notes.bar_of(F.col("score")).alias("bar"))


@query
def scan_coverage(spark, sf_dir):
    """Of each sector's symbols, those that the scan could score."""
    scored = _scan(spark, sf_dir).select("symbol", "score")
    return notes.coverage(tables.universe(spark, sf_dir).join(scored, "symbol", "left"), "sector", F.col("score").isNotNull())


@query
def study_summaries(spark, sf_dir):
    """Each symbol's study as a JSON document, read back from the folder that it was written to."""
    scored = _scored(spark, sf_dir)
    means = scored.groupBy("symbol").agg(F.count("*").alias("n_samples"), places(F.avg("score"), 2).alias("score_mean"))
    best = analysis.sweet_spots(analysis.bucket_analysis(analysis.labelled(scored)))
    told = summaries.study_summary(means, best, simulate.summary(simulate.dynamic_plan(scored)), simulate.summary(simulate.baseline_plan(scored)))
    path = state.new_folder(spark)
    summaries.write_summaries(told, path)
    plan = lambda name: [F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in ("shares", "final_value", "total_return", "mdd")]
    return summaries.read_summaries(spark, path).select("symbol", "n_samples", "score_mean", F.col("sweet_spot.bucket").alias("sweet_bucket"), F.col("sweet_spot.ev").alias("sweet_ev"), *plan("dca_dynamic"), *plan("dca_baseline"))


ORACLE_SQL |= {name: exactly_rounded(sql) for name, sql in (FEED_SQL | QUOTE_SQL).items()}

__all__ = ["ORACLE_SQL", "QUERIES"]
