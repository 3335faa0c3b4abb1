"""Readers of filings, news and market files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.maths import places
from barloom.functions.text import title_hash, trade_type

_VALUE = "struct<value: string>"
_TRANSACTION = f"transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<transactionShares: {_VALUE}, transactionPricePerShare: {_VALUE}, transactionAcquiredDisposedCode: {_VALUE}>"
#: What is read of an ownership form; namespaces are removed first.
FORM4 = f"reportingOwner struct<reportingOwnerId: struct<rptOwnerName: string>, reportingOwnerRelationship: struct<officerTitle: string, isDirector: string, isOfficer: string, isTenPercentOwner: string>>, nonDerivativeTable struct<nonDerivativeTransaction: array<struct<{_TRANSACTION}>>>, derivativeTable struct<derivativeTransaction: array<struct<{_TRANSACTION}>>>"
INFOTABLE = "infoTable array<struct<nameOfIssuer: string, value: double, putCall: string, shrsOrPrnAmt: struct<sshPrnamt: double>>>"


def without_namespaces(xml: Column) -> Column:
    """XML without declarations and prefixes of namespaces."""
    plain = F.regexp_replace(xml, r"""\sxmlns(?::\w+)?\s*=\s*("[^"]*"|'[^']*')""", "")
    return F.regexp_replace(plain, r"<(/?)\w+:", "<$1")


def form4_trades(forms: DataFrame) -> DataFrame:
    """filer, title, trade_type, txn_code, shares, price, total_value, date, url of forms (xml, date, url).

    Non-derivative transactions first; left out are gifts, conversions and the like, and those without shares.
    """
    told = forms.select("date", "url", F.from_xml(without_namespaces(F.col("xml")), FORM4).alias("f"))
    who, rel = F.col("f.reportingOwner.reportingOwnerId.rptOwnerName"), F.col("f.reportingOwner.reportingOwnerRelationship")
    yes = lambda c: F.lower(F.trim(c)).isin("1", "true")
    title = F.coalesce(F.when(F.trim(rel["officerTitle"]) != "", F.trim(rel["officerTitle"])), F.when(yes(rel["isDirector"]), "Director"), F.when(yes(rel["isOfficer"]), "Officer"), F.when(yes(rel["isTenPercentOwner"]), "10% Owner"), F.lit(""))
    none = F.array().cast(f"array<struct<{_TRANSACTION}>>")
    trades = F.concat(F.coalesce("f.nonDerivativeTable.nonDerivativeTransaction", none), F.coalesce("f.derivativeTable.derivativeTransaction", none))
    each = told.select("date", "url", F.coalesce(who, F.lit("")).alias("filer"), title.alias("title"), F.explode(trades).alias("t"))
    amount = lambda name: F.coalesce(F.expr(f"try_cast(t.transactionAmounts.{name}.value as double)"), F.lit(0.0))
    code = F.coalesce(F.trim(F.col("t.transactionCoding.transactionCode")), F.lit(""))
    rows = each.select("filer", "title", trade_type(code, F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value")).alias("trade_type"), code.alias("txn_code"), amount("transactionShares").cast("long").alias("shares"), amount("transactionPricePerShare").alias("price"), "date", "url")
    return rows.filter("trade_type is not null and shares <> 0").withColumn("total_value", F.col("shares") * F.col("price"))


def infotable_position(tables: DataFrame, issuer: str, compat: bool = False) -> DataFrame:
    """url, shares, value_usd of the first position in an issuer that isn't an option (tables: xml, url).

    compat: shares read as 0, which is what reading them beside the amount gives.
    """
    rows = tables.select("url", F.from_xml(without_namespaces(F.col("xml")), INFOTABLE).alias("f")).select("url", F.posexplode("f.infoTable").alias("pos", "t"))
    own = rows.filter(F.upper("t.nameOfIssuer").contains(issuer.upper()) & (F.coalesce(F.trim(F.col("t.putCall")), F.lit("")) == ""))
    shares = F.lit(0.0) if compat else F.coalesce("t.shrsOrPrnAmt.sshPrnamt", F.lit(0.0))
    return own.groupBy("url").agg(F.min_by(F.struct(shares.cast("long").alias("shares"), (F.coalesce("t.value", F.lit(0.0)) * 1000).alias("value_usd")), "pos").alias("p")).select("url", "p.*")


def rss_items(feeds: DataFrame, most: int = 15) -> DataFrame:
    """title, date, link, hash of the first items of each feed (xml)."""
    item = "channel struct<item: array<struct<title: string, pubDate: string, link: string>>>"
    told = feeds.select(F.explode(F.slice(F.from_xml(F.col("xml"), item)["channel"]["item"], 1, most)).alias("i"))
    return told.select("i.title", F.col("i.pubDate").alias("date"), "i.link", title_hash(F.col("i.title")).alias("hash"))


def short_volume(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """date, short_volume, total_volume, short_pct, signal of the latest day in pipe-delimited files."""
    rows = spark.read.csv(path, sep="|", header=True, schema="date string, symbol string, short string, exempt string, total string")
    own = rows.filter(F.upper(F.trim("symbol")) == symbol.upper())
    last = own.agg(F.max_by(F.struct("date", F.expr("cast(try_cast(short as double) as bigint)").alias("short_volume"), F.expr("cast(try_cast(total as double) as bigint)").alias("total_volume")), "date").alias("r")).filter("r is not null").select("r.*")
    return last.transform(lambda df: with_short_share(df))


def with_short_share(df: DataFrame) -> DataFrame:
    """short_pct (0 without volume) and signal from short_volume and total_volume."""
    pct = places(F.coalesce(F.try_divide(F.col("short_volume") * F.lit(100.0), F.col("total_volume")), F.lit(0.0)), 1)
    return df.withColumn("short_pct", pct).withColumn("signal", F.when(F.col("short_pct") > 50, "high_short").otherwise("normal"))


def first_source(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any, all with the same columns."""
    tagged = [df.withColumn("_source", F.lit(k)) for k, df in enumerate(sources)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    first = every.agg(F.min("_source").alias("_first"))
    return every.join(F.broadcast(first), F.col("_source") == F.col("_first")).drop("_source", "_first")
