"""Feeds as they are published: option chains and rank lists in JSON, Atom entries, index pages and files to choose from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.maths import places
from barloom.sources.feeds import with_short_share, without_namespaces

#: Two publishers' option chains: lists of puts and calls by expiry, or one list with the kind in each row.
CHAINS = "optionChain struct<result: array<struct<options: array<struct<puts: array<struct<openInterest: bigint>>, calls: array<struct<openInterest: bigint>>>>>>>"
QUOTES = "data struct<options: array<struct<option_type: string, open_interest: bigint>>>"
ENTRIES = "entry array<struct<`filing-href`: string, content: struct<_VALUE: string, _href: string>, link: array<struct<_VALUE: string, _href: string>>, id: string, updated: string>>"
HITS = "hits struct<hits: array<struct<_source: struct<display_names: array<string>, entity_name: string, file_date: string, accession_no: string, entity_id: string>>>>"
FILES = "directory struct<item: array<struct<name: string>>>"
RANKS = "feed struct<results: array<struct<id: string>>>"


def malformed(docs: DataFrame) -> DataFrame:
    """The rows whose body isn't JSON."""
    return docs.filter(F.try_parse_json("body").isNull())


def _sum(xs: Column) -> Column:
    return F.aggregate(F.coalesce(xs, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("bigint")))


def option_interest(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, source, total_puts, total_calls of the documents (keys, source, body) in either shape that have open calls."""
    chains, quotes = F.from_json("body", CHAINS)["optionChain"]["result"], F.from_json("body", QUOTES)["data"]["options"]
    told = docs.select(*keys, "source", F.get(chains, F.lit(0))["options"].alias("chains"), quotes.alias("quotes"))
    nested = lambda side: _sum(F.flatten(F.transform("chains", lambda c: F.transform(F.coalesce(c[side], F.array().cast("array<struct<openInterest: bigint>>")), lambda o: o["openInterest"]))))
    flat = lambda kind: _sum(F.transform(F.filter("quotes", lambda o: o["option_type"] == kind), lambda o: o["open_interest"]))
    of = lambda side, kind: F.when(F.col("chains").isNotNull(), nested(side)).otherwise(flat(kind))
    return told.select(*keys, "source", of("puts", "P").alias("total_puts"), of("calls", "C").alias("total_calls")).filter("total_calls <> 0")


def put_call_ratio(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, source, pcr, total_puts, total_calls, signal of the first source (in their order) that has a result for the keys."""
    first = option_interest(docs, *keys).groupBy(*keys).agg(F.min_by(F.struct("source", "total_puts", "total_calls"), "source").alias("r")).select(*keys, "r.*")
    ratio = F.col("total_puts") / F.col("total_calls")
    signal = F.when(ratio > 1.2, "heavy_hedging").when(ratio < 0.5, "bullish").otherwise("neutral")
    return first.select(*keys, "source", places(ratio, 3).alias("pcr"), "total_puts", "total_calls", signal.alias("signal"))


def atom_entries(feeds: DataFrame, most: int = 10) -> DataFrame:
    """feed, position, href, date of the first entries of Atom feeds (feed, xml) that have a link.

    The link is the entry's own element, else its content's, else the first of its links into the archive, else its id if that is one.
    """
    told = feeds.select("feed", F.posexplode(F.slice(F.from_xml(without_namespaces(F.col("xml")), ENTRIES)["entry"], 1, most)).alias("position", "e"))
    some = lambda c: F.when(F.trim(c) != "", c)
    archived = lambda c: c.contains("Archives/edgar")
    links = F.transform(F.filter("e.link", lambda x: archived(x["_href"])), lambda x: x["_href"])
    href = F.coalesce(some(F.col("e.filing-href")), some(F.col("e.content._href")), F.get(links, F.lit(0)), F.when(archived(F.col("e.id")), F.col("e.id")))
    return told.select("feed", "position", href.alias("href"), F.coalesce(F.substring("e.updated", 1, 10), F.lit("")).alias("date")).filter("href is not null")


def form_link(html: Column, page_url: Column) -> Column:
    """The address of the first XML file that an index page links to and that isn't a rendering or a report; null if there is none.

    Addresses from the site's root and relative ones are resolved against the page's, relative ones by their file name.
    """
    name = lambda h: F.element_at(F.split(h, "/"), -1)
    wanted = lambda h: name(h).endswith(".xml") & ~F.lower(h).contains("xsl") & ~name(h).startswith("R") & ~name(h).contains("Financial")
    href = F.get(F.filter(F.regexp_extract_all(html, F.lit("href=[\"']([^\"']+)[\"']")), wanted), F.lit(0))
    site, folder = F.regexp_extract(page_url, "^[A-Za-z]+://[^/]+", 0), F.regexp_extract(page_url, "(?s)^.*/", 0)
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(folder, name(href)))


def without_zeros(number: Column) -> Column:
    """A number's digits without leading zeros, one zero at least."""
    return F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), F.lit("0"))


def search_hits(results: DataFrame, until: dt.date, days: int = 120, most: int = 10) -> DataFrame:
    """institution, filing_date, cik, accession of the first hits of search results (body) with an accession number, filed within the days."""
    hits = F.from_json("body", HITS)["hits"]["hits"]
    since = str(until - dt.timedelta(days=days))
    dated = F.filter(F.transform(hits, lambda h: h["_source"]), lambda s: s["file_date"].between(since, str(until)))
    s = results.select(F.explode(F.slice(dated, 1, most)).alias("s"))
    entity = F.coalesce(F.get("s.display_names", F.lit(0)), F.col("s.entity_name"), F.lit("Unknown"))
    told = s.select(entity.alias("institution"), F.coalesce("s.file_date", F.lit("")).alias("filing_date"), F.coalesce("s.entity_id", F.lit("")).alias("cik"), F.replace("s.accession_no", F.lit("-"), F.lit("")).alias("accession"))
    return told.filter("accession <> ''").withColumn("cik", F.when(F.col("cik") != "", without_zeros(F.col("cik"))))


def table_file(listing: Column) -> Column:
    """The name of a filing's position table in its listing (JSON): the first XML file named so, else the first that is no rendering."""
    names = F.transform(F.from_json(listing, FILES)["directory"]["item"], lambda i: F.coalesce(i["name"], F.lit("")))
    named = F.filter(names, lambda n: F.lower(n).contains("infotable") & F.lower(n).endswith(".xml"))
    other = F.filter(names, lambda n: n.endswith(".xml") & ~F.lower(n).contains("xsl"))
    return F.coalesce(F.get(named, F.lit(0)), F.get(other, F.lit(0)))


def places_in_lists(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and, for each list (list, body), rank_<list>: the place of every wanted id in it, null where it isn't there."""
    names = sorted(r[0] for r in lists.select("list").distinct().collect())  # a column each
    each = lists.select("list", F.posexplode(F.from_json("body", RANKS)["feed"]["results"]).alias("at", "app")).select("list", (F.col("at") + 1).alias("place"), F.col("app.id").alias("id"))
    ranks = each.groupBy("id").agg(*(F.min(F.when(F.col("list") == n, F.col("place"))).alias(f"rank_{n}") for n in names))
    return wanted.select("id").distinct().join(ranks, "id", "left")


def newest_short_volume(spark: SparkSession, folder: str, symbol: str, now: dt.date, name: str = "short{:%Y%m%d}.txt", days: int = 7) -> DataFrame | None:
    """date, short_volume, total_volume, short_pct, signal of a symbol in the newest file of the working days before now; null if none has it.

    Files are chosen by name, so that a day's file is read only where no later one has the symbol.
    """
    rows = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    for k in range(1, days + 1):
        day = now - dt.timedelta(days=k)
        if day.weekday() >= 5:
            continue
        fields = F.split("value", r"\|")
        own = rows.filter(F.col("file") == name.format(day)).filter((F.size(fields) >= 5) & (F.upper(F.get(fields, F.lit(1))) == symbol.upper()))
        whole = lambda i: F.get(fields, F.lit(i)).try_cast("double").cast("bigint")  # noqa: E731, B023
        told = own.select(F.lit(str(day)).alias("date"), whole(2).alias("short_volume"), whole(4).alias("total_volume")).limit(1)
        if not told.isEmpty():
            return with_short_share(told)
    return None
