"""URL filtering by hashed host-suffix and path-prefix expressions.

Every distinct URL is expanded into its host suffixes times those path prefixes whose length some rule has.
Expressions and rules meet by an equi-join on the first 4 bytes of their SHA-256; the full digests confirm
a match and the longest matching rule decides.

Defined results: a null URL, or one without "://", has an empty host and path and matches nothing; URLs
that no rule fits get the default verdict; repeated rows each get a row; only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii

#: (verdict, host, path); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _key(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _suffixes(host: Column, counts: list[int]) -> Column:
    """The last labels of host, as many of them as each of the counts says, where it has so many."""
    labels = F.size(F.split(host, r"\."))
    ends = [F.when(labels >= n, F.substring_index(host, ".", -n)) for n in counts] or [F.lit(None).cast("string")]
    return F.filter(F.array(*ends), lambda h: h.isNotNull())


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    rules: verdict, host, path. Of rules as long, the one that sorts first decides, so results don't
    depend on the rules' order.
    """
    told = rules.select("verdict", lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")).filter("rule_host is not null")
    told = told.withColumn("digest", _key(F.col("rule_host"), F.col("rule_path"))).withColumn("prefix", F.substring("digest", 1, 8))
    told = told.withColumn("rule", F.concat("rule_host", "rule_path"))
    # lengths of rule paths: no more of them than a URL has characters
    lengths = sorted(r[0] for r in told.select(F.length("rule_path")).distinct().collect())
    # numbers of labels of rule hosts, likewise: only such ends of a host are hashed, so a long host costs no more than its length
    counts = sorted(r[0] for r in told.select(F.size(F.split("rule_host", r"\.")).alias("labels")).distinct().collect())
    at = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = at.select("host", "path").filter("host <> ''").distinct()
    prefixes = F.filter(F.array([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    terms = places.select("host", "path", F.explode(_suffixes(F.col("host"), counts)).alias("h"), F.col("path").alias("full")).select("host", "path", "h", F.explode(prefixes).alias("p"))
    terms = terms.withColumn("term", _key(F.col("h"), F.col("p"))).withColumn("prefix", F.substring("term", 1, 8))
    hits = terms.join(told, "prefix").filter(F.col("term") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("size"), "rule", "verdict")).alias("best"))
    joined = at.join(best.select("host", "path", "best.rule", "best.verdict"), ["host", "path"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
