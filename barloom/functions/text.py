"""Text, time and record helpers of the feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_hash(text: Column) -> Column:
    """The first 12 hex digits of the MD5."""
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def html_excerpt(html: Column, sentences: int = 6, least: int = 40, most: int = 600) -> Column:
    """The first sentences of more than `least` characters of a page's text, cut at `most` characters."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"[ \t\n\r\f\x0B]+", " "))
    parts = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > least)
    return F.substring(F.array_join(F.slice(parts, 1, sentences), ". "), 1, most)


def is_blocked(url: Column, domains: list[str]) -> Column:
    """Whether a URL's host is one of the domains or below one; a leading www. doesn't count."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith(f".{d}")
    return out


def market_session(ts: Column) -> Column:
    """PRE, REGULAR, POST or CLOSED by UTC minute of the day; closed at weekends."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    closed = (F.weekday(ts) >= 5) | (minute < 480)
    return F.when(closed, "CLOSED").when(minute < 810, "PRE").when(minute < 1200, "REGULAR").otherwise("POST")


def size_band(value: Column, shares: Column) -> Column:
    """large, medium or small by value, or by shares where the value is 0."""
    by_value = F.when(value >= 1e6, "large").when(value >= 1e5, "medium").otherwise("small")
    by_shares = F.when(shares >= 50_000, "large").when(shares >= 5_000, "medium").otherwise("small")
    return F.when(value > 0, by_value).otherwise(by_shares)


def trade_type(code: Column, disposed: Column) -> Column:
    """Purchase, Sale or Award of a transaction code; null for those that are left out."""
    skipped = code.isin("C", "J", "G", "W", "Z")
    return F.when(skipped, None).when(code == "P", "Purchase").when(code.isin("S", "D"), "Sale").when(code == "A", "Award").when(disposed == "D", "Sale")


def strip_fences(text: Column) -> Column:
    """Text without the code fences around it."""
    return F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
