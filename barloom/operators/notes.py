"""Notes on a feed's items, given by position in answers of text, and what reports show of items and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.text import strip_fences

#: One answer: notes on items by their number from 1.
NOTES = "array<struct<idx: int, relevant: boolean, summary: string, translation: string, sentiment: string>>"


def annotated(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items (feed, position from 0, other columns) with skip, summary, translation and sentiment from answers (feed, body).

    A body is a JSON list, with or without code fences around it. One that can't be read leaves its items as they are; so
    do notes on positions that don't exist. A note without relevant, or with false, marks its item to be skipped. Of
    several notes on one item the last that doesn't gives the texts.
    """
    notes = answers.select("feed", F.posexplode(F.from_json(strip_fences(F.col("body")), NOTES)).alias("_k", "n"))
    notes = notes.select("feed", (F.coalesce("n.idx", F.lit(0)) - 1).alias("position"), "_k", F.coalesce("n.relevant", F.lit(False)).alias("_ok"), "n")
    text = F.struct(F.coalesce("n.summary", F.lit("")).alias("summary"), F.coalesce("n.translation", F.lit("")).alias("translation"), F.coalesce("n.sentiment", F.lit("neutral")).alias("sentiment"))
    by = notes.groupBy("feed", "position").agg(F.bool_or(~F.col("_ok")).alias("skip"), F.max_by(F.when(F.col("_ok"), text), F.when(F.col("_ok"), F.col("_k"))).alias("_t"))
    return items.join(by, ["feed", "position"], "left").select(*items.columns, F.coalesce("skip", F.lit(False)).alias("skip"), "_t.*")


def shown(items: DataFrame, most: int = 5) -> DataFrame:
    """The first items of each feed that aren't skipped and have a summary, with place (from 1) and mark."""
    place = F.row_number().over(Window.partitionBy("feed").orderBy("position"))
    kept = items.filter(~F.col("skip") & (F.coalesce("summary", F.lit("")) != "")).withColumn("place", place).filter(F.col("place") <= most)
    return kept.withColumn("mark", F.when(F.col("sentiment") == "positive", "+").when(F.col("sentiment") == "negative", "-").otherwise("o"))


def bar_of(score: Column, best: int = 100, width: int = 10) -> Column:
    """A bar of `width` characters, filled for the part of `best` that a score reaches, rounded down."""
    full = F.floor(score / best * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def coverage(rows: DataFrame, group: str, ok: Column) -> DataFrame:
    """group, valid, total and both as text, for each value of group."""
    out = rows.groupBy(group).agg(F.count_if(ok).alias("valid"), F.count("*").alias("total"))
    return out.withColumn("label", F.format_string("%d/%d", "valid", "total"))
