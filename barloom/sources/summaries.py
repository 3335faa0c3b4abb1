"""Summaries of studies as JSON, a line for each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = "struct<shares: double, cash_left: double, total_input: double, final_value: double, total_return: double, avg_cost: double, mdd: double>"
SUMMARY = f"symbol string, n_samples bigint, score_mean double, sweet_spot struct<bucket: string, avg: double, winrate: double, ev: double>, dca_dynamic {PLAN}, dca_baseline {PLAN}"


def study_summary(scores: DataFrame, sweet_spot: DataFrame, dynamic: DataFrame, baseline: DataFrame) -> DataFrame:
    """SUMMARY's columns from scores (symbol, n_samples, score_mean) and tables with at most one row for each symbol."""
    nested = lambda df, name: df.select("symbol", F.struct(*(c for c in df.columns if c != "symbol")).alias(name))
    out = scores
    for df, name in ((sweet_spot, "sweet_spot"), (dynamic, "dca_dynamic"), (baseline, "dca_baseline")):
        out = out.join(nested(df, name), "symbol", "left")
    return out


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Write one JSON document a line; what is null is left out."""
    summaries.write.mode("errorifexists").json(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(path)
