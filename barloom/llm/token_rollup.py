"""Token counts kept by signed changes.

Totals by source, language and tokenizer version are sums, so any change to the corpus is a signed addition:
an inserted document adds its tokens, a deleted one subtracts them, a revised count adds the difference.
A batch of changes is summed per group and committed under its id in a folder of its own; a batch that is
already committed, or that a compaction took in, is left alone, so replays and retries count once; a compaction keeps
the list of its batches. Totals are the sum over committed batches. One writer commits a batch at a time.

Defined results: null source or language is a group of its own; null counts are 0; a revision of a null count
adds the whole new count; changes of any other kind raise an error when the batch is summed; groups whose
documents have all gone stay, at zero, until compaction drops them; an empty batch commits and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


class TokenRollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _found(self, pattern: str) -> list[str]:
        """Names of the folder's entries that match a pattern."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        return [x.getPath().getParent().getName() for x in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []]

    def _committed(self, batch: str) -> bool:
        return bool(self._found(f"batch={batch}/_SUCCESS"))

    def _taken(self, batch: str) -> set[str]:
        """The batches that a committed compaction took in, those of earlier compactions too."""
        if not self._committed(batch) or not self._found(f"taken={batch}/_SUCCESS"):
            return set()
        return {r[0] for r in self.spark.read.schema("id string").parquet(f"{self.folder}/taken={batch}").collect()}

    def _compacted(self, batch: str) -> bool:
        return any(batch in self._taken(name.removeprefix("taken=")) for name in self._found("taken=*/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes once; False if it was committed before.

        changes: kind (insert, delete or revise), source, lang, tokenizer, tokens, and for revisions old_tokens.
        An attempt that died halfway left no marker and is written over.
        """
        if self._committed(batch) or self._compacted(batch):
            return False
        kind, new, old = F.col("kind"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("long")
        signed = F.when(kind == "insert", new).when(kind == "delete", -new).when(kind == "revise", new - old).otherwise(wrong)
        docs = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
        sums = changes.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("documents"), F.sum(signed).cast("long").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def totals(self, batches: list[str]) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over those of the batches that are committed.

        A batch that one of the others took in counts once.
        """
        within = set().union(*(self._taken(b) for b in batches))
        paths = [f"{self.folder}/batch={b}" for b in dict.fromkeys(batches) if b not in within and self._committed(b)]
        parts = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return parts.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def compact(self, batches: list[str], into: str) -> bool:
        """Commit the sum of batches as one batch; the old ones are then no longer needed, and their replays count no more."""
        if self._committed(into):
            return False
        ids = {b for b in batches if self._committed(b) or self._compacted(b)}
        ids |= set().union(*(self._taken(b) for b in batches))
        self.spark.createDataFrame([(b,) for b in sorted(ids)], "id string").write.mode("overwrite").parquet(f"{self.folder}/taken={into}")
        self.totals(batches).filter("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/batch={into}")
        return True


def change(docs: DataFrame, kind: str, tokenizer: str, tokens: Column, old: Column | None = None) -> DataFrame:
    """A change of one kind for each row of docs."""
    old = F.lit(None).cast("long") if old is None else old
    return docs.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"), old.alias("old_tokens"))
