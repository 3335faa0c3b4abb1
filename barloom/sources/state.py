"""State tables: versioned snapshots that are published whole, and keyed results that are computed once.

A table is a folder with `data/<version>` for each version and an empty file `published/<version>` for those that are complete.
Markers are made without overwriting, so of two writers of one version one gets an error, whatever both have written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where a session on one machine has no such setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='barloom-state-')).rstrip('/')}/state-{uuid.uuid4().hex}"


class StateTable:
    """Snapshots in a folder; a reader sees the newest published one, never a half-written one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The published versions, one file name each."""
        at = self._path(f"{self.folder}/published")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def write(self, df: DataFrame) -> int:
        """Write df as the next version and publish it; an error if another writer has published that version meanwhile."""
        version = max(self.versions(), default=0) + 1
        # an own folder for each attempt: what another or a dead writer left is neither read nor in the way
        attempt = f"{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/data/{attempt}")
        out = self._fs.create(self._path(f"{self.folder}/published/{version}"), False)
        out.write(bytearray(attempt.encode()))
        out.close()
        return version

    def _data(self, version: int) -> str:
        return f"{self.folder}/data/{self.spark.read.text(f'{self.folder}/published/{version}').first()[0]}"

    def read(self, defaults: dict[str, tuple[str, object]]) -> DataFrame:
        """The newest snapshot in the columns of defaults (name: (type, value)); columns that it lacks, and nulls, get the value.

        Without any version, no rows.
        """
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, (kind, _) in defaults.items()))
        stored = self.spark.read.parquet(self._data(versions[-1]))
        has = set(stored.columns)
        value = lambda c, kind, v: F.coalesce(F.col(f"`{c}`").cast(kind), F.lit(v).cast(kind)) if c in has else F.lit(v).cast(kind)
        return stored.select(*(value(c, kind, v).alias(c) for c, (kind, v) in defaults.items()))

    def once(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Stored rows for the wanted keys; compute is called with the keys that no version has, if there are any, and its rows stored.

        Where two writers have computed one key, the earlier version counts.
        """
        keys = wanted.columns
        stored = self._all()
        missing = wanted.distinct() if stored is None else wanted.distinct().join(stored.select(*keys).distinct(), keys, "left_anti")
        if not missing.isEmpty():
            self.write(compute(missing))
            stored = self._all()
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("_version"))
        kept = stored.withColumn("_first", first).filter("_first = 1").drop("_first", "_version")
        return kept.join(wanted.distinct(), keys, "left_semi")

    def _all(self) -> DataFrame | None:
        """Every published version, unless there is none; key rows of a version are one each."""
        out = None
        for v in self.versions():
            df = self.spark.read.parquet(self._data(v)).withColumn("_version", F.lit(v))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out
