"""Rollup tables on disk: build, refresh, retention."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import day_of, exists, read_text, write_text
from .build import KEYS, from_samples, from_tier
from .config import RollupConfig

DAY = 86_400_000


@dataclass
class RollupStore:
    """Tier tables below `path`, partitioned by day; buckets of a day are replaced as a whole, so a refresh can be run again."""

    spark: SparkSession
    path: str
    config: RollupConfig

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        rows = df.withColumn("day", day_of(F.col("bucket")))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/{name}")

    def refresh(self, samples: DataFrame, now: int, since: int | None = None) -> list[str]:
        """Bring every tier up to now - compact_after. Without `since`, or after a change of the tiers, all history is built.

        Late samples are covered by giving their time as since: the days from there on are computed again.
        """
        marker = f"{self.path}/_tiers.json"
        known = json.loads(read_text(self.spark, marker)).get("checksum") if exists(self.spark, marker) else None
        whole = since is None or known != self.config.checksum()
        built, source = [], None
        for tier in self.config.tiers:
            upto = (now - tier.compact_after) // tier.resolution * tier.resolution
            start = None if whole else since // DAY * DAY
            if source is None:
                rows, before = samples.filter(F.col("ts") < upto), None
                if start is not None:  # each series goes on from its last bucket before that day
                    rows = rows.filter(F.col("ts") >= start)
                    older = self.table(tier.table).filter(F.col("day") < start // DAY)
                    before = older.groupBy(*KEYS).agg(F.max_by("last_value", "last_time").alias("last_value"), F.max("last_time").alias("last_time"))
                buckets = from_samples(rows, tier.resolution, before)
            else:
                rows = source.filter(F.col("bucket") < upto)
                if start is not None:
                    rows = rows.filter(F.col("bucket") >= start)
                buckets = from_tier(rows, tier.resolution)
            if start is not None:
                buckets = buckets.filter(F.col("bucket") >= start)
            self._write(buckets, tier.table)
            source = self.table(tier.table).drop("day")
            built.append(tier.table)
        write_text(self.spark, marker, json.dumps({"checksum": self.config.checksum()}))
        return built

    def expire(self, now: int) -> list[str]:
        """Drop days that are past a tier's retention; the paths that went."""
        gone = []
        for tier in self.config.tiers:
            if tier.retention is not None:
                gone += drop_days(self.spark, f"{self.path}/{tier.table}", now - tier.retention)
        return gone


def drop_days(spark: SparkSession, path: str, before: int) -> list[str]:
    """Delete day partitions that end before a time."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("day=") and (int(name[4:]) + 1) * DAY <= before:
                fs.delete(status.getPath(), True)
                gone.append(status.getPath().toString())
    return gone
