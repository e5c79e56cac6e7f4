"""Writing samples and series: remote-write batches, from Arrow data or from a stream of files."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from .files import day_of
from .store import TableStore

#: Fixed value: the bits of the NaN that marks a series as ended.
STALE_BITS = 0x7FF0000000000002
STALE = struct.unpack("<d", struct.pack("<Q", STALE_BITS))[0]
HOUR = 3_600_000

SAMPLES = "metric_name string, series_id long, ts long, value double, is_stale boolean"
SERIES = "metric_name string, series_id long, labels map<string,string>, seen_ms long"


def is_stale(values: np.ndarray) -> np.ndarray:
    """Which values carry the marker; to be asked before Spark rewrites NaNs."""
    return np.ascontiguousarray(values, np.float64).view(np.uint64) == STALE_BITS


@dataclass(frozen=True)
class Point:
    """One sample as it arrives: labels with __name__."""

    labels: dict[str, str]
    ts: int
    value: float


def decode(points: Iterable[Point]) -> pa.Table:
    """labels, ts, value and is_stale of each point."""
    rows = list(points)
    values = np.fromiter((p.value for p in rows), np.float64, len(rows))
    return pa.table(
        {
            "labels": pa.array([list(p.labels.items()) for p in rows], pa.map_(pa.string(), pa.string())),
            "ts": pa.array([p.ts for p in rows], pa.int64()),
            "value": values,
            "is_stale": is_stale(values),
        }
    )


def _one_value() -> Column:
    """Of samples with equal series and time a value stays rather than a marker, and of values the largest."""
    return F.max(F.struct((~F.coalesce("is_stale", F.lit(False))).alias("live"), "value"))


def one_sample_each(samples: DataFrame, *more: str) -> DataFrame:
    """One row for each series and time (and the columns `more`, which follow from these)."""
    kept = samples.groupBy("metric_name", "series_id", "ts", *more).agg(_one_value().alias("of"))
    return kept.select("metric_name", "series_id", "ts", F.col("of.value").alias("value"), (~F.col("of.live")).alias("is_stale"), *more)


def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples and series of a batch of points (labels with __name__, ts, value, is_stale). A series is listed once for each hour."""
    labels = L.clean(L.drop(F.col("labels"), ("__name__",)))
    rows = batch.select(F.coalesce(F.element_at("labels", "__name__"), F.lit("")).alias("metric_name"), labels.alias("labels"), "ts", "value", "is_stale")
    rows = rows.withColumn("series_id", L.series_id(F.col("labels")))
    hour = F.col("ts") - F.pmod(F.col("ts"), F.lit(HOUR))
    series = rows.withColumn("seen_ms", hour).groupBy("metric_name", "series_id", "seen_ms").agg(F.first("labels").alias("labels"))
    return one_sample_each(rows), series.select("metric_name", "series_id", "labels", "seen_ms")


class Table:
    """The stored layout below a path; samples are partitioned by metric and day and sorted by series and time within files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, points: Iterable[Point]) -> None:
        batch = decode(points)
        if batch.num_rows:
            self.write(*split(self.spark.createDataFrame(batch)))

    def write(self, samples: DataFrame, series: DataFrame) -> None:
        rows = samples.withColumn("day", day_of(F.col("ts"))).repartition("metric_name", "day", "series_id")
        rows = rows.sortWithinPartitions("metric_name", "day", "series_id", "ts")
        rows.write.mode("append").partitionBy("metric_name", "day").parquet(f"{self.path}/samples")
        series.write.mode("append").parquet(f"{self.path}/series")

    @property
    def samples(self) -> DataFrame:
        """One row for each series and time, also where batches overlap; filters on metric, day and time reach the scan."""
        return one_sample_each(self.spark.read.schema(SAMPLES + ", day int").parquet(f"{self.path}/samples"), "day")

    @property
    def series(self) -> DataFrame:
        return self.spark.read.schema(SERIES).parquet(f"{self.path}/series")

    def store(self) -> TableStore:
        return TableStore(self.samples, self.series)


def metric_kind(name: str, listed: dict[str, str] | None = None) -> str:
    """counter, gauge, histogram, summary or unknown: as listed, else by suffix."""
    if listed and name in listed:
        return listed[name]
    for suffix, kind in (("_total", "counter"), ("_bucket", "histogram"), ("_count", "counter"), ("_sum", "counter"), ("_created", "gauge")):
        if name.endswith(suffix):
            return kind
    return "gauge" if name else "unknown"


def counter_like(name: str, listed: dict[str, str] | None = None) -> bool:
    return metric_kind(name, listed) in ("counter", "histogram")
