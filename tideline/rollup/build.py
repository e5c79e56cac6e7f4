"""Building rollups: raw samples to buckets, buckets to coarser buckets.

A bucket of a series holds min, max, sum and count of its values, the first and last sample, and the growth of the counter. Growth is
summed over pairs of neighbouring samples, however far apart, and belongs to the bucket of the later one, so nothing is lost between buckets and a
counter reset counts from zero. Of samples with equal time the first by seq is a bucket's first or last; pairs are of all samples. Pairs within a bucket are found there; a bucket's first sample is paired with the last one of the series' bucket before. Every aggregate can be merged, so coarser tiers come from finer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.selectors import sequenced

KEYS = ("metric_name", "series_id")


def bucket(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width).cast("long"))


def _growth(value: Column, before: Column) -> Column:
    """What a counter grew by; nothing where there is no sample before."""
    return F.coalesce(F.when(value < before, value).otherwise(value - before), F.lit(0.0))


def from_samples(samples: DataFrame, width: int, before: DataFrame | None = None) -> DataFrame:
    """samples(metric_name, series_id, ts, value, is_stale) to one row for each series and bucket.

    before(metric_name, series_id, last_time, last_value) has each series' last sample ahead of these samples.
    """
    rows = sequenced(samples).filter(~F.col("is_stale")).select(*KEYS, bucket(F.col("ts"), width).alias("bucket"), "ts", "value", "seq")
    inside = Window.partitionBy(*KEYS, "bucket").orderBy("ts", "seq")
    before_it, after_it = F.lag("ts").over(inside), F.lead("ts").over(inside)
    buckets = (
        rows.withColumn("grown", _growth(F.col("value"), F.lag("value").over(inside)))
        .withColumn("first", F.when(before_it.isNull() | (before_it < F.col("ts")), F.col("ts")))
        .withColumn("end", F.when(after_it.isNull(), F.col("value")))
        .groupBy(*KEYS, "bucket")
        .agg(
            F.min("value").alias("val_min"),
            F.max("value").alias("val_max"),
            F.sum("value").alias("val_sum"),
            F.count(F.lit(1)).alias("val_count"),
            F.sum("grown").alias("counter_total"),
            F.min("ts").alias("first_time"),
            F.max("ts").alias("last_time"),
            F.min_by("value", "first").alias("first_value"),
            F.max_by("value", "first").alias("last_value"),
            F.max("end").alias("end"),
        )
    )
    columns = [c for c in buckets.columns if c != "end"]
    if before is not None:
        buckets = buckets.unionByName(before.select(*KEYS, "last_time", F.col("last_value").alias("end")), allowMissingColumns=True)
    between = Window.partitionBy(*KEYS).orderBy("last_time")
    grown = F.col("counter_total") + _growth(F.col("first_value"), F.lag("end").over(between))
    return buckets.withColumn("counter_total", grown).filter("bucket IS NOT NULL").select(*columns)


def from_tier(tier: DataFrame, width: int) -> DataFrame:
    """Buckets to buckets of a multiple of their width."""
    return tier.groupBy("metric_name", "series_id", bucket(F.col("bucket"), width).alias("bucket")).agg(
        F.min("val_min").alias("val_min"),
        F.max("val_max").alias("val_max"),
        F.sum("val_sum").alias("val_sum"),
        F.sum("val_count").alias("val_count"),
        F.sum("counter_total").alias("counter_total"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.min_by("first_value", "first_time").alias("first_value"),
        F.max_by("last_value", "last_time").alias("last_value"),
    )
