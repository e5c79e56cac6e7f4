"""Stores from literal samples."""

from pyspark.sql import functions as F

from tideline.api.engine import Engine
from tideline.functions import labels as L
from tideline.plans.compiler import Settings
from tideline.sources.store import TableStore


def store(spark, data):
    """data: metric -> {label tuple: [(ts, value)]}; value None is the stale marker."""
    rows = [
        (metric, dict(labels), ts, float("nan") if v is None else float(v), v is None)
        for metric, series in data.items()
        for labels, samples in series.items()
        for ts, v in samples
    ]
    df = spark.createDataFrame(rows, "metric_name string, labels map<string,string>, ts long, value double, is_stale boolean")
    df = df.withColumn("series_id", L.series_id(F.col("labels")))
    series = df.groupBy("metric_name", "series_id").agg(F.first("labels").alias("labels"), F.max("ts").alias("seen_ms"))
    return TableStore(df.drop("labels"), series)


def engine(spark, data, **settings):
    return Engine(spark, store(spark, data), Settings(**settings))


def instant(spark, data, expr, t, **settings):
    """{label tuple: value} at t."""
    got = engine(spark, data, **settings).query(expr, t).frame.collect()
    return {tuple(sorted((r["labels"] or {}).items())): r["value"] for r in got}


def ranged(spark, data, expr, start, end, step, **settings):
    """{(label tuple, step): value}."""
    got = engine(spark, data, **settings).query_range(expr, start, end, step).frame.collect()
    return {(tuple(sorted((r["labels"] or {}).items())), r["step_ts"]): r["value"] for r in got}
