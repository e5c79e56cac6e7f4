"""Metadata queries over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadQuery
from ..lang.ast import Selector
from ..lang.parser import parse
from ..sources.store import NAME, Store

LIMIT = 100


def label_names(store: Store) -> DataFrame:
    """Distinct label names and __name__."""
    names = store.series().select(F.explode(F.map_keys("labels")).alias("name"))
    return names.union(names.sparkSession.createDataFrame([(NAME,)], "name string")).distinct()


def label_values(store: Store, name: str) -> DataFrame:
    series = store.series()
    value = F.col("metric_name") if name == NAME else F.element_at("labels", name)
    return series.select(value.alias("value")).filter("value IS NOT NULL AND value <> ''").distinct()


def series(store: Store, selectors: list[str], limit: int = LIMIT) -> DataFrame:
    """metric_name and labels of the series that any selector matches."""
    out = None
    for text in selectors:
        tree = parse(text)
        if not isinstance(tree, Selector) or tree.range_ms is not None:
            raise BadQuery(f"not a series selector: {text!r}")
        own = store.series(tree.matchers).select("metric_name", "labels")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise BadQuery("no match[] parameter")
    from ..functions.labels import key

    rows = out.withColumn("k", key(F.col("labels"))).dropDuplicates(["metric_name", "k"])
    return rows.orderBy("metric_name", "k").limit(limit).drop("k")


def count_series(store: Store, selector: str, by: tuple[str, ...]) -> DataFrame:
    """How many series match, by labels, from the dimension alone. Says nothing of any point in time."""
    tree = parse(selector)
    rows = store.series(tree.matchers).select(*[F.element_at("labels", b).alias(b) for b in by])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("value"))


def status(store: Store, top: int = 10) -> dict:
    """Series and sample totals, the metrics with most samples, the labels with most values."""
    totals = store.series().agg(F.count(F.lit(1)).alias("n")).first()
    samples = store.counts()
    labels = store.series().select(F.explode("labels").alias("name", "value")).groupBy("name").agg(F.count_distinct("value").alias("value"))
    pick = lambda df, name, n: [{"name": r[0], "value": r[1]} for r in df.orderBy(F.desc(n), name).limit(top).collect()]
    return {
        "headStats": {"numSeries": totals["n"], "numSamples": samples.agg(F.sum("samples")).first()[0] or 0},
        "seriesCountByMetricName": pick(samples.select("metric_name", "samples"), "metric_name", "samples"),
        "labelValueCountByLabelName": pick(labels, "name", "value"),
    }
