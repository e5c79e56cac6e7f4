"""Where samples come from.

A store answers a selector with a Selection: samples(series_id, ts, value, is_stale) in a time range, and the label map of each series.
Where several samples of a series can have the same time, a column seq has their order; the first of them counts as the value at that time.
Matchers and the time range become filters on physical columns, so that they reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..lang.ast import Matcher

DAY = 86_400_000
NAME = "__name__"


@dataclass
class Selection:
    samples: DataFrame
    dim: DataFrame


class Store:
    def select(self, matchers: tuple[Matcher, ...], lo: int, hi: int) -> Selection:
        """Samples with lo < ts <= hi of the series that match, and the series' labels."""
        raise NotImplementedError

    def series(self, matchers: tuple[Matcher, ...] = ()) -> DataFrame:
        """metric_name and labels of the series that match."""
        raise NotImplementedError


@dataclass
class WideMetric:
    """A metric whose labels are columns of a table."""

    df: DataFrame
    labels: tuple[str, ...]
    ts: Column
    value: Column
    kind: str = "gauge"
    help: str = ""
    seq: Column | None = None

    @property
    def order(self) -> Column:
        zero = F.lit(0).cast("long")
        return zero if self.seq is None else F.coalesce(self.seq.cast("long"), zero)


@dataclass
class WideStore(Store):
    """Metrics over plain tables; matchers turn into filters on the label columns.

    A metric may be given as a function that makes it; it is called when a selector asks for the metric.
    """

    metrics: dict[str, WideMetric | Callable[[], WideMetric]] = field(default_factory=dict)

    def metric(self, name: str) -> WideMetric:
        if not isinstance(self.metrics[name], WideMetric):
            self.metrics[name] = self.metrics[name]()
        return self.metrics[name]

    def _matching(self, matchers: tuple[Matcher, ...]) -> list[tuple[str, WideMetric, Column]]:
        out = []
        for name in self.metrics:
            named = [x for x in matchers if x.label == NAME]
            hits = [x.value == name if x.op in ("=", "!=") else re.fullmatch(x.value, name, re.S) is not None for x in named]
            if not all(hit == (x.op in ("=", "=~")) for x, hit in zip(named, hits, strict=True)):
                continue
            m, on = self.metric(name), F.lit(True)
            for x in matchers:
                if x.label != NAME:
                    value = F.col(x.label).cast("string") if x.label in m.labels else F.lit("")
                    on = on & L.matches(value, x.op, x.value)
            out.append((name, m, on))
        return out

    @staticmethod
    def _map(m: WideMetric) -> Column:
        pairs = [c for name in m.labels for c in (F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit("")))]
        return L.clean(F.create_map(*pairs)) if pairs else L.empty()

    def select(self, matchers: tuple[Matcher, ...], lo: int, hi: int) -> Selection:
        samples, dims = [], []
        for name, m, on in self._matching(matchers):
            rows = m.df.filter(on)
            ident = F.xxhash64(F.lit(name), *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in m.labels])
            picked = rows.select(ident.alias("series_id"), m.ts.cast("long").alias("ts"), m.value.cast("double").alias("value"), F.lit(False).alias("is_stale"), m.order.alias("seq"))
            samples.append(picked.filter((F.col("ts") > lo) & (F.col("ts") <= hi)))
            if m.labels:
                dims.append(rows.select(*m.labels).distinct().select(ident.alias("series_id"), self._map(m).alias("labels")))
            else:
                dims.append(rows.limit(1).select(ident.alias("series_id"), L.empty().alias("labels")))
        if not samples:
            spark = SparkSession.active()
            return Selection(
                spark.createDataFrame([], "series_id long, ts long, value double, is_stale boolean"),
                spark.createDataFrame([], "series_id long, labels map<string,string>"),
            )
        s, d = samples[0], dims[0]
        for a, b in zip(samples[1:], dims[1:], strict=True):
            s, d = s.unionByName(a), d.unionByName(b)
        return Selection(s, d)

    def series(self, matchers: tuple[Matcher, ...] = ()) -> DataFrame:
        out = None
        for name, m, on in self._matching(matchers):
            own = m.df.filter(on).select(*m.labels).distinct().select(F.lit(name).alias("metric_name"), self._map(m).alias("labels"))
            if not m.labels:
                own = m.df.limit(1).select(F.lit(name).alias("metric_name"), L.empty().alias("labels"))
            out = own if out is None else out.unionByName(own)
        if out is None:
            spark = SparkSession.active()
            return spark.createDataFrame([], "metric_name string, labels map<string,string>")
        return out

    def counts(self) -> DataFrame:
        out = None
        for name in self.metrics:
            own = self.metric(name).df.agg(F.count(F.lit(1)).alias("samples")).select(F.lit(name).alias("metric_name"), "samples")
            out = own if out is None else out.unionByName(own)
        return out


@dataclass
class TableStore(Store):
    """The stored layout: samples(metric_name, series_id, ts, value, is_stale; seq where times repeat) and series(metric_name, series_id, labels, seen_ms).

    A series is identified by metric and series_id together; the newest labels win.
    """

    samples_table: DataFrame
    series_table: DataFrame

    def dimension(self) -> DataFrame:
        return self.series_table.groupBy("metric_name", "series_id").agg(F.max_by("labels", "seen_ms").alias("labels"))

    def series(self, matchers: tuple[Matcher, ...] = ()) -> DataFrame:
        dim = self.dimension()
        on = F.lit(True)
        for m in matchers:
            value = F.col("metric_name") if m.label == NAME else L.get(F.col("labels"), m.label)
            on = on & L.matches(value, m.op, m.value)
        return dim.filter(on)

    def select(self, matchers: tuple[Matcher, ...], lo: int, hi: int) -> Selection:
        dim = self.series(matchers)
        ident = F.xxhash64("metric_name", "series_id")
        rows = self.samples_table.filter((F.col("ts") > lo) & (F.col("ts") <= hi))
        if "day" in rows.columns:  # the other partition column
            rows = rows.filter(F.col("day").between((lo + 1) // DAY, hi // DAY))
        for m in matchers:  # the partition column is filtered directly
            if m.label == NAME:
                rows = rows.filter(L.matches(F.col("metric_name"), m.op, m.value))
        if any(m.label != NAME for m in matchers):
            rows = rows.join(dim.select("metric_name", "series_id"), ["metric_name", "series_id"], "left_semi")
        return Selection(
            rows.select(ident.alias("series_id"), "ts", "value", "is_stale", *[c for c in rows.columns if c == "seq"]), dim.select(ident.alias("series_id"), L.clean(F.col("labels")).alias("labels"))
        )

    def counts(self) -> DataFrame:
        return self.samples_table.groupBy("metric_name").agg(F.count(F.lit(1)).alias("samples"))
