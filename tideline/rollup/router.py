"""Answering range functions from rollups.

A tier is used only where range, step and grid are multiples of its resolution; then its buckets tile every window, and min, max, sum, count and
avg are exact; counter growth is extended to the full range, by 5 % at most. Other queries go to a finer tier or to raw samples. Each
segment of the time range comes from the tier, or raw samples rolled up on the fly, that RollupConfig names for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..lang.ast import Selector
from ..operators.vec import Vec
from ..sources.store import NAME, TableStore
from .build import from_samples, from_tier
from .config import RollupConfig
from .store import RollupStore

CAP = 1.05
DAY = 86_400_000
#: Raw samples are read this far ahead of a part, for the growth up to its first sample.
RAW_LOOKBACK = DAY

def _growth(range_ms: int, per_second: bool):
    span = (F.col("last") - F.col("first")) / 1000.0
    factor = F.least(F.lit(range_ms / 1000.0) / F.when(span > 0, span).otherwise(F.lit(1.0)), F.lit(CAP))
    value = F.col("grown") * F.when(span > 0, factor).otherwise(F.lit(1.0))
    return value / (range_ms / 1000.0) if per_second else value


@dataclass
class Routes:
    rollups: RollupStore
    config: RollupConfig
    now: int

    #: function -> value from the merged buckets of a window
    FUNCTIONS = {
        "rate": lambda r: _growth(r, True),
        "increase": lambda r: _growth(r, False),
        "avg_over_time": lambda r: F.col("total") / F.col("n"),
        "sum_over_time": lambda r: F.col("total"),
        "count_over_time": lambda r: F.col("n").cast("double"),
        "min_over_time": lambda r: F.col("low"),
        "max_over_time": lambda r: F.col("high"),
        "last_over_time": lambda r: F.col("newest"),
        "deriv": lambda r: F.when(F.col("buckets") >= 2, F.col("slope")),
        "irate": lambda r: F.when(
            F.col("two")["pt"].isNotNull(),
            F.when(F.col("two")["v"] < F.col("two")["pv"], F.col("two")["v"]).otherwise(F.col("two")["v"] - F.col("two")["pv"])
            / ((F.col("two")["t"] - F.col("two")["pt"]) / 1000.0),
        ),
    }

    def buckets(self, store: TableStore, e: Selector, dim: DataFrame, start: int, end: int, step: int) -> tuple[DataFrame, int] | None:
        """Buckets of the selected series (those of dim) over the segments of a time range, and their width."""
        tier = self.config.select(step, e.range_ms, end)
        if tier is None:
            return None
        parts, width = [], tier.resolution

        def own(rows: DataFrame, lo: int, upto: int) -> DataFrame:
            """Filtered before anything is rolled up, so that the scan is pruned by metric and day."""
            if "day" in rows.columns:
                rows = rows.filter(F.col("day").between(lo // DAY, (upto - 1) // DAY)).drop("day")
            for m in e.matchers:
                if m.label == NAME:
                    rows = rows.filter(L.matches(F.col("metric_name"), m.op, m.value))
            return rows.join(dim.select("metric_name", "series_id"), ["metric_name", "series_id"], "left_semi")

        segments = self.config.segments(start, end, tier, self.now)
        for k, seg in enumerate(segments):
            # Cut at whole buckets; what a part does not hold in full comes from the next, finer one.
            lo = seg.start // width * width
            upto = -(-seg.end // width) * width if k == len(segments) - 1 else seg.end // width * width
            if seg.tier is None:
                raw = store.samples_table.filter((F.col("ts") >= lo - RAW_LOOKBACK) & (F.col("ts") < upto))
                rows = from_samples(own(raw, lo - RAW_LOOKBACK, upto), width)
            else:
                rows = own(self.rollups.table(seg.tier.table).filter((F.col("bucket") >= lo) & (F.col("bucket") < upto)), lo, upto)
                if seg.tier.resolution != width:
                    rows = from_tier(rows, width)
            parts.append(rows.filter((F.col("bucket") >= lo) & (F.col("bucket") < upto)))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out, width

    def answer(self, compiler, name: str, e: Selector, horizon: float | None = None) -> Vec | None:
        """The points of a range function, or None if raw samples have to answer. horizon: of predict_linear, in seconds."""
        final = self.FUNCTIONS.get(name)
        if name == "predict_linear" and horizon is not None:
            final = lambda r: F.when(F.col("buckets") >= 2, F.col("base") + F.col("slope") * horizon)
        grid = compiler.grid
        if final is None or e.at is not None or not isinstance(compiler.store, TableStore):
            return None
        first = grid.start - e.range_ms - e.offset_ms
        dim = compiler.store.series(e.matchers)
        found = self.buckets(compiler.store, e, dim, first, grid.end - e.offset_ms, grid.step)
        if found is None:
            return None
        rows, width = found
        ident = F.xxhash64("metric_name", "series_id")
        rows = rows.select(ident.alias("series_id"), (F.col("bucket") + e.offset_ms).alias("ts"), *[c for c in rows.columns if c.startswith(("val", "counter", "first", "last"))])
        points = self._windows(rows, grid, e.range_ms, width).select("series_id", "step_ts", final(e.range_ms).alias("value"))
        return Vec(points.filter("value IS NOT NULL"), dim.select(ident.alias("series_id"), L.clean(F.col("labels")).alias("labels")))

    @staticmethod
    def _windows(rows: DataFrame, grid, range_ms: int, width: int) -> DataFrame:
        """Merge the buckets [ts, ts + width) that lie in (t - range, t] as a whole: t - range <= ts and ts + width <= t."""
        k0, k1 = grid.first_not_before(F.col("ts") + width), grid.last_not_after(F.col("ts") + range_ms)
        spread = rows.withColumn("k0", k0).withColumn("k1", k1).filter("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1")))
        spread = spread.withColumn("step_ts", grid.at(F.col("k")))
        order = Window.partitionBy("series_id", "step_ts").orderBy("ts")
        spread = spread.withColumn("pv", F.lag("last_value").over(order)).withColumn("pt", F.lag("last_time").over(order))
        x = (F.col("last_time") - F.col("step_ts")) / 1000.0
        return spread.groupBy("series_id", "step_ts").agg(
            F.sum("counter_total").alias("grown"),
            F.min("first_time").alias("first"),
            F.max("last_time").alias("last"),
            F.sum("val_sum").alias("total"),
            F.sum("val_count").alias("n"),
            F.min("val_min").alias("low"),
            F.max("val_max").alias("high"),
            F.max_by("last_value", "last_time").alias("newest"),
            F.count(F.lit(1)).alias("buckets"),
            F.regr_slope("last_value", x).alias("slope"),
            F.regr_intercept("last_value", x).alias("base"),
            F.max_by(F.struct(F.col("last_value").alias("v"), F.col("last_time").alias("t"), "pv", "pt"), "ts").alias("two"),
        )
