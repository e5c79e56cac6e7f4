"""Selectors: from samples to steps.

An instant selector takes, at each step, the newest sample that is not older than the lookback. A sample is the newest from its own
time until the next one of its series, so its steps are an interval that one look at the next sample settles: no sample is repeated for a step it
does not serve, and nothing is aggregated. Range functions get the pair (previous sample, sample) the same way.

Both looks run in windows over (series, time chunk), with the few samples at a chunk's edge present in two chunks, so one very long or
very dense series is still spread over many tasks.

Samples of one series and time follow each other by seq; the first of them is the one that serves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grid import Grid

CHUNKS_PER_SPAN = 16


def sequenced(samples: DataFrame) -> DataFrame:
    return samples if "seq" in samples.columns else samples.withColumn("seq", F.lit(0).cast("long"))


def _chunked(samples: DataFrame, span: int, ahead: bool) -> DataFrame:
    """Samples with their chunk; those within span of the edge also serve the neighbour as context."""
    width = max(CHUNKS_PER_SPAN * span, 3_600_000)
    own = F.floor(F.col("ts") / width).cast("long")
    into = F.col("ts") - own * width
    other = own - 1 if ahead else own + 1
    edge = into <= span if ahead else into >= width - span
    both = F.when(edge, F.array(own, other)).otherwise(F.array(own))
    return samples.withColumn("_own", own).withColumn("_chunk", F.explode(both))


def instant(samples: DataFrame, grid: Grid, lookback: int, keep_ts: bool = False) -> DataFrame:
    """points of the newest sample in [t - lookback, t] at each step; a stale newest sample gives none."""
    window = Window.partitionBy("series_id", "_chunk").orderBy("ts", F.desc("seq"))
    rows = _chunked(sequenced(samples), lookback, ahead=True).withColumn("_next", F.lead("ts").over(window))
    rows = rows.filter((F.col("_own") == F.col("_chunk")) & ~F.col("is_stale"))
    until = F.least(F.col("ts") + lookback, F.coalesce(F.col("_next") - 1, F.col("ts") + lookback))
    rows = rows.select(
        "series_id", "ts", "value", grid.first_not_before(F.col("ts")).alias("k0"), grid.last_not_after(until).alias("k1")
    ).filter("k0 <= k1")
    shown = (F.col("ts") / 1000.0) if keep_ts else F.col("value")
    rows = rows.select("series_id", shown.alias("value"), F.explode(F.sequence("k0", "k1")).alias("k"))
    return rows.select("series_id", grid.at(F.col("k")).alias("step_ts"), "value")


def with_previous(samples: DataFrame, span: int) -> DataFrame:
    """Samples with pv and pt, value and time of the one before if it is within span."""
    window = Window.partitionBy("series_id", "_chunk").orderBy("ts", "seq")
    rows = _chunked(sequenced(samples), span, ahead=False)
    rows = rows.withColumn("pv", F.lag("value").over(window)).withColumn("pt", F.lag("ts").over(window))
    return rows.filter(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk")
