"""Quantiles of classic histograms (one series a bucket, upper bound in the label `le`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.ieee import INF, nan
from .vec import Scalar, Vec

#: Counts that differ by less than this share are taken as equal.
TOLERANCE = 1e-12


def bound(labels: Column) -> Column:
    text = F.element_at(labels, "le")
    return F.when(text.isin("+Inf", "Inf", "inf"), F.lit(INF)).when(text == "-Inf", F.lit(-INF)).otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))


def monotonic(counts: Column) -> Column:
    """Counts that never fall; nearly equal neighbours become equal."""

    def step(acc: Column, c: Column) -> Column:
        before = F.element_at(acc, -1)
        largest = F.greatest(F.abs(before), F.abs(c))
        near = F.abs(before - c) < F.when((before == 0) | (c == 0), F.lit(TOLERANCE)).otherwise(TOLERANCE * largest)
        return F.concat(acc, F.array(F.when((c <= before) | near, before).otherwise(c)))

    return F.aggregate(F.slice(counts, 2, F.size(counts)), F.slice(counts, 1, 1), step)


def bucket_quantile(q: Column, buckets: Column) -> Column:
    """From an array of (le, c) sorted by bound, one entry a bound."""
    le, c = F.transform(buckets, lambda b: b["le"]), monotonic(F.transform(buckets, lambda b: b["c"]))
    # The steps are written as a fold over one struct, so no expression is repeated in the plan.
    state = F.struct(le.alias("le"), c.alias("c"), F.size(buckets).alias("n"))
    return F.element_at(F.transform(F.array(state), lambda s: _inside(q, s)), 1)


def _inside(q: Column, s: Column) -> Column:
    le, c, n = s["le"], s["c"], s["n"]
    total = F.element_at(c, -1)
    rank = q * total
    # the first bucket, the last aside, that reaches the rank
    at = F.when(F.isnan(rank), n).otherwise(F.size(F.filter(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), lambda x: x < rank)) + 1)
    pick = lambda a, k: F.element_at(a, F.greatest(F.lit(1), F.least(k, n)))
    low = F.when(at > 1, pick(le, at - 1)).otherwise(F.lit(0.0))
    below = F.when(at > 1, pick(c, at - 1)).otherwise(F.lit(0.0))
    inner = pick(c, at) - below
    share = F.when(inner == 0, nan()).otherwise((rank - below) / F.when(inner == 0, F.lit(1.0)).otherwise(inner))
    value = (
        F.when(at >= n, pick(le, n - 1))
        .when((at == 1) & (F.element_at(le, 1) <= 0), F.element_at(le, 1))
        .otherwise(low + (pick(le, at) - low) * share)
    )
    usable = (F.element_at(le, -1) == INF) & (n >= 2) & (total != 0)
    return F.when(F.isnan(q), nan()).when(q < 0, F.lit(-INF)).when(q > 1, F.lit(INF)).when(usable, value).otherwise(nan())


def histogram_quantile(phi: Scalar, vec: Vec) -> Vec:
    to = vec.dim.filter(F.element_at("labels", "le").isNotNull())
    to = to.select("series_id", L.clean(L.drop(F.col("labels"), ("le",))).alias("labels"), bound(F.col("labels")).alias("le"))
    to = to.select("series_id", L.series_id(F.col("labels")).alias("g"), "labels", "le")
    dim = to.select(F.col("g").alias("series_id"), "labels").dropDuplicates(["series_id"])
    rows = vec.points.join(to.select("series_id", "g", "le"), "series_id").groupBy("g", "step_ts", "le").agg(F.sum("value").alias("c"))
    rows = rows.groupBy("g", "step_ts").agg(F.sort_array(F.collect_list(F.struct("le", "c"))).alias("b"))
    rows, q = phi.attach(rows)
    return Vec(rows.select(F.col("g").alias("series_id"), "step_ts", bucket_quantile(q, F.col("b")).alias("value")), dim)
