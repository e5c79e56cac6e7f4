"""Aggregation across series at each step.

Group labels and ids are computed once for each series on the dimension. Points then need one join with that small table and one
aggregation by (group, step) with partial aggregates; without grouping labels even the join goes away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadQuery
from ..functions import labels as L
from ..functions.ieee import float_text, nan_last_max
from .rangefn import interpolated
from .vec import Scalar, Vec

PLAIN = {
    "sum": lambda v: F.sum(v),
    "avg": lambda v: F.avg(v),
    "min": lambda v: F.min(v),
    "max": nan_last_max,
    "count": lambda v: F.count(v).cast("double"),
    "group": lambda v: F.max(F.lit(1.0)),
    "stddev": lambda v: F.stddev_pop(v),
    "stdvar": lambda v: F.var_pop(v),
}


def group_labels(grouping: tuple[str, ...], without: bool) -> Column:
    labels = F.col("labels")
    return L.clean(L.drop(labels, grouping)) if without else L.keep(labels, grouping)


def _grouped(vec: Vec, grouping: tuple[str, ...], without: bool) -> tuple[DataFrame, DataFrame]:
    """The points with their group g, and the dimension of the groups."""
    if not grouping and not without:
        spark = vec.points.sparkSession
        one = spark.range(1).select(L.empty().alias("labels")).select(L.series_id(F.col("labels")).alias("series_id"), "labels")
        return vec.points.withColumn("g", L.series_id(L.empty())), one
    to = vec.dim.select("series_id", group_labels(grouping, without).alias("labels"))
    to = to.select("series_id", L.series_id(F.col("labels")).alias("g"), "labels")
    dim = to.select(F.col("g").alias("series_id"), "labels").dropDuplicates(["series_id"])
    return vec.points.join(to.select("series_id", "g"), "series_id"), dim


def plain(op: str, vec: Vec, grouping: tuple[str, ...], without: bool) -> Vec:
    rows, dim = _grouped(vec, grouping, without)
    points = rows.groupBy("g", "step_ts").agg(PLAIN[op](F.col("value")).alias("value"))
    return Vec(points.withColumnRenamed("g", "series_id"), dim)


def quantile(vec: Vec, q: Scalar, grouping: tuple[str, ...], without: bool) -> Vec:
    rows, dim = _grouped(vec, grouping, without)
    if q.frame is None and 0 <= q.number <= 1:
        points = rows.groupBy("g", "step_ts").agg(F.percentile("value", q.number).alias("value"))
    else:
        rows, phi = q.attach(rows.groupBy("g", "step_ts").agg(F.sort_array(F.collect_list("value")).alias("s")))
        points = rows.select("g", "step_ts", interpolated(F.col("s"), phi).alias("value"))
    return Vec(points.withColumnRenamed("g", "series_id"), dim)


def _ranked(vec: Vec, k: Scalar, grouping: tuple[str, ...], without: bool, *order: Column) -> Vec:
    """The first k of each group and step; original labels stay. Spark keeps k a partition before the shuffle when k is a literal."""
    rows, _ = _grouped(vec, grouping, without)
    rows = rows.join(vec.dim.select("series_id", L.key(F.col("labels")).alias("key")), "series_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g", "step_ts").orderBy(*order, "key")))
    rows, limit = k.attach(rows)
    bound = F.lit(int(max(0, min(k.number, 2**31 - 1)))) if k.frame is None else F.floor(limit)
    return Vec(rows.filter(F.col("rank") <= bound).select("series_id", "step_ts", "value"), vec.dim)


def top(vec: Vec, k: Scalar, grouping: tuple[str, ...], without: bool, smallest: bool) -> Vec:
    if k.frame is None and k.number != k.number:
        raise BadQuery("the number of series must not be NaN")
    value = F.col("value")
    return _ranked(vec, k, grouping, without, F.isnan(value).asc(), value.asc() if smallest else value.desc())


def limit(vec: Vec, k: Scalar, grouping: tuple[str, ...], without: bool) -> Vec:
    """The first k series of each group in label order."""
    return _ranked(vec, k, grouping, without)


def limit_ratio(vec: Vec, r: Scalar) -> Vec:
    """The series whose fixed place is below r, or for negative r the complement of that for 1 + r."""
    if r.frame is not None:
        raise BadQuery("limit_ratio needs a number")
    if not -1 <= r.number <= 1:
        raise BadQuery("limit_ratio needs a ratio between -1 and 1")
    place = L.ratio_offset(F.col("labels"))
    dim = vec.dim.withColumn("place", place)
    dim = dim.filter((F.col("place") < r.number) if r.number > 0 else (F.col("place") >= 1 + r.number) if r.number < 0 else F.lit(False)).drop("place")
    return Vec(vec.points.join(dim.select("series_id"), "series_id", "left_semi"), dim)


def count_values(vec: Vec, label: str, grouping: tuple[str, ...], without: bool) -> Vec:
    rows, dim = _grouped(vec, grouping, without)
    counted = rows.groupBy("g", "step_ts", float_text(F.col("value")).alias("text")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    named = counted.join(dim.withColumnRenamed("series_id", "g"), "g").withColumn("labels", L.put(F.col("labels"), label, F.col("text")))
    named = named.withColumn("series_id", L.series_id(F.col("labels")))
    return Vec(named.select("series_id", "step_ts", "value"), named.select("series_id", "labels").dropDuplicates(["series_id"]))
