"""Binary operators: vector matching and set operators as equi-joins on (step, match key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.ieee import arithmetic, compare
from ..lang.ast import Matching
from ..lang.parser import COMPARISONS
from .vec import Scalar, Vec


def _result(op: str, flag: bool, left: Column, right: Column, kept: Column) -> tuple[Column, Column | None]:
    """The value, and which rows stay."""
    if op not in COMPARISONS:
        return arithmetic(op, left, right), None
    on = compare(op, left, right)
    return (F.when(on, 1.0).otherwise(0.0), None) if flag else (kept, on)


def with_scalar(op: str, vec: Vec, scalar: Scalar, scalar_left: bool, flag: bool) -> Vec:
    rows, s = scalar.attach(vec.points)
    v = F.col("value")
    value, on = _result(op, flag, s if scalar_left else v, v if scalar_left else s, v)
    if on is not None:
        rows = rows.filter(on)
    return Vec(rows.select("series_id", "step_ts", value.alias("value")), vec.dim)


def match_labels(matching: Matching) -> Column:
    labels = F.col("labels")
    return L.keep(labels, matching.labels) if matching.on else L.clean(L.drop(labels, matching.labels))


def _keyed(vec: Vec, matching: Matching) -> DataFrame:
    """Points with the hash of their match labels."""
    to = vec.dim.select("series_id", L.series_id(match_labels(matching)).alias("m"))
    return vec.points.join(to, "series_id")


def _single(rows: DataFrame, side: str) -> DataFrame:
    """At most one series for each step and match key, else an error."""
    text = F.lit(f"many-to-many matching not allowed: matching labels must be unique on the {side} side")
    value = F.when(F.count(F.lit(1)) > 1, F.raise_error(text).cast("double")).otherwise(F.max("value"))
    return rows.groupBy("step_ts", "m").agg(value.alias("value"), F.max("series_id").alias("series_id"))


def vectors(op: str, left: Vec, right: Vec, flag: bool, matching: Matching) -> Vec:
    swap = matching.card == "one-to-many"
    many, one = (right, left) if swap else (left, right)
    many_rows, one_rows = _keyed(many, matching), _single(_keyed(one, matching), "left" if swap else "right")
    grouped = matching.card != "one-to-one"
    if not grouped:
        many_rows = _single(many_rows, "left")
    one_rows = one_rows.select("step_ts", "m", F.col("value").alias("other"), F.col("series_id").alias("other_id"))
    rows = many_rows.join(one_rows, ["step_ts", "m"])
    a, b = F.col("value"), F.col("other")
    x, y = (b, a) if swap else (a, b)
    value, on = _result(op, flag, x, y, x)
    if on is not None:
        rows = rows.filter(on)
    rows = rows.select("series_id", "other_id", "step_ts", value.alias("value"))
    if not grouped:
        return Vec(rows.select("series_id", "step_ts", "value"), many.dim).relabel(match_labels(matching))
    if not matching.include:
        return Vec(rows.select("series_id", "step_ts", "value"), many.dim)
    # Labels that come from the one side depend on the pair of series, so the pairs are the new series.
    pairs = rows.select("series_id", "other_id").distinct()
    pairs = pairs.join(many.dim, "series_id").join(one.dim.select(F.col("series_id").alias("other_id"), F.col("labels").alias("others")), "other_id")
    labels = F.col("labels")
    for name in matching.include:
        labels = L.put(labels, name, L.get(F.col("others"), name))
    pairs = pairs.select("series_id", "other_id", labels.alias("to")).withColumn("new_id", L.series_id(F.col("to")))
    points = rows.join(pairs.select("series_id", "other_id", "new_id"), ["series_id", "other_id"])
    dim = pairs.select(F.col("new_id").alias("series_id"), F.col("to").alias("labels")).dropDuplicates(["series_id"])
    return Vec(points.select(F.col("new_id").alias("series_id"), "step_ts", "value"), dim)


def sets(op: str, left: Vec, right: Vec, matching: Matching) -> Vec:
    lhs, rhs = _keyed(left, matching), _keyed(right, matching)
    on, out = ["step_ts", "m"], ("series_id", "step_ts", "value")
    if op == "or":
        rest = rhs.join(lhs.select(*on), on, "left_anti").select(*out)
        dim = left.dim.unionByName(right.dim).dropDuplicates(["series_id"])
        return Vec(left.points.select(*out).unionByName(rest), dim)
    kind = "left_semi" if op == "and" else "left_anti"
    return Vec(lhs.join(rhs.select(*on), on, kind).select(*out), left.dim)
