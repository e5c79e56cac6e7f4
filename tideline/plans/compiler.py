"""From the typed tree to one DataFrame plan, node by node."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadQuery, ExecutionError, Unsupported
from ..functions import labels as L
from ..functions.ieee import NAN, arithmetic, compare
from ..functions.scalar import MATH, TIME, clamp_max, clamp_min, round_to
from ..lang.ast import MATRIX, SCALAR, Aggregate, Binary, Call, Expr, Negate, Number, Selector, Subquery, Text
from ..lang.parser import COMPARISONS, SET_OPS
from ..operators import aggregation, binary, rangefn, selectors
from ..operators.histogram import histogram_quantile
from ..operators.vec import Scalar, Vec
from ..sources.store import NAME, Store
from .grid import Grid

LOOKBACK_MS = 300_000


@dataclass(frozen=True)
class Settings:
    lookback_ms: int = LOOKBACK_MS
    max_series: int | None = None
    keep_name: bool = False
    range_plan: str = "auto"
    subquery_step_ms: int = 60_000


class Compiler:
    """Compiles expressions over a store and a grid. `routes` may answer a range function from rollups."""

    def __init__(self, store: Store, grid: Grid, spark, settings: Settings = Settings(), routes=None):
        self.store, self.grid, self.spark, self.settings, self.routes = store, grid, spark, settings, routes

    def on(self, grid: Grid) -> "Compiler":
        return Compiler(self.store, grid, self.spark, self.settings, None)

    # scalars

    def scalar(self, e: Expr) -> Scalar:
        if isinstance(e, Number):
            return Scalar(e.value)
        if isinstance(e, Negate):
            s = self.scalar(e.inner)
            return Scalar(-s.number) if s.frame is None else Scalar(frame=s.frame.withColumn("scalar", -F.col("scalar")))
        if isinstance(e, Binary):
            return self._fold(e)
        if isinstance(e, Call):
            if e.name == "pi":
                return Scalar(math.pi)
            if e.name == "time":
                return Scalar(frame=self.grid.frame(self.spark).withColumn("scalar", F.col("step_ts") / 1000.0))
            if e.name == "scalar":
                vec = self.vector(e.args[0])
                only = vec.points.groupBy("step_ts").agg(F.when(F.count(F.lit(1)) == 1, F.max("value")).otherwise(NAN).alias("scalar"))
                frame = self.grid.frame(self.spark).join(only, "step_ts", "left")
                return Scalar(frame=frame.withColumn("scalar", F.coalesce("scalar", F.lit(NAN))))
        raise BadQuery("not a scalar")

    def _fold(self, e: Binary) -> Scalar:
        left, right = self.scalar(e.left), self.scalar(e.right)
        base = self.grid.frame(self.spark).limit(1) if left.frame is None and right.frame is None else (left.frame or right.frame)
        if left.frame is None and right.frame is None:
            return Scalar(number=fold(e.op, left.number, right.number))
        if left.frame is not None and right.frame is not None:
            rows = left.frame.withColumnRenamed("scalar", "a").join(right.frame.withColumnRenamed("scalar", "b"), "step_ts")
            a, b = F.col("a"), F.col("b")
        else:
            rows, own = base, F.col("scalar")
            a, b = (own, F.lit(right.number)) if left.frame is not None else (F.lit(left.number), own)
        value = F.when(compare(e.op, a, b), 1.0).otherwise(0.0) if e.op in COMPARISONS else arithmetic(e.op, a, b)
        return Scalar(frame=rows.select("step_ts", value.alias("scalar")))

    # vectors

    def vector(self, e: Expr) -> Vec:
        if e.type == SCALAR:
            return self._spread(self.scalar(e))
        if isinstance(e, Selector):
            return self._selector(e)
        if isinstance(e, Negate):
            vec = self.vector(e.inner)
            return vec.map(-F.col("value"))
        if isinstance(e, Aggregate):
            return self._aggregate(e)
        if isinstance(e, Binary):
            return self._binary(e)
        if isinstance(e, Call):
            return self._call(e)
        raise BadQuery(f"a {e.type} is not a result")

    def _spread(self, s: Scalar) -> Vec:
        """A scalar as the one series without labels."""
        frame = s.frame if s.frame is not None else self.grid.frame(self.spark).withColumn("scalar", F.lit(float(s.number)))
        dim = self.spark.range(1).select(L.empty().alias("labels")).select(L.series_id(F.col("labels")).alias("series_id"), "labels")
        return Vec(frame.select(L.series_id(L.empty()).alias("series_id"), "step_ts", F.col("scalar").alias("value")), dim)

    def _at(self, at: float | str | None) -> Grid | None:
        if at is None:
            return None
        ms = {"start": self.grid.start, "end": self.grid.end}.get(at) if isinstance(at, str) else round(at * 1000)
        return Grid(ms, ms, 0)

    def _repeat(self, points: DataFrame) -> DataFrame:
        """Values of a fixed time at every step."""
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.grid.last).cast("long")))
        return points.withColumn("k", steps).select("series_id", self.grid.at(F.col("k")).alias("step_ts"), "value")

    def _dim(self, dim: DataFrame) -> DataFrame:
        most = self.settings.max_series
        if most is not None and dim.limit(most + 1).count() > most:
            raise ExecutionError(f"query matches more than {most} series")
        return dim

    def _selector(self, e: Selector, keep_ts: bool = False) -> Vec:
        fixed = self._at(e.at)
        grid = fixed or self.grid
        look = self.settings.lookback_ms
        found = self.store.select(e.matchers, grid.start - look - e.offset_ms - 1, grid.end - e.offset_ms)
        samples = _shift(found.samples, e.offset_ms)
        points = selectors.instant(samples, grid, look, keep_ts)
        if keep_ts and e.offset_ms:
            points = points.withColumn("value", F.col("value") - e.offset_ms / 1000.0)
        return Vec(self._repeat(points) if fixed else points, self._dim(found.dim))

    def _samples(self, e: Selector | Subquery) -> tuple[DataFrame, DataFrame, Grid, bool]:
        """Samples of a range vector, their dimension, the grid to evaluate at, and whether that is a fixed time."""
        fixed = self._at(e.at)
        grid = fixed or self.grid
        if isinstance(e, Selector):
            found = self.store.select(e.matchers, grid.start - e.range_ms - e.offset_ms, grid.end - e.offset_ms)
            samples = found.samples.filter(~F.col("is_stale")).drop("is_stale")
            return _shift(samples, e.offset_ms), self._dim(found.dim), grid, fixed is not None
        step = e.step_ms or self.settings.subquery_step_ms
        lo = (grid.start - e.range_ms - e.offset_ms) // step * step + step
        hi = (grid.end - e.offset_ms) // step * step
        if hi < lo:
            lo = hi
        vec = self.on(Grid(lo, hi, step)).vector(e.inner)
        samples = vec.points.select("series_id", F.col("step_ts").alias("ts"), "value")
        return _shift(samples, e.offset_ms), vec.dim, grid, fixed is not None

    def _range_call(self, name: str, e: Selector | Subquery, fn: rangefn.RangeFn) -> Vec:
        if self.routes is not None and isinstance(e, Selector):
            routed = self.routes.answer(self, name, e)
            if routed is not None:
                return routed
        samples, dim, grid, fixed = self._samples(e)
        points = rangefn.evaluate(samples, grid, e.range_ms, fn, self.settings.range_plan)
        return Vec(self._repeat(points) if fixed else points, dim)

    def _number(self, e: Expr, what: str) -> float:
        s = self.scalar(e)
        if s.frame is not None:
            raise Unsupported(f"{what} must be a number")
        return s.number

    def _per_step(self, name: str, matrix: Expr, param: Expr, make) -> Vec:
        """A range function with a scalar parameter, which may differ from step to step."""
        s = self.scalar(param)
        if s.frame is None:
            if self.routes is not None and name == "predict_linear" and isinstance(matrix, Selector):
                routed = self.routes.answer(self, name, matrix, s.number)
                if routed is not None:
                    return routed
            return self._range_call(name, matrix, make(F.lit(float(s.number))))
        samples, dim, grid, fixed = self._samples(matrix)
        fn = make(F.col("scalar"))
        plain = replace(fn, final=lambda r: F.struct(*[F.col(c) for c in fn.partial(r)]))
        rows = rangefn._repeated(samples, grid, matrix.range_ms, plain)
        rows = rows.join(s.frame, "step_ts").select("series_id", "step_ts", fn.final(matrix.range_ms).alias("value")).filter("value IS NOT NULL")
        return Vec(self._repeat(rows) if fixed else rows, dim)

    def _call(self, e: Call) -> Vec:
        name, args = e.name, e.args
        value = F.col("value")
        if name in rangefn.FUNCTIONS:
            return self._range_call(name, args[0], rangefn.FUNCTIONS[name])
        if name == "quantile_over_time":
            return self._per_step(name, args[1], args[0], rangefn.quantile_fn)
        if name == "predict_linear":
            return self._per_step(name, args[0], args[1], rangefn.predict_fn)
        if name == "double_exponential_smoothing":
            fn = rangefn.smoothing_fn(self._number(args[1], "a smoothing factor"), self._number(args[2], "a trend factor"))
            return self._range_call(name, args[0], fn)
        if name in MATH:
            return self.vector(args[0]).map(MATH[name](value))
        if name == "timestamp":
            if isinstance(args[0], Selector):
                return self._selector(args[0], keep_ts=True)
            return self.vector(args[0]).map(F.col("step_ts") / 1000.0)
        if name in TIME:
            vec = self.vector(args[0]) if args else self._spread(self.scalar(Call("time", (), SCALAR)))
            return vec.map(TIME[name](value).cast("double"))
        if name in ("round", "clamp", "clamp_min", "clamp_max"):
            return self._bounded(name, args)
        if name == "vector":
            return self._spread(self.scalar(args[0]))
        if name in ("absent", "absent_over_time"):
            return self._absent(args[0])
        if name == "histogram_quantile":
            return histogram_quantile(self.scalar(args[0]), self.vector(args[1]))
        if name == "label_replace":
            dst, template, src, pattern = (a.value for a in args[1:])
            return self.vector(args[0]).relabel(L.replace(F.col("labels"), dst, template, src, pattern))
        if name == "label_join":
            dst, sep, *src = (a.value for a in args[1:])
            return self.vector(args[0]).relabel(L.join(F.col("labels"), dst, sep, tuple(src)))
        if name in ("sort", "sort_desc"):
            return replace(self.vector(args[0]), order=("value", name == "sort_desc"))
        if name in ("sort_by_label", "sort_by_label_desc"):
            return replace(self.vector(args[0]), order=("labels", name.endswith("desc"), tuple(a.value for a in args[1:])))
        raise Unsupported(f"unsupported function {name!r}")

    def _bounded(self, name: str, args: tuple[Expr, ...]) -> Vec:
        vec = self.vector(args[0])
        rows, bounds = vec.points, []
        for k, a in enumerate(args[1:] or (Number(1.0),)):
            rows, c = self.scalar(a).attach(rows, f"s{k}")
            bounds.append(c)
        v = F.col("value")
        if name == "round":
            out = round_to(v, bounds[0])
        elif name == "clamp_min":
            out = clamp_min(v, bounds[0])
        elif name == "clamp_max":
            out = clamp_max(v, bounds[0])
        else:
            out = clamp_min(clamp_max(v, bounds[1]), bounds[0])
        return Vec(rows.select("series_id", "step_ts", out.alias("value")), vec.dim)

    def _absent(self, e: Expr) -> Vec:
        """1 at the steps where nothing is, with the labels that equality matchers tell."""
        if e.type == MATRIX:
            points = self._range_call("present_over_time", e, rangefn.FUNCTIONS["present_over_time"]).points
        else:
            points = self.vector(e).points
        names: dict[str, str] = {}
        if isinstance(e, Selector):
            told = [m for m in e.matchers if m.label != NAME]
            names = {m.label: m.value for m in told if m.op == "=" and m.value and sum(o.label == m.label for o in told) == 1}
        pairs = [F.lit(x) for kv in sorted(names.items()) for x in kv]
        labels = F.create_map(*pairs) if pairs else L.empty()
        dim = self.spark.range(1).select(labels.alias("labels")).select(L.series_id(F.col("labels")).alias("series_id"), "labels")
        gone = self.grid.frame(self.spark).join(points.select("step_ts").distinct(), "step_ts", "left_anti")
        return Vec(gone.select(L.series_id(labels).alias("series_id"), "step_ts", F.lit(1.0).alias("value")), dim)

    def _aggregate(self, e: Aggregate) -> Vec:
        vec = self.vector(e.inner)
        by = (e.grouping, e.without)
        if e.op in aggregation.PLAIN:
            return aggregation.plain(e.op, vec, *by)
        if e.op == "count_values":
            return aggregation.count_values(vec, e.param.value, *by)
        s = self.scalar(e.param)
        if e.op == "quantile":
            return aggregation.quantile(vec, s, *by)
        if e.op in ("topk", "bottomk"):
            return aggregation.top(vec, s, *by, smallest=e.op == "bottomk")
        if e.op == "limitk":
            return aggregation.limit(vec, s, *by)
        return aggregation.limit_ratio(vec, s)

    def _binary(self, e: Binary) -> Vec:
        if e.left.type == SCALAR:
            return binary.with_scalar(e.op, self.vector(e.right), self.scalar(e.left), True, e.bool_modifier)
        if e.right.type == SCALAR:
            return binary.with_scalar(e.op, self.vector(e.left), self.scalar(e.right), False, e.bool_modifier)
        left, right = self.vector(e.left), self.vector(e.right)
        if e.op in SET_OPS:
            return binary.sets(e.op, left, right, e.matching)
        return binary.vectors(e.op, left, right, e.bool_modifier, e.matching)


def _shift(samples: DataFrame, offset_ms: int) -> DataFrame:
    return samples.withColumn("ts", F.col("ts") + offset_ms) if offset_ms else samples


def fold(op: str, a: float, b: float) -> float:
    """Scalar arithmetic with IEEE results."""
    if op in COMPARISONS:
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "atan2":
        return math.atan2(a, b)
    if op == "/":
        if b == 0:
            return NAN if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
        return a / b
    if op == "%":
        return NAN if b == 0 or math.isinf(a) else math.fmod(a, b)
    try:
        got = a**b
        return NAN if isinstance(got, complex) else got
    except OverflowError:
        return math.inf
    except ZeroDivisionError:
        return math.inf


__all__ = ["Compiler", "Settings", "Text", "fold"]
