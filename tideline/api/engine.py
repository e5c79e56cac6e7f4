"""The query engine: PromQL text in, a DataFrame or Prometheus-shaped result out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..lang.ast import SCALAR, STRING, Expr
from ..lang.parser import parse
from ..errors import BadQuery
from ..operators.vec import Vec
from ..plans.compiler import Compiler, Settings
from ..plans.grid import Grid
from ..sources.store import Store


@dataclass(frozen=True)
class Result:
    kind: str  # vector, matrix or scalar
    vec: Vec

    @property
    def frame(self) -> DataFrame:
        """labels, step_ts, value of every point; ordered only if the query asks for it."""
        df = self.vec.points.join(self.vec.dim, "series_id").select("labels", "step_ts", "value")
        order = self.vec.order
        if order is None:
            return df
        if order[0] == "value":
            value = F.col("value")
            return df.orderBy(F.isnan(value), value.desc() if order[1] else value.asc(), L.key(F.col("labels")), "step_ts")
        keys = [L.natural(L.get(F.col("labels"), name)) for name in order[2]] + [L.key(F.col("labels"))]
        return df.orderBy(*[k.desc() if order[1] else k.asc() for k in keys], "step_ts")

    def flat(self, *names: str) -> DataFrame:
        """The given labels as columns, then step_ts and value."""
        rows = self.vec.mapped(*[F.element_at("labels", n).alias(n) for n in names]) if names else self.vec.points
        return rows.select(*names, "step_ts", "value")

    def sorted(self) -> DataFrame:
        """By series and step, unless the query asks for another order."""
        return self.frame if self.vec.order else self.frame.orderBy(L.key(F.col("labels")), "step_ts")


class Engine:
    def __init__(self, spark: SparkSession, store: Store, settings: Settings = Settings(), routes=None):
        self.spark, self.store, self.settings, self.routes = spark, store, settings, routes

    def _run(self, expr: str | Expr, grid: Grid, kind: str) -> Result:
        tree = parse(expr) if isinstance(expr, str) else expr
        if tree.type == STRING:
            raise BadQuery("a string is not a result")
        compiler = Compiler(self.store, grid, self.spark, self.settings, self.routes if kind == "matrix" else None)
        return Result("scalar" if tree.type == SCALAR and kind == "vector" else kind, compiler.vector(tree))

    def query(self, expr: str, time_ms: int) -> Result:
        return self._run(expr, Grid(time_ms, time_ms, 0), "vector")

    def query_range(self, expr: str, start_ms: int, end_ms: int, step_ms: int) -> Result:
        return self._run(expr, Grid(start_ms, end_ms, step_ms).check(), "matrix")

    def explain(self, expr: str, start_ms: int, end_ms: int, step_ms: int) -> str:
        """The physical plan, in place of a result."""
        df = self.query_range(expr, start_ms, end_ms, step_ms).frame
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
