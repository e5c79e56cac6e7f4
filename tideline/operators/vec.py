"""What flows between operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


@dataclass(frozen=True)
class Vec:
    """One value for each (series, step): points(series_id, step_ts, value), and dim(series_id, labels).

    Label work happens on dim, which has a row for each series; only ids travel with the points. `order` is a request for the result's order.
    """

    points: DataFrame
    dim: DataFrame
    order: tuple | None = None

    def map(self, value: Column) -> "Vec":
        return replace(self, points=self.points.select("series_id", "step_ts", value.alias("value")))

    def relabel(self, labels: Column) -> "Vec":
        """New labels, and ids that follow from them."""
        to = self.dim.select("series_id", labels.alias("to")).select("series_id", L.series_id(F.col("to")).alias("new_id"), "to")
        points = self.points.join(to.select("series_id", "new_id"), "series_id").select(F.col("new_id").alias("series_id"), "step_ts", "value")
        dim = to.select(F.col("new_id").alias("series_id"), F.col("to").alias("labels")).dropDuplicates(["series_id"])
        return replace(self, points=points, dim=dim)

    def mapped(self, *columns: Column) -> DataFrame:
        """The points with columns that are computed once for each series."""
        return self.points.join(self.dim.select("series_id", *columns), "series_id")


@dataclass(frozen=True)
class Scalar:
    """A number, or a number for each step: frame(step_ts, scalar)."""

    number: float | None = None
    frame: DataFrame | None = None

    def attach(self, df: DataFrame, name: str = "scalar") -> tuple[DataFrame, Column]:
        """df and a column that holds the scalar at each row's step."""
        if self.frame is None:
            return df, F.lit(float(self.number))
        return df.join(self.frame.withColumnRenamed("scalar", name), "step_ts"), F.col(name)
