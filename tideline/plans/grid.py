"""The steps a query is evaluated at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadQuery

MAX_POINTS = 11_000


@dataclass(frozen=True)
class Grid:
    """start, start + step, ... up to end, in ms. One step at end if step is not positive or start is after end."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if self.step <= 0 or self.start > self.end:
            object.__setattr__(self, "start", self.end)
            object.__setattr__(self, "step", 1)

    @property
    def last(self) -> int:
        """The number of the last step; the first is 0."""
        return (self.end - self.start) // self.step

    @property
    def steps(self) -> list[int]:
        return [self.start + k * self.step for k in range(self.last + 1)]

    def check(self, most: int = MAX_POINTS) -> "Grid":
        if self.last > most:
            raise BadQuery(f"exceeded maximum resolution of {most:,} points per series; use a larger step")
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.last + 1).select((F.col("id") * self.step + self.start).alias("step_ts"))

    def at(self, k: Column) -> Column:
        return k * F.lit(self.step).cast("long") + F.lit(self.start).cast("long")

    def first_not_before(self, ts: Column) -> Column:
        """Number of the first step at or after ts, not below 0."""
        return F.greatest(F.lit(0).cast("long"), F.floor((ts - self.start + self.step - 1) / self.step).cast("long"))

    def last_not_after(self, ts: Column) -> Column:
        """Number of the last step at or before ts, not above the last."""
        return F.least(F.lit(self.last).cast("long"), F.floor((ts - self.start) / self.step).cast("long"))


