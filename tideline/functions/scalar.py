"""Value-by-value functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ieee import INF, isinf, nan


def _whole(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """ceil and floor stay doubles, also beyond the range of long."""
    return lambda v: F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise(fn(v).cast("double"))


def _log(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.when(F.isnan(v) | (v < 0), nan()).when(v == 0, F.lit(-INF)).otherwise(fn(v))


def round_to(v: Column, to: Column) -> Column:
    """Half away from zero."""
    x = v / to
    near = F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")
    return F.when(F.isnan(v) | isinf(v) | (F.abs(x) >= 2.0**52), v).otherwise(near * to)


def clamp_min(v: Column, low: Column) -> Column:
    return F.greatest(v, low)


def clamp_max(v: Column, high: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(high), nan()).otherwise(F.least(v, high))


def _asinh(v: Column) -> Column:
    return F.when(isinf(v), v).otherwise(F.asinh(v))


MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "ceil": _whole(F.ceil),
    "floor": _whole(F.floor),
    "sqrt": F.sqrt,
    "exp": F.exp,
    "ln": _log(F.ln),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
    "sgn": lambda v: F.when(F.isnan(v), F.lit(0.0)).when(v > 0, 1.0).when(v < 0, -1.0).otherwise(0.0),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": _asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "deg": lambda v: v * (180 / math.pi),
    "rad": lambda v: v * (math.pi / 180),
}


def _date(v: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(v / 86400).cast("int"))


def _hour(v: Column) -> Column:
    return F.floor(F.pmod(v, F.lit(86400.0)) / 3600)


TIME: dict[str, Callable[[Column], Column]] = {
    "hour": _hour,
    "minute": lambda v: F.floor(F.pmod(v, F.lit(3600.0)) / 60),
    "month": lambda v: F.month(_date(v)),
    "year": lambda v: F.year(_date(v)),
    "day_of_month": lambda v: F.dayofmonth(_date(v)),
    "day_of_week": lambda v: F.dayofweek(_date(v)) - 1,
    "day_of_year": lambda v: F.dayofyear(_date(v)),
    "days_in_month": lambda v: F.dayofmonth(F.last_day(_date(v))),
}
