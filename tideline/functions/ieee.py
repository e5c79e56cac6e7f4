"""Double arithmetic and comparison with IEEE results where Spark raises, returns NULL or orders NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def nan() -> Column:
    return F.lit(NAN)


def inf() -> Column:
    return F.lit(INF)


def isinf(x: Column) -> Column:
    return F.abs(x) == INF


def div(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), nan()).when((a > 0) == (F.lit(1.0) * F.signum(_sign_of_zero(b)) >= 0), inf()).otherwise(-inf())
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _sign_of_zero(b: Column) -> Column:
    """-1 for -0.0, else 1; the text form is the one place where Spark tells them apart."""
    return F.when(b.cast("string").startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))


def mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, nan()).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def power(a: Column, b: Column) -> Column:
    one = (a == 1) | ((a == -1) & isinf(b))
    return F.when(one, F.lit(1.0)).otherwise(F.pow(a, b))


def compare(op: str, a: Column, b: Column) -> Column:
    sound = ~F.isnan(a) & ~F.isnan(b)
    if op == "!=":
        return ~sound | (a != b)
    plain = {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return sound & plain


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    return {"/": div, "%": mod, "^": power, "atan2": F.atan2}[op](a, b)


def nan_last_max(v: Column) -> Column:
    """Largest of a group; NaN only if all are."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), nan())


def float_text(v: Column) -> Column:
    """Shortest decimal form without an exponent: NaN, +Inf, -Inf, 42, 3.14."""
    text = v.cast("string")
    whole = (F.abs(v) < 1e15) & (v == F.rint(v))
    wide = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    small = F.coalesce(F.when(F.abs(v) >= 1e-7, wide), text)
    return (
        F.when(F.isnan(v), "NaN")
        .when(v == INF, "+Inf")
        .when(v == -INF, "-Inf")
        .when(whole, v.cast("long").cast("string"))
        .when(text.contains("E"), F.coalesce(small, text))
        .otherwise(text)
    )
