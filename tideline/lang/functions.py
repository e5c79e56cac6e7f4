"""Signatures of all functions: argument types, how many may be left out, and the result type."""

from __future__ import annotations

from dataclasses import dataclass

from .ast import MATRIX, SCALAR, STRING, VECTOR


@dataclass(frozen=True)
class Signature:
    args: tuple[str, ...]
    optional: int = 0
    variadic: bool = False
    result: str = VECTOR


RANGE = (
    "rate increase delta irate idelta deriv resets changes avg_over_time sum_over_time count_over_time min_over_time max_over_time "
    "last_over_time present_over_time stdvar_over_time stddev_over_time mad_over_time absent_over_time"
).split()
MATH = (
    "abs ceil floor sqrt exp ln log2 log10 sgn sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh deg rad"
).split()
TIME = "timestamp hour minute month year day_of_month day_of_week day_of_year days_in_month".split()

SIGNATURES: dict[str, Signature] = (
    {n: Signature((MATRIX,)) for n in RANGE}
    | {n: Signature((VECTOR,)) for n in (*MATH, "sort", "sort_desc", "absent")}
    | {n: Signature((VECTOR,), optional=n != "timestamp") for n in TIME}
    | {
        "quantile_over_time": Signature((SCALAR, MATRIX)),
        "predict_linear": Signature((MATRIX, SCALAR)),
        "double_exponential_smoothing": Signature((MATRIX, SCALAR, SCALAR)),
        "round": Signature((VECTOR, SCALAR), optional=1),
        "clamp": Signature((VECTOR, SCALAR, SCALAR)),
        "clamp_min": Signature((VECTOR, SCALAR)),
        "clamp_max": Signature((VECTOR, SCALAR)),
        "pi": Signature((), result=SCALAR),
        "time": Signature((), result=SCALAR),
        "scalar": Signature((VECTOR,), result=SCALAR),
        "vector": Signature((SCALAR,)),
        "histogram_quantile": Signature((SCALAR, VECTOR)),
        "label_replace": Signature((VECTOR, STRING, STRING, STRING, STRING)),
        "label_join": Signature((VECTOR, STRING, STRING, STRING), optional=1, variadic=True),
        "sort_by_label": Signature((VECTOR, STRING), variadic=True),
        "sort_by_label_desc": Signature((VECTOR, STRING), variadic=True),
    }
)
AGGREGATORS = "sum avg min max count group stddev stdvar topk bottomk quantile count_values limitk limit_ratio".split()
PARAMETER = {"topk": SCALAR, "bottomk": SCALAR, "quantile": SCALAR, "limitk": SCALAR, "limit_ratio": SCALAR, "count_values": STRING}
