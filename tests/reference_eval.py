"""A slow evaluator in plain Python over lists of samples; for tests only."""

from __future__ import annotations

import math

from tideline.lang.ast import Aggregate, Binary, Call, Negate, Number, Selector
from tideline.lang.parser import COMPARISONS

Series = dict  # label tuple -> [(ts, value)]


def _values(data, e, t):
    out = {}
    for labels, samples in data[e.matchers[0].value].items():
        lab = dict(labels)
        if all((lab.get(m.label, "") == m.value) == (m.op == "=") for m in e.matchers[1:]):
            out[labels] = [(ts + e.offset_ms, v) for ts, v in samples]
    return out


def _stale(v):
    return v is None



LOOKBACK = [300_000]


def evaluate(data, e, t, lookback=None):
    """{labels: value} at time t, or a number for a scalar."""
    if lookback is not None:
        LOOKBACK[0] = lookback
    if isinstance(e, Number):
        return e.value
    if isinstance(e, Negate):
        got = evaluate(data, e.inner, t)
        return -got if isinstance(got, float) else {k: -v for k, v in got.items()}
    if isinstance(e, Selector):
        out = {}
        for labels, samples in _values(data, e, t).items():
            own = [(ts, v) for ts, v in samples if t - LOOKBACK[0] <= ts <= t]
            if own and not _stale(own[-1][1]):
                out[labels] = own[-1][1]
        return out
    if isinstance(e, Call):
        return _call(data, e, t)
    if isinstance(e, Aggregate):
        return _aggregate(data, e, t)
    return _binary(data, e, t)


def _call(data, e, t):
    fns = {"abs": abs, "ceil": _keep(math.ceil), "floor": _keep(math.floor), "sqrt": lambda v: math.sqrt(v) if v >= 0 else math.nan}
    if e.name in fns:
        return {k: fns[e.name](v) for k, v in evaluate(data, e.args[0], t).items()}
    m = e.args[0]
    out = {}
    for labels, samples in _values(data, m, t).items():
        own = [(ts, v) for ts, v in samples if t - m.range_ms < ts <= t and not _stale(v)]
        got = _range(e.name, own, t, m.range_ms) if own else None
        if got is not None:
            out[labels] = got
    return out


def _keep(fn):
    return lambda v: v if math.isnan(v) or math.isinf(v) else float(fn(v))


def _range(name, own, t, r):
    vs = [v for _, v in own]
    if name == "sum_over_time":
        return sum(vs)
    if name == "count_over_time":
        return float(len(vs))
    if name == "avg_over_time":
        return sum(vs) / len(vs)
    if name == "min_over_time":
        real = [v for v in vs if not math.isnan(v)]
        return min(real) if real else math.nan
    if name == "max_over_time":
        real = [v for v in vs if not math.isnan(v)]
        return max(real) if real else math.nan
    if name == "last_over_time":
        return vs[-1]
    if name == "resets":
        return float(sum(b < a for a, b in zip(vs, vs[1:])))
    if name == "changes":
        return float(sum(a != b for a, b in zip(vs, vs[1:])))
    if len(own) < 2:
        return None
    if name == "idelta":
        return vs[-1] - vs[-2]
    if name == "irate":
        return (vs[-1] if vs[-1] < vs[-2] else vs[-1] - vs[-2]) / ((own[-1][0] - own[-2][0]) / 1000)
    counter = name != "delta"
    rise = vs[-1] - vs[0] + (sum(a for a, b in zip(vs, vs[1:]) if b < a) if counter else 0)
    start, end = (own[0][0] - (t - r)) / 1000, (t - own[-1][0]) / 1000
    sampled = (own[-1][0] - own[0][0]) / 1000
    gap = sampled / (len(own) - 1)
    if counter and rise > 0 and vs[0] >= 0:
        start = min(start, sampled * vs[0] / rise)
    wide = sampled + (start if start < 1.1 * gap else gap / 2) + (end if end < 1.1 * gap else gap / 2)
    out = rise * wide / sampled
    if name == "rate":
        out /= r / 1000
    return max(out, 0.0) if counter and out < 0 else out


def _aggregate(data, e, t):
    groups = {}
    for labels, v in evaluate(data, e.inner, t).items():
        own = tuple((k, x) for k, x in labels if (k in e.grouping) != e.without)
        groups.setdefault(own, []).append((labels, v))
    fns = {"sum": sum, "min": min, "max": max, "avg": lambda v: sum(v) / len(v), "count": lambda v: float(len(v))}
    if e.op in fns:
        return {k: fns[e.op]([v for _, v in rows]) for k, rows in groups.items()}
    out = {}
    for rows in groups.values():
        ordered = sorted(rows, key=lambda r: (-r[1] if e.op == "topk" else r[1], r[0]))
        out.update(ordered[: int(e.param.value)])
    return out


def _op(op, a, b):
    if op == "/":
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
        return a / b
    if op == "%":
        return math.nan if b == 0 else math.fmod(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _cmp(op, a, b):
    return {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def _binary(data, e, t):
    left, right = evaluate(data, e.left, t), evaluate(data, e.right, t)
    m = e.matching

    def key(labels):
        return tuple((k, v) for k, v in labels if (k in m.labels) == m.on)

    if isinstance(left, float) or isinstance(right, float):
        out = {}
        for labels, v in (right if isinstance(left, float) else left).items():
            a, b = (left, v) if isinstance(left, float) else (v, right)
            if e.op not in COMPARISONS:
                out[labels] = _op(e.op, a, b)
            elif e.bool_modifier:
                out[labels] = float(_cmp(e.op, a, b))
            elif _cmp(e.op, a, b):
                out[labels] = v
        return out
    if e.op in ("and", "or", "unless"):
        lk, rk = {key(k) for k in left}, {key(k) for k in right}
        if e.op == "or":
            return left | {k: v for k, v in right.items() if key(k) not in lk}
        return {k: v for k, v in left.items() if (key(k) in rk) == (e.op == "and")}
    by = {key(k): v for k, v in right.items()}
    out = {}
    for labels, a in left.items():
        own = key(labels)
        if own in by:
            if e.op in COMPARISONS:
                if e.bool_modifier:
                    out[own] = float(_cmp(e.op, a, by[own]))
                elif _cmp(e.op, a, by[own]):
                    out[own] = a
            else:
                out[own] = _op(e.op, a, by[own])
    return out
