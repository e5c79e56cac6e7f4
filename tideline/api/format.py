"""Results as text: Prometheus JSON, table, CSV; and request values from text."""

from __future__ import annotations

import csv
import io
import json
import math
import re
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import Decimal

from ..errors import BadQuery
from ..rollup.config import duration_ms
from .engine import Result


def float_text(v: float) -> str:
    """NaN, +Inf, -Inf, or the shortest decimal form without an exponent."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    text = format(Decimal(repr(float(v))), "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text == "-0" and math.copysign(1, v) > 0 else text


def label_text(labels: dict[str, str]) -> str:
    return "{" + ",".join(f'{k}="{labels[k]}"' for k in sorted(labels)) + "}"


def rows(result: Result) -> Iterator[tuple[dict, int, float]]:
    """Points in order, a partition at a time."""
    for r in result.sorted().toLocalIterator():
        yield dict(r["labels"] or {}), r["step_ts"], r["value"]


def _series(result: Result) -> Iterator[tuple[dict, list]]:
    own, points = None, []
    order: dict[tuple, tuple[dict, list]] = {}
    for labels, ts, value in rows(result):
        key = tuple(sorted(labels.items()))
        if result.vec.order:  # a requested order may mix the series
            order.setdefault(key, (labels, []))[1].append((ts, value))
            continue
        if own is not None and own[0] != key:
            yield own[1], points
            points = []
        own = key, labels
        points.append((ts, value))
    if own is not None:
        yield own[1], points
    for labels, points in order.values():
        yield labels, sorted(points)


def _seconds(ts: int) -> str:
    return f"{ts / 1000:.3f}"


def json_chunks(result: Result) -> Iterator[str]:
    """The response text in pieces, a series at a time."""
    yield '{"status":"success","data":{"resultType":"%s","result":[' % result.kind
    first = True
    if result.kind == "scalar":
        for _, ts, value in rows(result):
            yield f'{_seconds(ts)},"{float_text(value)}"'
    elif result.kind == "vector":
        for labels, ts, value in rows(result):
            yield ("" if first else ",") + json.dumps({"metric": labels}, ensure_ascii=False)[:-1] + f',"value":[{_seconds(ts)},"{float_text(value)}"]}}'
            first = False
    else:
        for labels, points in _series(result):
            values = ",".join(f'[{_seconds(ts)},"{float_text(v)}"]' for ts, v in points)
            yield ("" if first else ",") + json.dumps({"metric": labels}, ensure_ascii=False)[:-1] + f',"values":[{values}]}}'
            first = False
    yield "]}}"


def _when(ts: int) -> str:
    at = datetime.fromtimestamp(ts / 1000, timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{ts % 1000:03d}" if ts % 1000 else "") + "Z"


def as_json(result: Result) -> str:
    return "".join(json_chunks(result))


def as_csv(result: Result) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["labels", "timestamp", "value"])
    writer.writerows([label_text(labels), _when(ts), float_text(v)] for labels, ts, v in rows(result))
    return out.getvalue()


def as_table(result: Result) -> str:
    table = [("LABELS", "TIMESTAMP", "VALUE")] + [(label_text(labels), _when(ts), float_text(v)) for labels, ts, v in rows(result)]
    wide = [max(len(r[k]) for r in table) for k in range(2)]
    return "".join(f"{a:<{wide[0]}}  {b:<{wide[1]}}  {c}\n" for a, b, c in table)


FORMATS = {"table": as_table, "json": as_json, "csv": as_csv}


def parse_time(text: str, now_ms: int | None = None) -> int:
    """ms from an empty text or now (with + or - a duration), -30m, +5m, unix seconds, RFC 3339 or a date."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    raw = text.strip()
    if raw in ("", "now"):
        return now
    m = re.fullmatch(r"(?:now)?\s*([+-])\s*([0-9].*[a-zµ])", raw)
    if m:
        return now + (1 if m[1] == "+" else -1) * duration_ms(m[2])
    try:
        return round(float(raw) * 1000)
    except ValueError:
        pass
    try:
        at = datetime.fromisoformat(raw)
    except ValueError:
        raise BadQuery(f"cannot parse {text!r} as a time") from None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return round(at.timestamp() * 1000)


def parse_duration(text: str) -> int:
    """ms from 60s, 1h30m, 2d, or float seconds."""
    if not text.strip():
        raise BadQuery("empty duration")
    try:
        return round(float(text) * 1000)
    except ValueError:
        return duration_ms(text)
