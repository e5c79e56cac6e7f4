"""Label maps: canonical keys, projections, rewriting, fingerprints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadQuery

EMPTY = "map()"


def empty() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def clean(labels: Column) -> Column:
    """An empty label is the same as none."""
    return F.map_filter(labels, lambda k, v: v != "")


def key(labels: Column) -> Column:
    """A text that is equal exactly for equal label sets."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("\u0000"), e["value"]))
    return F.array_join(parts, "\u0001")


def series_id(labels: Column) -> Column:
    return F.xxhash64(key(labels))


def keep(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(*names) & (v != "")) if names else empty()


def drop(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(*names)) if names else labels


def put(labels: Column, name: str, value: Column) -> Column:
    """labels with one label set, or removed if the value is empty."""
    rest = drop(labels, (name,))
    return F.when(F.coalesce(value, F.lit("")) == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def get(labels: Column, name: str) -> Column:
    return F.coalesce(F.element_at(labels, name), F.lit(""))


def java_pattern(pattern: str) -> str:
    """A fully anchored Java pattern for an RE2 one."""
    return "^(?s:" + re.sub(r"\(\?P<", "(?<", pattern) + ")\\z"


def matches(value: Column, op: str, want: str) -> Column:
    """One matcher; a missing label counts as the empty text. Plain comparisons stay plain, so that a scan can use them."""
    if op == "=" and want:
        return value == want
    v = F.coalesce(value, F.lit(""))
    if op == "=":
        return v == want
    if op == "!=":
        return v != want
    found = v.rlike(java_pattern(want))
    return found if op == "=~" else ~found


_REFERENCE = re.compile(r"\$(?:(\w+)|\{(\w+)\}|\$)")


def expand(source: Column, pattern: str, template: str) -> Column:
    """The template with $1, ${1} and ${name} filled from a match of the whole source."""
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise BadQuery(f"bad regular expression {pattern!r}: {e}") from None
    anchored, parts, at = java_pattern(pattern), [], 0
    for m in _REFERENCE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        name = m[1] or m[2]
        if name is None:
            parts.append(F.lit("$"))
            continue
        index = int(name) if name.isdigit() else compiled.groupindex.get(name, -1)
        if 0 <= index <= compiled.groups:
            parts.append(F.coalesce(F.regexp_extract(source, anchored, index), F.lit("")))
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def replace(labels: Column, dst: str, template: str, src: str, pattern: str) -> Column:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", dst):
        raise BadQuery(f"bad label name {dst!r}")
    source = get(labels, src)
    return F.when(source.rlike(java_pattern(pattern)), put(labels, dst, expand(source, pattern, template))).otherwise(labels)


def join(labels: Column, dst: str, sep: str, sources: tuple[str, ...]) -> Column:
    value = F.array_join(F.array(*[get(labels, s) for s in sources]), sep) if sources else F.lit("")
    return put(labels, dst, value)


def natural(value: Column) -> Column:
    """A text whose plain order is the natural order: runs of digits are compared as numbers."""
    runs = F.regexp_extract_all(value, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    return F.array_join(
        F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(r)).cast("string"), 6, "0"), digits(r))).otherwise(r)), ""
    )


def label_text(labels: Column) -> Column:
    """{k="v",...} in label order."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def fingerprint_bytes(labels: dict[str, str]) -> bytes:
    return b"".join(k.encode() + b"\xff" + labels[k].encode() + b"\xff" for k in sorted(labels, key=str.encode))


def fingerprint(labels: dict[str, str]) -> int:
    """XXH64 (seed 0) of the sorted labels, as an unsigned number."""
    import xxhash

    return xxhash.xxh64_intdigest(fingerprint_bytes(labels))


def ratio_offset(entries: Column) -> Column:
    """Each series' fixed place in [0, 1]: its fingerprint over the largest. Runs on label sets only, never on samples."""

    @F.pandas_udf("double")
    def place(rows: pd.Series) -> pd.Series:
        return rows.map(lambda es: fingerprint({e["key"]: e["value"] for e in es}) / float(2**64 - 1))

    return place(F.map_entries(entries))
