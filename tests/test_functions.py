"""Literal vectors for single operators."""

import math

import pytest

from tests.util import instant, ranged

NONE = ()


def one(spark, samples, expr, t):
    return instant(spark, {"m": {NONE: samples}}, expr, t).get(NONE)


@pytest.mark.parametrize(
    "samples, expr, t, want",
    [
        ([(1000, 0), (16000, 10), (31000, 20), (46000, 30)], "rate(m[1m])", 60000, 30 * (59 / 45) / 60),
        ([(0, 90), (15000, 100), (30000, 10), (45000, 20)], "rate(m[61s])", 60000, 30 * ((45 + 1 + 15) / 45) / 61),
        ([(0, 100), (60000, 200)], "increase(m[61s])", 60000, 100 * 61 / 60),
        ([(0, 100), (60000, 50)], "delta(m[61s])", 60000, -50 * 61 / 60),
        ([(0, 100)], "rate(m[1m])", 30000, None),
        ([(1000, 0), (2000, 0), (3000, 0)], "rate(m[1m])", 30000, 0.0),
        ([(0, 100), (15000, 115)], "irate(m[1m])", 15000, 1.0),
        ([(0, 100), (15000, 10)], "irate(m[1m])", 15000, 10 / 15),
        ([(1000, 1), (2000, 2), (3000, 3)], "m", 3000, 3.0),
        ([(1000, 1)], "m", 302000, None),
        ([(1000, 1)], "m", 301000, 1.0),
        ([(1000, 1), (2000, None)], "m", 3000, None),
        ([(1000, 1), (2000, None)], "last_over_time(m[1m])", 3000, 1.0),
        ([(k, k) for k in (1000, 2000, 3000, 4000)], "count_over_time(m[2s])", 3500, 2.0),
        ([(1, 1), (2, 2), (3, 3)], "avg_over_time(m[1m])", 10, 2.0),
        ([(k, v) for k, v in enumerate((2, 4, 4, 4, 5, 5, 7, 9))], "stddev_over_time(m[1m])", 10, 2.0),
        ([(k, k + 1) for k in range(5)], "quantile_over_time(0.5, m[1m])", 10, 3.0),
        ([(k, k + 1) for k in range(5)], "quantile_over_time(0, m[1m])", 10, 1.0),
        ([(k, k + 1) for k in range(5)], "quantile_over_time(2, m[1m])", 10, math.inf),
        ([(k, v) for k, v in enumerate((1, 1, 2, 2, 4, 6, 9))], "mad_over_time(m[1m])", 10, 1.0),
        ([(k * 1000, k) for k in range(4)], "deriv(m[1m])", 3000, 1.0),
        ([(k * 1000, 5) for k in range(4)], "deriv(m[1m])", 3000, 0.0),
        ([(k * 1000, k) for k in range(3)], "predict_linear(m[1m], 10)", 2000, 12.0),
        ([(k, v) for k, v in enumerate((1, 5, 3, 6, 2))], "resets(m[1m])", 10, 2.0),
        ([(k, v) for k, v in enumerate((1, 1, 2, 2, 3))], "changes(m[1m])", 10, 2.0),
        ([(1, math.nan), (2, math.nan)], "changes(m[1m])", 10, 1.0),
        ([(1, math.nan), (2, 3)], "max_over_time(m[1m])", 10, 3.0),
        ([(1, 1), (2, 3), (3, 2)], "double_exponential_smoothing(m[1m], 0.5, 0.5)", 10, 3.5),
        ([(1, -7)], "clamp_max(abs(m), 5)", 10, 5.0),
        ([(1, 5)], "clamp(m, 7, 3)", 10, 7.0),
        ([(1, -2.5)], "round(m)", 10, -3.0),
        ([(1, 1.3)], "round(m, 0.5)", 10, 1.5),
        ([(1, 0)], "ln(m)", 10, -math.inf),
        ([(1, 4)], "m / 0", 10, math.inf),
        ([(1, -4)], "m / 0", 10, -math.inf),
        ([(1, 1e300)], "floor(m)", 10, 1e300),
        ([(1, 4)], "2 ^ m % 7", 10, 2.0),
        ([(1, 4)], "-m", 10, -4.0),
        ([(1, 5)], "3 < m", 10, 5.0),
        ([(1, 5)], "9 < m", 10, None),
        ([(1, 5)], "m > bool 9", 10, 0.0),
        ([(1, 5)], "m and vector(1)", 10, 5.0),
        ([(1, 5)], "scalar(m) + 1", 10, 6.0),
        ([(5000, 5)], "timestamp(m)", 10000, 5.0),
        ([(5000, 5)], "m offset 5s", 10000, 5.0),
        ([(5000, 5)], "absent(m)", 10000, None),
        ([(5000, 5)], "absent(m)", 4000, 1.0),
        ([(5000, 5)], "sum(m) or vector(0)", 4000, 0.0),
    ],
)
def test_vector(spark, samples, expr, t, want):
    got = one(spark, samples, expr, t)
    assert got == want if want is None else got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("expr", ["m % 0", "sqrt(m - 10)", "m / 0 - m / 0", "clamp_max(m * NaN, 1)"])
def test_nan(spark, expr):
    assert math.isnan(one(spark, [(1, 5)], expr, 10))


def test_nan_compares_false(spark):
    assert one(spark, [(1, math.nan)], "m == m", 10) is None
    assert math.isnan(one(spark, [(1, math.nan)], "m != m", 10))
    assert one(spark, [(1, math.nan)], "m > bool 1", 10) == 0.0


def hist(*pairs):
    return {"m": {(("le", le),): [(1, c)] for le, c in pairs}}


@pytest.mark.parametrize(
    "pairs, q, want",
    [
        ((("0.1", 10), ("0.5", 50), ("1", 90), ("+Inf", 100)), 0.5, 0.5),
        ((("0.5", 100), ("1", 50), ("+Inf", 100)), 0.5, 0.25),
        ((("1", 100),), 0.5, math.nan),
        ((("1", 0), ("+Inf", 0)), 0.5, math.nan),
        ((("1", 1), ("+Inf", 10)), 0.9, 1.0),
        ((("-1", 5), ("+Inf", 10)), 0.1, -1.0),
        ((("1", 1), ("+Inf", 1)), -1, -math.inf),
        ((("1", 1), ("+Inf", 1)), 2, math.inf),
        ((("1", 1), ("1.0", 1), ("+Inf", 4)), 0.25, 0.5),
    ],
)
def test_histogram(spark, pairs, q, want):
    got = instant(spark, hist(*pairs), f"histogram_quantile({q}, m)", 10)[NONE]
    assert math.isnan(got) if math.isnan(want) else got == pytest.approx(want)


JOBS = {
    "m": {
        (("i", "1"), ("job", "api")): [(1, 10)],
        (("i", "2"), ("job", "api")): [(1, 20)],
        (("i", "3"), ("job", "web")): [(1, 110)],
        (("i", "4"), ("job", "db")): [(1, 5)],
    }
}


@pytest.mark.parametrize(
    "expr, want",
    [
        ("sum by (job) (m)", {(("job", "api"),): 30, (("job", "web"),): 110, (("job", "db"),): 5}),
        ("sum without (i) (m)", {(("job", "api"),): 30, (("job", "web"),): 110, (("job", "db"),): 5}),
        ("topk(2, sum by (job) (m))", {(("job", "web"),): 110, (("job", "api"),): 30}),
        ("topk by (job) (1, m)", {(("i", "2"), ("job", "api")): 20, (("i", "3"), ("job", "web")): 110, (("i", "4"), ("job", "db")): 5}),
        ("bottomk(1, m)", {(("i", "4"), ("job", "db")): 5}),
        ("limitk(1, m)", {(("i", "1"), ("job", "api")): 10}),
        ("count_values(\"v\", m)", {(("v", "10"),): 1, (("v", "20"),): 1, (("v", "110"),): 1, (("v", "5"),): 1}),
        ("quantile(0.5, m)", {NONE: 15}),
        ("stddev(m * 0)", {NONE: 0}),
        ("sum(abs(-m))", {NONE: 145}),
        ("m and on(job) m{i=\"1\"}", {(("i", "1"), ("job", "api")): 10, (("i", "2"), ("job", "api")): 20}),
        ("m unless on(job) m{i=\"1\"}", {(("i", "3"), ("job", "web")): 110, (("i", "4"), ("job", "db")): 5}),
        ("m{job=~\"a|api\"} / on(job) group_left() sum by (job) (m)", {(("i", "1"), ("job", "api")): 1 / 3, (("i", "2"), ("job", "api")): 2 / 3}),
        ("m{missing=\"\",i!~\"[12]\"}", {(("i", "3"), ("job", "web")): 110, (("i", "4"), ("job", "db")): 5}),
        ('label_replace(m{i="1"}, "x", "$1!${last}", "job", "(a)p(?P<last>i)")', {(("i", "1"), ("job", "api"), ("x", "a!i")): 10}),
        ('label_replace(m{i="1"}, "i", "", "job", ".*")', {(("job", "api"),): 10}),
        ('label_join(m{i="1"}, "x", "-", "job", "i", "none")', {(("i", "1"), ("job", "api"), ("x", "api-1-")): 10}),
        ('absent(m{job="none",i=~"x.*"})', {(("job", "none"),): 1}),
    ],
)
def test_labels(spark, expr, want):
    got = instant(spark, JOBS, expr, 10)
    assert got == pytest.approx(want)


def test_limit_ratio_halves_are_complements(spark):
    part = instant(spark, JOBS, "limit_ratio(0.5, m)", 10)
    rest = instant(spark, JOBS, "limit_ratio(-0.5, m)", 10)
    assert set(part) | set(rest) == set(JOBS["m"]) and not set(part) & set(rest)


def test_many_to_many_fails(spark):
    with pytest.raises(Exception, match="many-to-many"):
        instant(spark, JOBS, "sum by (job) (m) + on(job) m", 10)


def test_order(spark):
    from tests.util import engine

    e = engine(spark, JOBS)
    assert [r["value"] for r in e.query("sort_desc(m)", 10).frame.collect()] == [110, 20, 10, 5]
    names = {"m": {(("n", n),): [(1, 1)] for n in ("a10", "a9", "a1")}}
    got = engine(spark, names).query('sort_by_label(m, "n")', 10).frame.collect()
    assert [r["labels"]["n"] for r in got] == ["a1", "a9", "a10"]


def test_bucket_plan_equals_sample_plan(spark):
    import random

    rng = random.Random(5)
    data = {"m": {(("a", str(k)),): [(t * 700 + k, rng.randrange(20)) for t in range(-30, 120) if rng.random() < 0.7] for k in range(3)}}
    for fn in ("rate", "increase", "delta", "resets", "changes", "avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "last_over_time", "count_over_time"):
        a = ranged(spark, data, f"{fn}(m[20s])", 0, 60000, 2000, range_plan="samples")
        b = ranged(spark, data, f"{fn}(m[20s])", 0, 60000, 2000, range_plan="buckets")
        assert a.keys() == b.keys() and len(a) > 50, fn
        assert all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a), fn


def test_subquery_and_at(spark):
    data = {"m": {NONE: [(k * 1000, k) for k in range(100)]}}
    assert instant(spark, data, "max_over_time(sum_over_time(m[2s])[10s:5s])", 52000)[NONE] == 49 + 50
    got = ranged(spark, data, "m @ 10", 20000, 24000, 2000)
    assert set(got.values()) == {10.0} and len(got) == 3


def test_grid_limits(spark):
    from tests.util import engine
    from tideline.errors import BadQuery
    from tideline.plans.grid import Grid

    assert Grid(0, 5, 0).steps == [5] and Grid(9, 5, 1).steps == [5] and Grid(0, 300_000, 60_000).last == 5
    with pytest.raises(BadQuery):
        engine(spark, JOBS).query_range("m", 0, 12_000_000, 1000)
