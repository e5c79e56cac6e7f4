"""The registered queries: an expression over the tables' metrics, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demo
from .demo import SQL, T0

H, D = 3_600_000, 86_400_000
EVENTS = (T0, T0 + 30 * D, 6 * H)
HOURS = (T0, T0 + 30 * D, H)
ORDERS = (788_918_400_000, 788_918_400_000 + 2405 * D, D)  # from 1995-01-01
SHIPPED = (788_918_400_000, 788_918_400_000 + 2560 * D, D)
AT = (T0, T0, 0)
LOOK = 300_000


@dataclass(frozen=True)
class Query:
    expr: str
    labels: tuple[str, ...]
    grid: tuple[int, int, int]
    sql: str | None
    digits: int = 6

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        found = demo.engine(spark, sf_dir).query_range(self.expr, *self.grid)
        return found.flat(*self.labels).withColumn("value", F.round("value", self.digits) + F.lit(0.0))

    @property
    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = "".join(f'"{c}", ' for c in self.labels)
        return f"WITH {self.sql} SELECT {cols}step_ts, round(value, {self.digits}) + 0.0 AS value FROM result"


def _grid(grid: tuple[int, int, int]) -> str:
    start, end, step = grid
    return f"g AS (SELECT CAST(unnest(generate_series({start}, {end}, {max(step, 1)})) AS BIGINT) AS step_ts)"


def _list(labels: tuple[str, ...]) -> str:
    return "".join(f"{c}, " for c in labels)


def instant(name: str, metric: str, labels: tuple[str, ...], grid: tuple, where: str = "TRUE", offset: int = 0) -> str:
    """A CTE `name` with the newest sample in the lookback at each step."""
    own = _list(labels)
    return (
        f"s_{name} AS (SELECT * FROM ({SQL[metric]}) WHERE {where}), g_{name} AS (SELECT * FROM ({_inner(grid)})), "
        f"{name} AS (SELECT {own}step_ts, arg_max(value, ts) AS value FROM s_{name} JOIN g_{name} "
        f"ON ts + {offset} >= step_ts - {LOOK} AND ts + {offset} <= step_ts GROUP BY {own}step_ts)"
    )


def _inner(grid: tuple) -> str:
    return _grid(grid)[6:-1]


def window(metric: str, labels: tuple[str, ...], grid: tuple, range_ms: int) -> str:
    """A CTE `w` with every sample of every step's range; pv and pt are the previous sample of the series, if it is in the range too."""
    part = ", ".join(labels)
    return (
        f"s AS (SELECT *, lag(value) OVER p AS lv, lag(ts) OVER p AS lt FROM ({SQL[metric]}) WINDOW p AS (PARTITION BY {part} ORDER BY ts)), "
        f"{_grid(grid)}, w AS (SELECT s.*, step_ts, CASE WHEN lt > step_ts - {range_ms} THEN lv END AS pv, CASE WHEN lt > step_ts - {range_ms} THEN lt END AS pt "
        f"FROM s JOIN g ON ts > step_ts - {range_ms} AND ts <= step_ts)"
    )


def over_time(metric: str, labels: tuple[str, ...], grid: tuple, range_ms: int, agg: str, having: str = "TRUE", name: str = "result") -> str:
    own = _list(labels)
    return f"{window(metric, labels, grid, range_ms)}, {name} AS (SELECT {own}step_ts, {agg} AS value FROM w GROUP BY {own}step_ts HAVING {having})"


def rate(metric: str, labels: tuple[str, ...], grid: tuple, range_ms: int, counter: bool = True, per_second: bool = True, name: str = "result") -> str:
    own = _list(labels)
    corr = "coalesce(sum(CASE WHEN value < pv THEN pv END), 0)" if counter else "0"
    zero = "CASE WHEN rise > 0 AND v0 >= 0 THEN least(ds0, sampled * (v0 / rise)) ELSE ds0 END" if counter else "ds0"
    scale = f" / {range_ms / 1000.0}" if per_second else ""
    return (
        f"{window(metric, labels, grid, range_ms)}, e AS (SELECT {own}step_ts, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(value, ts) AS v0, "
        f"arg_max(value, ts) - arg_min(value, ts) + {corr} AS rise FROM w GROUP BY {own}step_ts HAVING count(*) >= 2), "
        f"f AS (SELECT *, (t1 - t0) / 1000.0 AS sampled, (t1 - t0) / 1000.0 / (n - 1) AS gap, (t0 - (step_ts - {range_ms})) / 1000.0 AS ds0, (step_ts - t1) / 1000.0 AS de FROM e), "
        f"h AS (SELECT *, {zero} AS ds FROM f), {name} AS (SELECT {own}step_ts, rise * ((sampled + CASE WHEN ds < gap * 1.1 THEN ds ELSE gap / 2 END + "
        f"CASE WHEN de < gap * 1.1 THEN de ELSE gap / 2 END) / sampled){scale} AS value FROM h)"
    )


ET = ("event_type",)
EU = ("event_type", "user_id")
OP = ("o_orderpriority", "o_orderstatus")
LI = ("l_returnflag", "l_linestatus")
CB = ("custkey", "mktsegment", "nation")
V_E = instant("v", "events_value", ET, HOURS)
V_L = instant("v", "lineitem_daily", LI, SHIPPED)
V_C = instant("v", "customer_balance", CB, AT)
V_U = instant("v", "events_user_value", EU, HOURS)


def _over(fn: str, agg: str, having: str = "TRUE", metric: str = "events_value", range_ms: int = 12 * H, args: str = "{m}", digits: int = 6) -> Query:
    expr = f"{fn}({args.format(m=f'{metric}[{range_ms // H}h]')})"
    return Query(expr, ET, EVENTS, over_time(metric, ET, EVENTS, range_ms, agg, having), digits)


def _agg(op: str, value: str) -> Query:
    return Query(
        f"{op} by (l_returnflag) (lineitem_daily)",
        ("l_returnflag",),
        SHIPPED,
        f"{V_L}, result AS (SELECT l_returnflag, step_ts, {value} AS value FROM v GROUP BY 1, 2)",
    )


def _math(expr: str, value: str, where: str = "TRUE", digits: int = 6) -> Query:
    return Query(expr, ET, HOURS, f"{V_E}, result AS (SELECT event_type, step_ts, {value} AS value FROM v WHERE {where})", digits)


def _tight(fn: str, sql: str) -> Query:
    """A function of a value that is squeezed between 0 and 1 first."""
    return _math(f"{fn}(events_value / (events_value + 1))", f"{sql}(value / (value + 1))", digits=5)


def _pair(expr: str, value: str, op: str = "") -> Query:
    """Orders of status F against those of status O, by priority."""
    left = instant("l", "orders_daily", OP, ORDERS, "o_orderstatus = 'F'")
    right = instant("r", "orders_daily", OP, ORDERS, "o_orderstatus = 'O'")
    result = f"result AS (SELECT l.o_orderpriority, l.step_ts, {value} AS value FROM l JOIN r USING (o_orderpriority, step_ts){op})"
    return Query(expr.format(f='orders_daily{o_orderstatus="F"}', o='orders_daily{o_orderstatus="O"}'), ("o_orderpriority",), ORDERS, f"{left}, {right}, {result}", 4)


def _set(op: str, sql: str) -> Query:
    left = instant("l", "orders_daily", OP, ORDERS, "o_orderstatus = 'F'")
    right = instant("r", "orders_daily", OP, ORDERS, "o_orderstatus = 'P'")
    expr = f'orders_daily{{o_orderstatus="F"}} {op} ignoring(o_orderstatus) orders_daily{{o_orderstatus="P"}}'
    return Query(expr, OP, ORDERS, f"{left}, {right}, result AS ({sql})", 4)


_BUCKETS = window("events_value_bucket", ("event_type", "le"), EVENTS, 24 * H)
_BOUND = "CASE le WHEN '+Inf' THEN 'inf'::DOUBLE ELSE CAST(le AS DOUBLE) END"


def _histogram(group: str) -> str:
    """The quantile from rising buckets: b holds (group, step_ts, le, c) with numeric le."""
    own = f"{group}, " if group else ""
    part = f"PARTITION BY {own}step_ts"
    return (
        f"o AS (SELECT *, lag(c) OVER o AS pc, lag(le) OVER o AS ple, max(c) OVER (PARTITION BY {own}step_ts) AS total FROM b WINDOW o AS ({part} ORDER BY le)), "
        f"k AS (SELECT *, row_number() OVER ({part} ORDER BY le) AS rn FROM o WHERE total > 0 AND c >= 0.9 * total), "
        f"result AS (SELECT {own}step_ts, CASE WHEN le = 'inf'::DOUBLE THEN ple ELSE coalesce(ple, 0) + (le - coalesce(ple, 0)) * ((0.9 * total - coalesce(pc, 0)) / (c - coalesce(pc, 0))) END AS value FROM k WHERE rn = 1)"
    )


def _defs() -> dict[str, Query]:
    first = "row_number() OVER (PARTITION BY step_ts ORDER BY "
    q: dict[str, Query] = {}
    # selectors
    q["instant_selector"] = Query("events_value", ET, HOURS, f"{instant('result', 'events_value', ET, HOURS)}")
    q["matcher_eq"] = Query('events_value{event_type="click"}', ET, HOURS, instant("result", "events_value", ET, HOURS, "event_type = 'click'"))
    q["matcher_ne"] = Query('events_value{event_type!="click"}', ET, HOURS, instant("result", "events_value", ET, HOURS, "event_type <> 'click'"))
    q["matcher_re"] = Query('events_value{event_type=~".*[ei]"}', ET, HOURS, instant("result", "events_value", ET, HOURS, "regexp_full_match(event_type, '.*[ei]')"))
    q["matcher_nre"] = Query('events_value{event_type!~".*[ei]"}', ET, HOURS, instant("result", "events_value", ET, HOURS, "NOT regexp_full_match(event_type, '.*[ei]')"))
    q["matcher_name"] = Query('{__name__=~"events_val.e"}', ET, HOURS, instant("result", "events_value", ET, HOURS))
    q["offset"] = Query("events_value offset 90m", ET, HOURS, instant("result", "events_value", ET, HOURS, offset=90 * 60_000))
    q["offset_negative"] = Query("events_value offset -1h", ET, HOURS, instant("result", "events_value", ET, HOURS, offset=-H))
    q["at_modifier"] = Query(
        f"lineitem_daily @ {788_918_400 + 86_400 * 900}",
        LI,
        SHIPPED,
        f"{instant('v', 'lineitem_daily', LI, (788_918_400_000 + 900 * D,) * 2 + (0,))}, {_grid(SHIPPED)}, result AS (SELECT l_returnflag, l_linestatus, g.step_ts, value FROM v CROSS JOIN g)",
    )
    q["unary_minus"] = _math("-events_value", "-value")
    # range functions
    q["rate"] = Query(
        "sum by (event_type) (rate(events_total[6h]))",
        ET,
        EVENTS,
        f"{rate('events_total', ET, EVENTS, 6 * H, name='r')}, result AS (SELECT event_type, step_ts, sum(value) AS value FROM r GROUP BY 1, 2)",
        9,
    )
    q["rate_resets"] = Query("rate(events_reset_total[12h])", ET, EVENTS, rate("events_reset_total", ET, EVENTS, 12 * H), 9)
    q["rate_many_steps"] = Query("rate(events_reset_total[24h])", ET, HOURS, rate("events_reset_total", ET, HOURS, 24 * H), 9)
    q["increase"] = Query("increase(events_reset_total[12h])", ET, EVENTS, rate("events_reset_total", ET, EVENTS, 12 * H, per_second=False))
    q["delta"] = Query("delta(events_value[12h])", ET, EVENTS, rate("events_value", ET, EVENTS, 12 * H, False, False))
    last2 = "max(ts) AS t1, arg_max(value, ts) AS v1, arg_max(pv, ts) AS v2, arg_max(pt, ts) AS t2 FROM w GROUP BY event_type, step_ts HAVING count(*) >= 2"
    q["irate"] = Query(
        "irate(events_reset_total[12h])",
        ET,
        EVENTS,
        f"{window('events_reset_total', ET, EVENTS, 12 * H)}, e AS (SELECT event_type, step_ts, {last2}), result AS (SELECT event_type, step_ts, CASE WHEN v1 < v2 THEN v1 ELSE v1 - v2 END / ((t1 - t2) / 1000.0) AS value FROM e WHERE t1 > t2)",
        9,
    )
    q["idelta"] = Query(
        "idelta(events_value[12h])",
        ET,
        EVENTS,
        f"{window('events_value', ET, EVENTS, 12 * H)}, e AS (SELECT event_type, step_ts, {last2}), result AS (SELECT event_type, step_ts, v1 - v2 AS value FROM e)",
    )
    x = "(ts - step_ts) / 1000.0"
    two = "count(*) >= 2"
    q["deriv"] = _over("deriv", f"CASE WHEN min(value) = max(value) THEN 0 ELSE regr_slope(value, {x}) END", two, digits=7)
    q["predict_linear"] = _over("predict_linear", f"regr_intercept(value, {x}) + regr_slope(value, {x}) * 3600", two, args="{m}, 3600", digits=5)
    q["resets"] = _over("resets", "CAST(sum(CASE WHEN value < pv THEN 1 ELSE 0 END) AS DOUBLE)", metric="events_reset_total")
    q["changes"] = _over("changes", "CAST(sum(CASE WHEN value <> pv THEN 1 ELSE 0 END) AS DOUBLE)")
    q["avg_over_time"] = _over("avg_over_time", "avg(value)")
    q["sum_over_time"] = _over("sum_over_time", "sum(value)")
    q["count_over_time"] = _over("count_over_time", "CAST(count(*) AS DOUBLE)")
    q["min_over_time"] = _over("min_over_time", "min(value)")
    q["max_over_time"] = _over("max_over_time", "max(value)")
    q["last_over_time"] = _over("last_over_time", "arg_max(value, ts)")
    q["present_over_time"] = _over("present_over_time", "1.0::DOUBLE")
    q["stdvar_over_time"] = _over("stdvar_over_time", "var_pop(value)", digits=5)
    q["stddev_over_time"] = _over("stddev_over_time", "stddev_pop(value)")
    q["quantile_over_time"] = _over("quantile_over_time", "quantile_cont(value, 0.9)", args="0.9, {m}")
    q["mad_over_time"] = _over("mad_over_time", "mad(value)")
    q["smoothing"] = Query(
        "double_exponential_smoothing(events_value[24h], 0.5, 0.3)",
        ET,
        EVENTS,
        f"{window('events_value', ET, EVENTS, 24 * H)}, l AS (SELECT event_type, step_ts, list(value ORDER BY ts) AS v FROM w GROUP BY 1, 2 HAVING count(*) >= 2), "
        "m AS (SELECT event_type, step_ts, list_transform(v, lambda x: {'l': x, 'b': v[2] - v[1]}) AS s FROM l), "
        "result AS (SELECT event_type, step_ts, list_reduce(s, lambda a, x: {'l': 0.5 * x.l + 0.5 * (a.l + a.b), 'b': 0.3 * (0.5 * x.l + 0.5 * (a.l + a.b) - a.l) + 0.7 * a.b}).l AS value FROM m)",
    )
    q["subquery"] = Query(
        "max_over_time(sum_over_time(events_value[6h])[24h:6h])",
        ET,
        EVENTS,
        f"{over_time('events_value', ET, (T0 - 18 * H, T0 + 30 * D, 6 * H), 6 * H, 'sum(value)', name='i')}, "
        f"x AS (SELECT * FROM ({_inner(EVENTS)})), result AS (SELECT event_type, x.step_ts, max(value) AS value FROM i JOIN x ON i.step_ts > x.step_ts - {24 * H} AND i.step_ts <= x.step_ts GROUP BY 1, 2)",
    )
    # aggregation
    for op, sql in {
        "sum": "sum(value)",
        "avg": "avg(value)",
        "min": "min(value)",
        "max": "max(value)",
        "count": "CAST(count(*) AS DOUBLE)",
        "group": "1.0::DOUBLE",
        "stddev": "stddev_pop(value)",
        "stdvar": "var_pop(value)",
    }.items():
        q[f"{op}_by"] = _agg(op, sql)
    q["sum_all"] = Query("sum(customer_balance)", (), AT, f"{V_C}, result AS (SELECT step_ts, sum(value) AS value FROM v GROUP BY 1)", 3)
    q["sum_without"] = Query(
        "sum without (custkey, nation) (customer_balance)",
        ("mktsegment",),
        AT,
        f"{V_C}, result AS (SELECT mktsegment, step_ts, sum(value) AS value FROM v GROUP BY 1, 2)",
        3,
    )
    top = "row_number() OVER (PARTITION BY mktsegment, step_ts ORDER BY value {d}, custkey)"
    for op, d in (("topk", "DESC"), ("bottomk", "ASC")):
        q[op] = Query(
            f"{op} by (mktsegment) (5, customer_balance)", CB, AT, f"{V_C}, r AS (SELECT *, {top.format(d=d)} AS n FROM v), result AS (SELECT * FROM r WHERE n <= 5)"
        )
    q["quantile_by"] = Query(
        "quantile by (nation) (0.75, customer_balance)",
        ("nation",),
        AT,
        f"{V_C}, result AS (SELECT nation, step_ts, quantile_cont(value, 0.75) AS value FROM v GROUP BY 1, 2)",
    )
    q["count_values"] = Query(
        'count_values by (mktsegment) ("thousands", floor(customer_balance / 1000))',
        ("mktsegment", "thousands"),
        AT,
        f"{V_C}, result AS (SELECT mktsegment, CAST(CAST(floor(value / 1000) AS BIGINT) AS VARCHAR) AS thousands, step_ts, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY ALL)",
    )
    q["limitk"] = Query("limitk(2, events_value)", ET, HOURS, f"{V_E}, r AS (SELECT *, {first}event_type) AS n FROM v), result AS (SELECT * FROM r WHERE n <= 2)")
    q["limit_ratio"] = Query("limit_ratio(0.4, customer_balance)", CB, AT, None)
    q["nested_agg"] = Query(
        "topk(2, sum by (nation) (customer_balance))",
        ("nation",),
        AT,
        f"{V_C}, a AS (SELECT nation, step_ts, sum(value) AS value FROM v GROUP BY 1, 2), r AS (SELECT *, {first}value DESC) AS n FROM a), result AS (SELECT * FROM r WHERE n <= 2)",
        3,
    )
    q["agg_of_function"] = Query("sum(abs(customer_balance))", (), AT, f"{V_C}, result AS (SELECT step_ts, sum(abs(value)) AS value FROM v GROUP BY 1)", 3)
    q["top_users"] = Query(
        "topk(3, sum by (user_id) (events_user_value))",
        ("user_id",),
        HOURS,
        f"{V_U}, a AS (SELECT user_id, step_ts, sum(value) AS value FROM v GROUP BY 1, 2), r AS (SELECT *, {first}value DESC, user_id) AS n FROM a), result AS (SELECT * FROM r WHERE n <= 3)",
    )
    # binary operators
    q["arith_vec_vec"] = _pair("{f} + ignoring(o_orderstatus) {o}", "l.value + r.value")
    q["sub_on"] = _pair("{f} - on(o_orderpriority) {o}", "l.value - r.value")
    q["mul_ignoring"] = _pair("({f} / 1000) * ignoring(o_orderstatus) ({o} / 1000)", "(l.value / 1000) * (r.value / 1000)")
    q["div_match"] = _pair("{f} / on(o_orderpriority) {o}", "l.value / r.value")
    q["atan2"] = _pair("{f} atan2 on(o_orderpriority) {o}", "atan2(l.value, r.value)")
    q["cmp_match"] = _pair("{f} > on(o_orderpriority) {o}", "l.value", " WHERE l.value > r.value")
    q["cmp_match_bool"] = _pair("{f} <= bool on(o_orderpriority) {o}", "CASE WHEN l.value <= r.value THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
    q["vec_scalar"] = _math("events_value * 2 + 1", "value * 2 + 1")
    q["scalar_vec"] = _math("1000 - events_value", "1000 - value")
    q["mod_pow"] = _math("(events_value % 7) ^ 2", "power(value % 7, 2)")
    for name, op in (("eq", "=="), ("ne", "!="), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
        q[f"cmp_{name}"] = Query(
            f"floor(customer_balance / 1000) {op} 4",
            CB,
            AT,
            f"{V_C}, result AS (SELECT custkey, mktsegment, nation, step_ts, floor(value / 1000) AS value FROM v WHERE floor(value / 1000) {op.replace('==', '=')} 4)",
        )
    q["cmp_scalar_left"] = _math("100 < events_value", "value", "value > 100")
    q["cmp_bool"] = _math("events_value > bool 50", "CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
    q["scalar_scalar"] = Query("2 ^ 3 ^ 0 + 7 % 4", (), EVENTS, f"{_grid(EVENTS)}, result AS (SELECT step_ts, 5.0::DOUBLE AS value FROM g)")
    q["group_left"] = Query(
        "supplier_balance * on(nation) group_left(region) nation_info",
        ("suppkey", "nation", "region"),
        AT,
        f"{instant('l', 'supplier_balance', ('suppkey', 'nation'), AT)}, {instant('r', 'nation_info', ('nation', 'region'), AT)}, "
        "result AS (SELECT suppkey, nation, region, l.step_ts, l.value * r.value AS value FROM l JOIN r USING (nation, step_ts))",
    )
    q["group_right"] = Query(
        "nation_info * on(nation) group_right() supplier_balance",
        ("suppkey", "nation"),
        AT,
        f"{instant('l', 'supplier_balance', ('suppkey', 'nation'), AT)}, {instant('r', 'nation_info', ('nation', 'region'), AT)}, "
        "result AS (SELECT suppkey, nation, l.step_ts, l.value * r.value AS value FROM l JOIN r USING (nation, step_ts))",
    )
    q["ratio_of_sums"] = Query(
        'sum(orders_daily{o_orderstatus="F"}) / sum(orders_daily)',
        (),
        ORDERS,
        f"{instant('a', 'orders_daily', OP, ORDERS)}, b AS (SELECT step_ts, sum(value) AS t, sum(CASE WHEN o_orderstatus = 'F' THEN value END) AS f FROM a GROUP BY 1), result AS (SELECT step_ts, f / t AS value FROM b WHERE f IS NOT NULL)",
    )
    q["agg_of_binary"] = Query("sum(customer_balance / 100)", (), AT, f"{V_C}, result AS (SELECT step_ts, sum(value / 100) AS value FROM v GROUP BY 1)", 4)
    q["and_op"] = _set("and", "SELECT l.* FROM l SEMI JOIN r USING (o_orderpriority, step_ts)")
    q["unless_op"] = _set("unless", "SELECT l.* FROM l ANTI JOIN r USING (o_orderpriority, step_ts)")
    q["or_op"] = _set("or", "SELECT * FROM l UNION ALL SELECT r.* FROM r ANTI JOIN l USING (o_orderpriority, step_ts)")
    q["or_vector"] = Query(
        'sum(events_value{event_type="click"}) or vector(0)',
        (),
        HOURS,
        f"{instant('v', 'events_value', ET, HOURS, chr(32).join(['event_type', '=', repr('click')]))}, {_grid(HOURS)}, result AS (SELECT g.step_ts, coalesce(value, 0) AS value FROM g LEFT JOIN v USING (step_ts))",
    )
    # functions of values
    for name in ("abs", "ceil", "floor", "sqrt"):
        q[name] = Query(f"{name}(customer_balance{'' if name != 'sqrt' else ' ^ 2'} / 7)", CB, AT, f"{V_C}, result AS (SELECT custkey, mktsegment, nation, step_ts, {name}({'value' if name != 'sqrt' else 'power(value, 2)'} / 7) AS value FROM v)")
    q["exp"] = _tight("exp", "exp")
    q["ln"] = _math("ln(events_value + 1)", "ln(value + 1)")
    q["log2"] = _math("log2(events_value + 1)", "log2(value + 1)")
    q["log10"] = _math("log10(events_value + 1)", "log10(value + 1)")
    q["sgn"] = Query("sgn(customer_balance)", CB, AT, f"{V_C}, result AS (SELECT custkey, mktsegment, nation, step_ts, CAST(sign(value) AS DOUBLE) AS value FROM v)")
    for name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh"):
        q[name] = _tight(name, name)
    q["acosh"] = _math("acosh(events_value + 1)", "acosh(value + 1)", digits=5)
    q["deg"] = _math("deg(events_value)", "degrees(value)")
    q["rad"] = _math("rad(events_value)", "radians(value)")
    q["round_fn"] = _math("round(events_value, 5)", "floor(value / 5 + 0.5) * 5")
    q["clamp"] = _math("clamp(events_value, 20, 60)", "greatest(least(value, 60), 20)")
    q["clamp_min"] = _math("clamp_min(events_value, 20)", "greatest(value, 20)")
    q["clamp_max"] = _math("clamp_max(events_value, 60)", "least(value, 60)")
    q["pi_fn"] = _math("events_value * pi()", "value * pi()")
    q["time_fn"] = Query("time()", (), EVENTS, f"{_grid(EVENTS)}, result AS (SELECT step_ts, step_ts / 1000.0 AS value FROM g)")
    q["vector_fn"] = Query("vector(42)", (), EVENTS, f"{_grid(EVENTS)}, result AS (SELECT step_ts, 42.0::DOUBLE AS value FROM g)")
    q["scalar_fn"] = Query(
        "events_value - scalar(sum(events_value))",
        ET,
        HOURS,
        f"{V_E}, t AS (SELECT step_ts, sum(value) AS t FROM v GROUP BY 1), result AS (SELECT event_type, v.step_ts, value - t AS value FROM v JOIN t USING (step_ts))",
    )
    q["timestamp_fn"] = Query(
        "timestamp(events_value)",
        ET,
        HOURS,
        f"{V_E.replace('arg_max(value, ts)', 'max(ts) / 1000.0')}, result AS (SELECT * FROM v)",
    )
    q["hour_fn"] = Query("hour() * 100 + day_of_week()", (), HOURS, f"{_grid(HOURS)}, result AS (SELECT step_ts, hour(make_timestamp(step_ts * 1000)) * 100.0 + dayofweek(make_timestamp(step_ts * 1000)) AS value FROM g)")
    # histograms, absence, labels, order
    q["histogram_quantile"] = Query(
        "histogram_quantile(0.9, sum by (le) (last_over_time(events_value_bucket[24h])))",
        (),
        EVENTS,
        f"{_BUCKETS}, l AS (SELECT event_type, le, step_ts, arg_max(value, ts) AS value FROM w GROUP BY ALL), b AS (SELECT step_ts, {_BOUND} AS le, sum(value) AS c FROM l GROUP BY ALL), {_histogram('')}",
    )
    q["histogram_quantile_by"] = Query(
        "histogram_quantile(0.9, last_over_time(events_value_bucket[24h]))",
        ET,
        EVENTS,
        f"{_BUCKETS}, b AS (SELECT event_type, step_ts, {_BOUND} AS le, arg_max(value, ts) AS c FROM w GROUP BY event_type, step_ts, le), {_histogram('event_type')}",
    )
    q["absent"] = Query(
        'absent(events_value{event_type="click"})',
        ET,
        HOURS,
        f"{instant('v', 'events_value', ET, HOURS, chr(32).join(['event_type', '=', repr('click')]))}, {_grid(HOURS)}, result AS (SELECT 'click' AS event_type, g.step_ts, 1.0::DOUBLE AS value FROM g ANTI JOIN v USING (step_ts))",
    )
    q["absent_over_time"] = Query(
        'absent_over_time(events_value{event_type="click"}[30m])',
        ET,
        HOURS,
        f"s AS (SELECT * FROM ({SQL['events_value']}) WHERE event_type = 'click'), {_grid(HOURS)}, v AS (SELECT DISTINCT step_ts FROM s JOIN g ON ts > step_ts - 1800000 AND ts <= step_ts), result AS (SELECT 'click' AS event_type, g.step_ts, 1.0::DOUBLE AS value FROM g ANTI JOIN v USING (step_ts))",
    )
    q["label_replace"] = Query(
        'label_replace(rate(events_total[12h]), "short", "${1}-x", "event_type", "(..).*")',
        ("event_type", "short"),
        EVENTS,
        f"{rate('events_total', ET, EVENTS, 12 * H, name='r')}, result AS (SELECT event_type, substr(event_type, 1, 2) || '-x' AS short, step_ts, value FROM r)",
        9,
    )
    q["label_join"] = Query(
        'label_join(lineitem_daily, "both", "/", "l_returnflag", "l_linestatus")',
        (*LI, "both"),
        SHIPPED,
        f"{V_L}, result AS (SELECT *, l_returnflag || '/' || l_linestatus AS \"both\" FROM v)",
    )
    for name in ("sort", "sort_desc"):
        q[name] = Query(f"{name}(supplier_balance)", ("suppkey", "nation"), AT, instant("result", "supplier_balance", ("suppkey", "nation"), AT))
    for name in ("sort_by_label", "sort_by_label_desc"):
        q[name] = Query(f'{name}(supplier_balance, "suppkey")', ("suppkey", "nation"), AT, instant("result", "supplier_balance", ("suppkey", "nation"), AT))
    return q


DEFS = _defs()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {name: q.frame for name, q in DEFS.items()}
    from . import stored

    return out | stored.queries()


def oracle_sql() -> dict[str, str]:
    from . import stored

    return {name: q.oracle for name, q in DEFS.items() if q.sql is not None} | stored.oracle_sql()
