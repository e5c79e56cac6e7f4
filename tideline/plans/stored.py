"""Registered queries over rollups, the stored layout and metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import metadata
from ..api.engine import Engine
from ..functions import labels as L
from ..rollup.build import from_samples, from_tier
from ..rollup.config import DEFAULT
from ..rollup.router import Routes
from ..sources.store import TableStore
from . import demo
from .demo import SQL, T0

H, D = 3_600_000, 86_400_000
GRID = (T0, T0 + 30 * D, 6 * H)
NOW = T0 + 28 * D  # so that the range is served by both tiers and raw samples

_AGGS = ("val_min", "val_max", "val_sum", "val_count", "counter_total", "first_time", "last_time", "first_value", "last_value")


def table_store(spark: SparkSession, sf_dir: str, *names: str) -> TableStore:
    """The tables' metrics in the stored layout."""
    samples, series = None, None
    for name in names:
        wide = demo.store(spark, sf_dir)
        m = wide.metric(name)
        labels = wide._map(m)
        rows = m.df.select(F.lit(name).alias("metric_name"), labels.alias("labels"), m.ts.cast("long").alias("ts"), m.value.cast("double").alias("value"), m.order.alias("seq"))
        rows = rows.withColumn("series_id", L.series_id(F.col("labels")))
        own = rows.select("metric_name", "series_id", "ts", "value", F.lit(False).alias("is_stale"), "seq")
        dim = rows.groupBy("metric_name", "series_id").agg(F.first("labels").alias("labels"), F.max("ts").alias("seen_ms"))
        samples = own if samples is None else samples.unionByName(own)
        series = dim if series is None else series.unionByName(dim)
    return TableStore(samples, series)


@dataclass
class PlannedRollups:
    """Tier tables as plans over raw samples, in place of tables on disk."""

    samples: DataFrame

    def table(self, name: str) -> DataFrame:
        tiers = {t.table: t for t in DEFAULT.tiers}
        fine, coarse = DEFAULT.tiers
        rows = from_samples(self.samples, fine.resolution)
        if tiers[name] is coarse:
            rows = from_tier(rows, coarse.resolution)
        return rows.withColumn("day", F.floor(F.col("bucket") / D))


def _rollup(store: TableStore, rows: DataFrame) -> DataFrame:
    dim = store.dimension().select("metric_name", "series_id", F.element_at("labels", "event_type").alias("event_type"))
    rounded = [F.round(c, 6).alias(c) if c in ("val_sum", "counter_total") else F.col(c) for c in _AGGS]
    return rows.join(dim, ["metric_name", "series_id"]).select("event_type", "bucket", *rounded)


def rollup_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table_store(spark, sf_dir, "events_reset_total")
    return _rollup(store, from_samples(store.samples_table, 300_000))


def rollup_1h_from_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table_store(spark, sf_dir, "events_reset_total")
    return _rollup(store, from_tier(from_samples(store.samples_table, 300_000), H))


def _routed(expr: str, metric: str, digits: int = 6):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = table_store(spark, sf_dir, metric)
        routes = Routes(PlannedRollups(store.samples_table), DEFAULT, NOW)
        found = Engine(spark, store, routes=routes).query_range(expr, *GRID)
        return found.flat("event_type").withColumn("value", F.round("value", digits) + F.lit(0.0))

    return run


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.label_names(demo.store(spark, sf_dir))


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.label_values(demo.store(spark, sf_dir), "nation")


def series_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.series(demo.store(spark, sf_dir), ['events_value{event_type!~"c.*"}', "nation_info"])
    return found.select("metric_name", L.label_text(F.col("labels")).alias("labels"))


def tsdb_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each metric, the ten with most first."""
    return demo.store(spark, sf_dir).counts().orderBy(F.desc("samples"), "metric_name").limit(10)


def count_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count_series(demo.store(spark, sf_dir), "customer_balance", ("nation",))


def stored_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of rates over the stored layout; equal labels of another metric must not leak in."""
    store = table_store(spark, sf_dir, "events_total", "events_value")
    found = Engine(spark, store).query_range('sum by (event_type) (increase(events_total{event_type=~"c.*|p.*"}[12h]))', *GRID)
    return found.flat("event_type").withColumn("value", F.round("value", 6) + F.lit(0.0))


def _build_sql(width: int) -> str:
    return f"""
    WITH s AS (SELECT *, lag(value) OVER p AS pv FROM ({SQL["events_reset_total"]}) WINDOW p AS (PARTITION BY event_type ORDER BY ts))
    SELECT event_type, ts - ts % {width} AS bucket, min(value) AS val_min, max(value) AS val_max, round(sum(value), 6) AS val_sum, count(*) AS val_count,
      round(coalesce(sum(CASE WHEN value < pv THEN value ELSE value - pv END), 0), 6) AS counter_total,
      min(ts) AS first_time, max(ts) AS last_time, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value
    FROM s GROUP BY 1, 2"""


_STEPS = f"g AS (SELECT CAST(unnest(generate_series({GRID[0]}, {GRID[1]}, {GRID[2]})) AS BIGINT) AS step_ts)"


def _tier_sql(metric: str, range_ms: int, value: str, digits: int = 6) -> str:
    """Whole buckets: samples in [t - range, t)."""
    return f"""
    WITH s AS (SELECT *, lag(value) OVER p AS pv FROM ({SQL[metric]}) WINDOW p AS (PARTITION BY event_type ORDER BY ts)), {_STEPS},
    w AS (SELECT s.*, step_ts, CASE WHEN value < pv THEN value ELSE value - pv END AS grown
      FROM s JOIN g ON ts >= step_ts - {range_ms} AND ts < step_ts)
    SELECT event_type, step_ts, round({value}, {digits}) + 0.0 AS value FROM w GROUP BY 1, 2"""


_SPAN = "((max(ts) - min(ts)) / 1000.0)"
_GROWTH = f"coalesce(sum(grown), 0) * CASE WHEN max(ts) > min(ts) THEN least({D // 1000} / {_SPAN}, 1.05) ELSE 1 END"

ROUTED = {
    "tier_avg": ("avg_over_time(events_value[6h])", "events_value", 6 * H, "avg(value)", 6),
    "tier_min": ("min_over_time(events_value[6h])", "events_value", 6 * H, "min(value)", 6),
    "tier_max": ("max_over_time(events_value[12h])", "events_value", 12 * H, "max(value)", 6),
    "tier_sum": ("sum_over_time(events_value[12h])", "events_value", 12 * H, "sum(value)", 6),
    "tier_sum_90m": ("sum_over_time(events_value[90m])", "events_value", 90 * 60_000, "sum(value)", 6),
    "tier_count": ("count_over_time(events_value[12h])", "events_value", 12 * H, "CAST(count(*) AS DOUBLE)", 6),
    "tier_last": ("last_over_time(events_value[12h])", "events_value", 12 * H, "arg_max(value, ts)", 6),
    "tier_increase": ("increase(events_reset_total[24h])", "events_reset_total", 24 * H, _GROWTH, 6),
    "tier_rate": ("rate(events_reset_total[24h])", "events_reset_total", 24 * H, f"{_GROWTH} / {D // 1000}", 9),
}


def queries() -> dict:
    plain = (rollup_5m, rollup_1h_from_5m, label_names, label_values, series_match, tsdb_status, count_dictionary, stored_selector)
    out = {f.__name__: f for f in plain}
    out["segmented_union"] = _routed("sum by (event_type) (sum_over_time(events_value[6h]))", "events_value")
    for name in ("irate", "deriv"):
        out[f"tier_{name}"] = _routed(f"{name}(events_total[24h])", "events_total", 9)
    out["tier_predict"] = _routed("predict_linear(events_total[24h], 7200)", "events_total", 5)
    return out | {name: _routed(expr, metric, digits) for name, (expr, metric, _, _, digits) in ROUTED.items()}


def _last_sql(value: str, digits: int) -> str:
    """Over each hour bucket's last sample."""
    return f"""
    WITH s AS (SELECT event_type, ts - ts % {H} AS bucket, max(ts) AS t, arg_max(value, ts) AS v FROM ({SQL["events_total"]}) GROUP BY 1, 2), {_STEPS},
    w AS (SELECT *, lag(v) OVER o AS pv, lag(t) OVER o AS pt, (t - step_ts) / 1000.0 AS x FROM s JOIN g ON bucket >= step_ts - {D} AND bucket + {H} <= step_ts
      WINDOW o AS (PARTITION BY event_type, step_ts ORDER BY bucket))
    SELECT event_type, step_ts, round({value}, {digits}) + 0.0 AS value FROM w GROUP BY 1, 2 HAVING count(*) >= 2"""


def oracle_sql() -> dict[str, str]:
    from .catalogue import EVENTS, rate

    out = {"rollup_5m": _build_sql(300_000), "rollup_1h_from_5m": _build_sql(H)}
    out |= {name: _tier_sql(metric, r, value, digits) for name, (_, metric, r, value, digits) in ROUTED.items()}
    out["segmented_union"] = _tier_sql("events_value", 6 * H, "sum(value)")
    out["tier_deriv"] = _last_sql("regr_slope(v, x)", 9)
    out["tier_predict"] = _last_sql("regr_intercept(v, x) + regr_slope(v, x) * 7200", 5)
    out["tier_irate"] = _last_sql("(arg_max(v, t) - arg_max(pv, t)) / ((max(t) - arg_max(pt, t)) / 1000.0)", 9)
    names = {label for m in _LABELS.values() for label in m} | {"__name__"}
    out["label_names"] = "SELECT unnest([" + ", ".join(f"'{n}'" for n in sorted(names)) + "]) AS name"
    out["label_values"] = "SELECT n_name AS value FROM nation"
    out["series_match"] = (
        "SELECT DISTINCT 'events_value' AS metric_name, '{event_type=\"' || event_type || '\"}' AS labels FROM events WHERE NOT regexp_full_match(event_type, 'c.*') "
        "UNION ALL SELECT 'nation_info', '{nation=\"' || n_name || '\",region=\"' || r_name || '\"}' FROM nation JOIN region ON n_regionkey = r_regionkey"
    )
    counted = " UNION ALL ".join(f"SELECT '{m}' AS metric_name, count(*) AS samples FROM ({sql})" for m, sql in SQL.items())
    out["tsdb_status"] = f"SELECT * FROM ({counted}) ORDER BY samples DESC, metric_name LIMIT 10"
    out["count_dictionary"] = "SELECT n_name AS nation, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
    inner = rate("events_total", ("event_type",), EVENTS, 12 * H, per_second=False)
    out["stored_selector"] = f"WITH {inner} SELECT event_type, step_ts, round(value, 6) + 0.0 AS value FROM result WHERE regexp_full_match(event_type, 'c.*|p.*')"
    return out


_LABELS = {
    "events_value": ("event_type",),
    "events_user_value": ("event_type", "user_id"),
    "events_value_bucket": ("event_type", "le"),
    "orders_daily": ("o_orderpriority", "o_orderstatus"),
    "lineitem_daily": ("l_returnflag", "l_linestatus"),
    "customer_balance": ("custkey", "mktsegment", "nation"),
    "supplier_balance": ("suppkey", "nation"),
    "nation_info": ("nation", "region"),
}
