"""The tables the queries run on, read as metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..api.engine import Engine
from ..plans.compiler import Settings
from ..sources.store import WideMetric, WideStore

#: The instant of the metrics that have one sample a series: 2024-01-01T00:00:00Z.
T0 = 1_704_067_200_000
BOUNDS = ("5", "10", "25", "50", "100", "250", "+Inf")


def millis(column: str) -> Column:
    """Epoch milliseconds of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) div 1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], WideMetric]]:
    """Each metric by name, made when it is asked for."""
    read = lambda name: table(spark, sf_dir, name)

    def events(labels: tuple[str, ...]):
        return lambda: WideMetric(read("events"), labels, millis("ts"), F.col("value"), seq=F.col("event_id"))

    def numbered(value: Callable[[Column], Column]):
        number = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
        return WideMetric(read("events").withColumn("n", number), ("event_type",), millis("ts"), value(F.col("n")).cast("double"), "counter", seq=F.col("n"))

    def buckets() -> WideMetric:
        bounds = [F.struct(F.lit(b).alias("le"), F.lit(float("inf") if b == "+Inf" else float(b)).alias("bound")) for b in BOUNDS]
        rows = read("events").withColumn("b", F.explode(F.array(*bounds))).select("event_id", "event_type", "ts", "value", "b.le", "b.bound")
        order = Window.partitionBy("event_type", "le").orderBy("ts", "event_id")
        rows = rows.withColumn("c", F.sum(F.when(F.col("value") <= F.col("bound"), 1).otherwise(0)).over(order))
        return WideMetric(rows, ("event_type", "le"), millis("ts"), F.col("c").cast("double"), "histogram", seq=F.col("c"))

    def daily(name: str, labels: tuple[str, ...], day: str, value: str):
        return lambda: WideMetric(read(name).groupBy(*labels, day).agg(F.sum(value).alias("total")), labels, millis(day), F.col("total"))

    def nations() -> DataFrame:
        return read("nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation"), "n_regionkey")

    def customer() -> WideMetric:
        rows = read("customer").join(nations(), F.col("c_nationkey") == F.col("nk"))
        rows = rows.withColumn("custkey", F.col("c_custkey")).withColumn("mktsegment", F.col("c_mktsegment"))
        return WideMetric(rows, ("custkey", "mktsegment", "nation"), F.lit(T0), F.col("c_acctbal"))

    def supplier() -> WideMetric:
        rows = read("supplier").join(nations(), F.col("s_nationkey") == F.col("nk")).withColumn("suppkey", F.col("s_suppkey"))
        return WideMetric(rows, ("suppkey", "nation"), F.lit(T0), F.col("s_acctbal"))

    def info() -> WideMetric:
        rows = nations().join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("region", F.col("r_name"))
        return WideMetric(rows, ("nation", "region"), F.lit(T0), F.lit(1.0))

    return {
        "events_value": events(("event_type",)),
        "events_user_value": events(("event_type", "user_id")),
        "events_total": lambda: numbered(lambda n: n),
        "events_reset_total": lambda: numbered(lambda n: n % 97),
        "events_value_bucket": buckets,
        "orders_daily": daily("orders", ("o_orderpriority", "o_orderstatus"), "o_orderdate", "o_totalprice"),
        "lineitem_daily": daily("lineitem", ("l_returnflag", "l_linestatus"), "l_shipdate", "l_quantity"),
        "customer_balance": customer,
        "supplier_balance": supplier,
        "nation_info": info,
    }


def store(spark: SparkSession, sf_dir: str) -> WideStore:
    return WideStore(metrics(spark, sf_dir))


def engine(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> Engine:
    return Engine(spark, store(spark, sf_dir), settings)


#: The same metrics in DuckDB SQL: label columns, ts (ms), value.
_RUN = "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)"
_VALUES = ", ".join(f"('{b}', '{'inf' if b == '+Inf' else b}'::DOUBLE)" for b in BOUNDS)
SQL = {
    "events_value": "SELECT event_type, epoch_us(ts) // 1000 AS ts, value FROM events",
    "events_user_value": "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts, value FROM events",
    "events_total": f"SELECT event_type, epoch_us(ts) // 1000 AS ts, CAST({_RUN} AS DOUBLE) AS value FROM events",
    "events_reset_total": f"SELECT event_type, epoch_us(ts) // 1000 AS ts, CAST({_RUN} % 97 AS DOUBLE) AS value FROM events",
    "events_value_bucket": "SELECT event_type, le, epoch_us(ts) // 1000 AS ts, CAST(sum(CASE WHEN value <= bound THEN 1 ELSE 0 END) OVER "
    f"(PARTITION BY event_type, le ORDER BY ts, event_id) AS DOUBLE) AS value FROM events CROSS JOIN (VALUES {_VALUES}) AS b(le, bound)",
    "orders_daily": "SELECT o_orderpriority, o_orderstatus, epoch_us(o_orderdate) // 1000 AS ts, sum(o_totalprice) AS value FROM orders GROUP BY ALL",
    "lineitem_daily": "SELECT l_returnflag, l_linestatus, epoch_us(l_shipdate) // 1000 AS ts, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "customer_balance": f"SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_mktsegment AS mktsegment, n_name AS nation, {T0} AS ts, c_acctbal AS value "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "supplier_balance": f"SELECT CAST(s_suppkey AS VARCHAR) AS suppkey, n_name AS nation, {T0} AS ts, s_acctbal AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "nation_info": f"SELECT n_name AS nation, r_name AS region, {T0} AS ts, 1.0::DOUBLE AS value FROM nation JOIN region ON n_regionkey = r_regionkey",
}
