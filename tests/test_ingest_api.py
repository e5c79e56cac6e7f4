import json
import math
import threading
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.util import store
from tideline.api import cli
from tideline.api.engine import Engine
from tideline.api.format import as_csv, as_json, as_table, float_text, parse_duration, parse_time
from tideline.api.http import Api, serve
from tideline.errors import BadQuery
from tideline.functions import labels as L
from tideline.functions.ieee import float_text as float_column
from tideline.sources.files import millis_of
from tideline.sources.ingest import STALE, Point, Table, counter_like, decode, is_stale, metric_kind
from tideline.streaming import writer


def test_append_and_query(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    a = {"__name__": "m", "job": "x", "gone": ""}
    table.append([Point(a, 1000, 1.0), Point(a, 2000, 2.0), Point({"__name__": "n", "job": "x"}, 1000, 9.0)])
    table.append([Point(a, 2000, 2.0), Point(a, 3000, STALE)])
    got = Engine(spark, table.store())
    assert [(dict(r.labels), r.value) for r in got.query("m", 2500).frame.collect()] == [({"job": "x"}, 2.0)]
    assert got.query("m", 3500).frame.count() == 0
    assert table.samples.count() == 4
    assert [r.value for r in got.query("sum_over_time(m[1m])", 5000).frame.collect()] == [3.0]


def test_decode():
    assert is_stale(np.array([STALE, math.nan, 1.0])).tolist() == [True, False, False]
    rows = decode([Point({"__name__": "m"}, 1, 1.0), Point({"__name__": "m"}, 7_200_000, STALE)])
    assert rows["value"].to_pylist()[0] == 1.0 and rows["is_stale"].to_pylist() == [False, True]


def test_equal_times(spark, tmp_path):
    """A value stays rather than a marker, and of values the largest, whichever way and order they come in."""
    m = {"__name__": "m"}
    points = [Point(m, 1, 1.0), Point(m, 1, STALE), Point(m, 1, 3.0), Point(m, 1, 2.0), Point(m, 2, STALE)]
    for name, order in (("a", points), ("b", points[::-1])):
        table = Table(spark, str(tmp_path / name))
        table.append(order[:2]), table.append(order[2:])
        assert sorted((r.ts, r.value if not r.is_stale else None) for r in table.samples.collect()) == [(1, 3.0), (2, None)]


def test_batches_and_streams_name_a_series_alike(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps({"labels": {"__name__": "m", "k": "a"}, "ts": 2000, "value": 2.0, "is_stale": False}))
    table = Table(spark, str(tmp_path / "t"))
    table.append([Point({"__name__": "m", "k": "a"}, 1000, 1.0)])
    writer.start(spark, str(tmp_path / "in"), table, str(tmp_path / "c"), every=None).awaitTermination()
    assert table.samples.select("series_id").distinct().count() == 1
    assert [r.value for r in Engine(spark, table.store()).query("count(m)", 2500).frame.collect()] == [1.0]


def test_fingerprints():
    a = L.fingerprint({"a": "1", "b": "2"})
    assert a == L.fingerprint({"b": "2", "a": "1"}) != L.fingerprint({"a": "1b", "": "2"}) and 0 <= a < 2**64


def test_kinds():
    assert [metric_kind(n) for n in ("a_total", "a_bucket", "a_count", "a")] == ["counter", "histogram", "counter", "gauge"]
    assert metric_kind("a_total", {"a_total": "gauge"}) == "gauge" and counter_like("x_bucket") and not counter_like("x")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows = [{"labels": {"__name__": "m", "k": str(j % 2)}, "ts": 1000 * j, "value": float(j), "is_stale": False} for j in range(10)]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    table = Table(spark, str(tmp_path / "t"))
    for _ in range(2):  # the second run finds nothing new
        writer.start(spark, str(tmp_path / "in"), table, str(tmp_path / "c"), every=None, files_per_batch=2).awaitTermination()
    assert table.samples.count() == 10
    got = Engine(spark, table.store()).query("sum(m)", 9500).frame.collect()
    assert [r.value for r in got] == [17.0]


def test_rolling_windows_of_a_stream(spark, tmp_path):
    rows = [("m", 1, t * 60_000, float(t)) for t in range(20)] + [("m", 1, 10 * 86_400_000, 0.0)]
    for k, part in enumerate((rows[:20], rows[20:], [("m", 1, 11 * 86_400_000, 0.0)])):
        spark.createDataFrame(part, "metric_name string, series_id long, ts long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("metric_name string, series_id long, ts long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = writer.rolling(stream).writeStream.outputMode("append").format("memory").queryName("rolled").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.val_sum: r.val_count for r in spark.table("rolled").collect()}
    assert got[sum(range(5))] == 5 and got[sum(range(5, 10))] == 5


def test_timestamps(spark):
    raw = ["1500", "1.5e3", "1970-01-01 00:00:01.500", "1970-01-01T00:00:01Z", "no"]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(millis_of(F.col("r")).alias("t")).collect()
    assert [r.t for r in got] == [1500, 1500, 1500, 1000, None]


FLOATS = [math.nan, math.inf, -math.inf, 3.14, 42.0, 0.0, -1.5, 1e21, 1e-7, 123456789.25, 0.1 + 0.2]
TEXTS = ["NaN", "+Inf", "-Inf", "3.14", "42", "0", "-1.5", "1" + "0" * 21, "0.0000001", "123456789.25", "0.30000000000000004"]


def test_float_text(spark):
    assert [float_text(v) for v in FLOATS] == TEXTS
    usual = [v for v in FLOATS if not math.isnan(v) and v not in (1e21, 1e-7)]
    got = spark.createDataFrame([(v,) for v in usual], "v double").select(float_column(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [float_text(v) for v in usual]


@pytest.mark.parametrize(
    "text, want",
    [("", 10_000), ("now", 10_000), ("now-5s", 5_000), ("-5s", 5_000), ("+1m", 70_000), ("1.5", 1500), ("1970-01-01T00:00:02Z", 2000), ("1970-01-02", 86_400_000)],
)
def test_times(text, want):
    assert parse_time(text, 10_000) == want


def test_bad_times_and_durations():
    assert parse_duration("60") == 60_000 and parse_duration("1m30s") == 90_000 and parse_duration("0.5") == 500
    for call in (lambda: parse_time("yesterday"), lambda: parse_duration(""), lambda: parse_duration("x")):
        with pytest.raises(BadQuery):
            call()


DATA = {"m": {(("k", "a"),): [(1000, 1), (2000, 2.5)], (("k", 'b"'),): [(2000, math.inf)]}, "n_total": {(): [(1000, 7)]}}


def test_formats(spark):
    e = Engine(spark, store(spark, DATA))
    body = json.loads(as_json(e.query_range("m", 1000, 2000, 1000)))
    assert body["data"]["resultType"] == "matrix"
    assert body["data"]["result"][0] == {"metric": {"k": "a"}, "values": [[1.0, "1"], [2.0, "2.5"]]}
    assert body["data"]["result"][1]["values"] == [[2.0, "+Inf"]]
    one = json.loads(as_json(e.query("n_total", 1500)))["data"]
    assert one == {"resultType": "vector", "result": [{"metric": {}, "value": [1.5, "7"]}]}
    assert json.loads(as_json(e.query("1 + 1", 1500)))["data"] == {"resultType": "scalar", "result": [1.5, "2"]}
    assert as_csv(e.query("m", 2000)).splitlines() == ["labels,timestamp,value", '"{k=""a""}",1970-01-01T00:00:02Z,2.5', '"{k=""b""""}",1970-01-01T00:00:02Z,+Inf']
    assert as_table(e.query("n_total", 1500)).splitlines()[1].split() == ["{}", "1970-01-01T00:00:01.500Z", "7"]
    assert json.loads(as_json(e.query("none", 1500)))["data"]["result"] == []


def test_routes(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.append([Point({"__name__": "m", "k": "a"}, 1000, 1.0), Point({"__name__": "n_total"}, 1000, 7.0)])
    api = Api(Engine(spark, table.store()), table, {"m": "gauge"}, timeout_s=60)
    get = lambda path, **p: (lambda r: (r[0], json.loads(r[1])))(api.handle(path, {k.replace("_", "[]") if k == "match_" else k: v for k, v in p.items()}))
    assert get("/api/v1/query", query=["m"], time=["2"])[1]["data"]["result"][0]["value"] == [2.0, "1"]
    assert len(get("/api/v1/query_range", query=["m"], start=["1"], end=["3"], step=["1"])[1]["data"]["result"][0]["values"]) == 3
    assert get("/api/v1/labels")[1]["data"] == ["__name__", "k"]
    assert get("/api/v1/label/__name__/values")[1]["data"] == ["m", "n_total"]
    assert get("/api/v1/series", match_=["{k!=\"\"}"])[1]["data"] == [{"__name__": "m", "k": "a"}]
    assert get("/api/v1/status/tsdb")[1]["data"]["headStats"] == {"numSeries": 2, "numSamples": 2}
    assert get("/api/v1/metadata")[1]["data"]["m"][0]["type"] == "gauge"
    assert get("/api/v1/query", query=["sum("])[0] == 400 and get("/api/v1/query")[1]["errorType"] == "bad_data"
    assert get("/api/v1/query_range", query=["m"], start=["3"], end=["1"], step=["1"])[0] == 400
    assert get("/api/v1/query_range", query=["m"], start=["0"], end=["99999"], step=["1"])[0] == 400
    assert get("/api/v1/nothing")[0] == 404 and api.handle("/-/healthy", {})[0] == 200
    assert api.handle("/api/v1/write", {}, json.dumps([{"labels": {"__name__": "w"}, "samples": [[1000, 3]]}]).encode())[0] == 200
    assert table.samples.filter("metric_name = 'w'").count() == 1
    server = serve(api, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/v1/query?query=m&time=2") as r:
        assert json.loads(r.read())["status"] == "success"
    server.shutdown()


def test_command_line(spark):
    e = Engine(spark, store(spark, DATA))
    run = lambda *a: cli.run(cli.arguments().parse_args(list(a)), e)
    assert run("n_total", "--time", "1.5", "--format", "csv").splitlines()[1] == "{},1970-01-01T00:00:01.500Z,7"
    assert len(run("m", "--start", "1", "--end", "2", "--step", "1s", "--format", "table").splitlines()) == 4
    assert "Physical Plan" in run("-q", "rate(m[1m])", "--explain")


def test_plan_has_one_scan_with_pushed_filters(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.append([Point({"__name__": "m", "k": "a"}, 1000, 1.0)])
    plan = Engine(spark, table.store()).explain("rate(m[5m])", 86_400_000, 87_000_000, 60_000)
    partitions = plan.split("PartitionFilters")[1].split("]")[0]
    assert "metric_name#" in partitions and "day#" in partitions and "GreaterThan(ts,86100000)" in plan
