"""Samples of one series in the same millisecond: all queries over events agree with their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.plans import catalogue, demo
from tideline.rollup.build import from_samples

NAMES = ["increase", "label_replace", "offset", "rate", "resets", "rollup_1h_from_5m", "rollup_5m", "smoothing", "tier_increase"]
NAMES += ["delta", "idelta", "irate", "last_over_time", "rate_many_steps", "tier_last", "stored_selector", "histogram_quantile_by"]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """Events within 40 ms of a step, of a range's start or of a lookback's end; several in a millisecond, told apart by microseconds or by event_id only."""
    rng = np.random.default_rng(5)
    path = tmp_path_factory.mktemp("ties")
    n = 6000
    hours = rng.integers(0, 240, n)
    at = (demo.T0 + hours * 3_600_000 + rng.choice([0, 1_800_000, -300_000], n) + rng.integers(-3, 3, n)) * 1000 + rng.integers(0, 2, n) * 500
    at.sort()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    kinds = [str(k) for k in rng.choice(["click", "error"], n)]
    con.execute("CREATE TABLE t (event_id BIGINT, us BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(i, int(at[i]), i % 7, kinds[i], float(rng.integers(0, 300))) for i in range(n)])
    con.execute(f"COPY (SELECT event_id, make_timestamp(us) AS ts, user_id, event_type, value FROM t ORDER BY event_id) TO '{path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", NAMES)
def test_equal_times(spark, data, name):
    path, con = data
    frame = catalogue.queries()[name](spark, path)
    names = sorted(frame.columns)
    got = sorted(tuple(r[c] for c in names) for r in frame.collect())
    want = sorted(con.sql(catalogue.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in names)).fetchall())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_rollup_pairs_all_samples_of_a_time(spark):
    rows = [("m", 1, 10, 5.0, False, 2), ("m", 1, 10, 4.0, False, 1), ("m", 1, 10, 7.0, False, 3), ("m", 1, 110, 9.0, False, 4)]
    found = from_samples(spark.createDataFrame(rows, "metric_name string, series_id long, ts long, value double, is_stale boolean, seq long"), 100)
    got = found.orderBy("bucket").select("bucket", "first_value", "last_value", F.col("counter_total")).collect()
    assert [tuple(r) for r in got] == [(0, 4.0, 4.0, 3.0), (100, 9.0, 9.0, 2.0)]
