import pytest

from tests.util import store
from tideline.api.engine import Engine
from tideline.errors import BadQuery
from tideline.rollup.build import from_samples, from_tier
from tideline.rollup.config import DEFAULT, HOUR, RollupConfig, Tier, duration_ms
from tideline.rollup.router import Routes
from tideline.rollup.store import RollupStore

M = 60_000


@pytest.mark.parametrize("text, want", [("2d", 2 * 24 * HOUR), ("1h30m", 90 * M), ("90s", 90_000), ("1.5h", 90 * M), ("-5m", -5 * M), ("250ms", 250)])
def test_durations(text, want):
    assert duration_ms(text) == want


@pytest.mark.parametrize("text", ["", "5", "d", "5x", "1h-5m"])
def test_bad_durations(text):
    with pytest.raises(BadQuery):
        duration_ms(text)


def test_validation():
    assert DEFAULT.validate() is DEFAULT and RollupConfig(enabled=False).validate()
    bad = [
        RollupConfig(),
        RollupConfig(raw_retention=HOUR, tiers=DEFAULT.tiers),
        RollupConfig(tiers=(DEFAULT.tiers[1], DEFAULT.tiers[0])),
        RollupConfig(tiers=(Tier("a", 5 * M, HOUR, M), Tier("b", 7 * M, 2 * HOUR, 2 * M))),
    ]
    for config in bad:
        with pytest.raises(ValueError):
            config.validate()


def test_tier_by_step():
    pick = lambda *a: getattr(DEFAULT.select(*a), "name", None)
    assert [pick(M), pick(5 * M), pick(2 * HOUR), pick(2 * HOUR, 10 * M), pick(2 * HOUR, M)] == [None, "5m", "1h", "5m", None]
    assert RollupConfig(enabled=False, tiers=DEFAULT.tiers).select(HOUR) is None


def test_only_tiers_that_tile_the_windows():
    pick = lambda *a: getattr(DEFAULT.select(*a), "name", None)
    assert pick(HOUR, 90 * M, 0) == "5m" and pick(HOUR, 2 * HOUR, 0) == "1h"
    assert pick(HOUR, 2 * HOUR, 5 * M) == "5m" and pick(HOUR, 2 * HOUR, M) is None
    assert pick(90 * M, 3 * HOUR, 0) == "5m" and pick(HOUR, 7 * M, 0) is None


def test_segments_join():
    now = 1000 * HOUR
    got = DEFAULT.segments(now - 200 * HOUR, now, DEFAULT.tiers[1], now)
    assert [s.tier and s.tier.name for s in got] == ["1h", "5m", None]
    assert got[0].start == now - 200 * HOUR and got[-1].end == now and all(a.end == b.start for a, b in zip(got, got[1:]))
    assert [s.tier for s in DEFAULT.segments(0, now, None, now)] == [None]
    assert [s.tier and s.tier.name for s in DEFAULT.segments(now - HOUR, now, DEFAULT.tiers[1], now)] == [None]
    assert DEFAULT.checksum() != RollupConfig(tiers=DEFAULT.tiers[:1]).checksum()


def data():
    import random

    rng = random.Random(3)
    out = {}
    for k in "xy":
        total, rows = 0, []
        for t in range(0, 240 * HOUR, 7 * M):
            total = 0 if rng.random() < 0.01 else total + rng.randrange(5)
            rows.append((t + rng.randrange(M), total))
        out[(("k", k),)] = rows
    return {"c_total": out, "other": {(("k", "x"),): [(5, 1e9)]}}


def test_growth_across_buckets_and_resets(spark):
    rows = {"m": {(): [(0, 1), (4 * M, 5), (6 * M, 9), (11 * M, 2), (12 * M, 3)]}}
    got = {r.bucket: r for r in from_samples(store(spark, rows).samples_table, 5 * M).collect()}
    assert [got[b].counter_total for b in (0, 5 * M, 10 * M)] == [4, 4, 3]
    assert got[10 * M].first_value == 2 and got[10 * M].last_value == 3 and got[0].val_count == 2
    hour = from_tier(from_samples(store(spark, rows).samples_table, 5 * M), HOUR).collect()
    assert len(hour) == 1 and hour[0].counter_total == 11 and hour[0].first_value == 1 and hour[0].last_value == 3


def test_growth_over_a_long_gap(spark, tmp_path):
    rows = {"m": {(): [(0, 1), (100 * HOUR, 7), (100 * HOUR + 5 * M, 3), (190 * HOUR, 4)]}}
    raw = store(spark, rows).samples_table
    assert sum(r.counter_total for r in from_samples(raw, 5 * M).collect()) == 6 + 3 + 1
    rollups = RollupStore(spark, str(tmp_path / "r"), DEFAULT)
    rollups.refresh(raw.filter(f"ts < {150 * HOUR}"), 300 * HOUR)
    rollups.refresh(raw, 300 * HOUR, since=180 * HOUR)  # goes on from the bucket 90 hours before
    for name in ("samples_5m", "samples_1h"):
        assert sum(r.counter_total for r in rollups.table(name).collect()) == 10


def test_ranges_off_the_coarse_grid_are_exact(spark, tmp_path):
    raw = store(spark, {"m": {(("k", "x"),): [(t, 1.0) for t in range(0, 240 * HOUR, 5 * M)]}})
    now = 240 * HOUR
    rollups = RollupStore(spark, str(tmp_path / "r"), DEFAULT)
    rollups.refresh(raw.samples_table, now)
    routed = Engine(spark, raw, routes=Routes(rollups, DEFAULT, now))
    for start in (48 * HOUR, 48 * HOUR + 5 * M, 48 * HOUR + M):
        got = routed.query_range("sum_over_time(m[90m])", start, start + 5 * HOUR, HOUR).frame.collect()
        assert {r["value"] for r in got} == {18.0}


def test_routed_results_and_refresh(spark, tmp_path):
    raw = store(spark, data())
    now = 240 * HOUR
    rollups = RollupStore(spark, str(tmp_path / "r"), DEFAULT)
    assert rollups.refresh(raw.samples_table, now) == ["samples_5m", "samples_1h"]
    before = {n: rollups.table(n).count() for n in ("samples_5m", "samples_1h")}
    rollups.refresh(raw.samples_table, now, since=now - 100 * HOUR)  # again, for the later days only
    assert {n: rollups.table(n).count() for n in before} == before
    plain = Engine(spark, raw)
    routed = Engine(spark, raw, routes=Routes(rollups, DEFAULT, now))
    grid = (48 * HOUR, now, 4 * HOUR)
    read = lambda e, q: {(r["labels"]["k"], r["step_ts"]): r["value"] for r in e.query_range(q, *grid).frame.collect()}
    for fn in ("sum_over_time", "count_over_time", "min_over_time", "max_over_time", "avg_over_time"):
        # whole buckets hold [t - range, t); shifting raw samples by a millisecond gives (t - range, t] the same content
        a, b = read(routed, f"{fn}(c_total[12h])"), read(plain, f"{fn}(c_total[12h] offset 1ms)")
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a), fn
    a, b = read(routed, "increase(c_total[12h])"), read(plain, "increase(c_total[12h])")
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=0.06, abs=6) for k in a)
    assert read(routed, "stddev_over_time(c_total[12h])").keys() == a.keys()  # from raw samples
    nested = read(routed, "sum by (k) (abs(sum_over_time(c_total[12h])))")
    assert nested == pytest.approx(read(routed, "sum_over_time(c_total[12h])"))


def test_expiry(spark, tmp_path):
    tiers = (Tier("5m", 5 * M, HOUR, 5 * M, retention=48 * HOUR),)
    rollups = RollupStore(spark, str(tmp_path / "r"), RollupConfig(tiers=tiers))
    rollups.refresh(store(spark, data()).samples_table, 240 * HOUR)
    assert len(rollups.expire(240 * HOUR)) == 8
    assert rollups.table("samples_5m").selectExpr("min(bucket)").first()[0] >= 192 * HOUR
