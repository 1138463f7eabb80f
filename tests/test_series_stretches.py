"""Walks along a series in stretches against plain loops: a hot series, stretches without rows, ties, nulls."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyframe.operators import series as S

T0 = datetime(2024, 1, 1)


def times(rng, n, hours):
    return [T0 + timedelta(minutes=rng.choice([0, rng.randint(0, hours * 60), rng.randint(0, 300)])) for _ in range(n)]


@pytest.mark.parametrize("stretch_s", [600, 3600, 86_400, 10**9])
@pytest.mark.parametrize("fallback", [None, "day"])
def test_asof(spark, stretch_s, fallback):
    rng = random.Random(4)
    keys = ["hot"] * 6 + ["b", "c", None]
    left = [(rng.choice(keys), t, i) for i, t in enumerate(times(rng, 400, 24 * 6))]
    right = [(rng.choice(keys), t, rng.choice([None, *range(50)])) for t in times(rng, 60, 24 * 4)]
    a, b = spark.createDataFrame(left, "s string, time timestamp_ntz, id long"), spark.createDataFrame(right, "s string, time timestamp_ntz, key long")
    got = {r["id"]: (r["right_time"], r["right_key"]) for r in S.asof_join(a, b, "s", "time", "key", fallback, stretch_s).collect()}
    order = lambda r: (r[1], r[2] is None, r[2] or 0)
    for s, t, i in left:
        near = max((r for r in right if r[0] == s and r[1] <= t), key=order, default=None)
        if fallback:
            near = near if near and near[1].date() >= t.date() - timedelta(days=1) else None
            day = [r for r in right if r[0] == s and r[1].date() == t.date()]
            near = near or min(day, key=lambda r: (r[1], r[2] is not None, r[2] or 0), default=None)
        assert got[i] == ((near[1], near[2]) if near else (None, None)), (s, t)


@pytest.mark.parametrize("span", [1, 7, 100, 1 << 20])
def test_merge_intervals(spark, span):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), x := rng.choice([rng.randint(0, 3000), rng.randint(0, 40)]), x + rng.choice([1, 3, 250])) for _ in range(500)]
    rows += [("chain", i, i + 1) for i in range(0, 900, 2)] + [("long", 0, 5000), ("long", 4000, 4001), ("long", 5100, 5101)]
    got = sorted(str(tuple(r)) for r in S.merge_intervals(spark.createDataFrame(rows, "f string, s long, e long"), "f", "s", "e", 5, span).select("f", "start", "end", "n").collect())
    want = []
    for f in {r[0] for r in rows}:
        runs = []
        for _, s, e in sorted((r for r in rows if r[0] == f), key=lambda r: r[1:]):
            if runs and s <= runs[-1][1] + 5:
                runs[-1] = [runs[-1][0], max(runs[-1][1], e), runs[-1][2] + 1]
            else:
                runs.append([s, e, 1])
        want += [str((f, *r)) for r in runs]
    assert got == sorted(want)


@pytest.mark.parametrize("width", [1, 10, 10**6])
def test_unwrap(spark, width):
    rng = random.Random(6)
    rows = [(track, i * rng.choice([1, 1, 30]) * 1000 + i, rng.uniform(-180, 180)) for track in ("hot", "b", None) for i in range(200)]
    got = {(r["t"], r["o"]): r["lon_unwrapped"] for r in S.unwrap_lon(spark.createDataFrame(rows, "t string, o long, lon double"), "t", "o", "lon", width).collect()}
    for track in ("hot", "b", None):
        turns, last = 0, None
        for _, o, lon in sorted(r for r in rows if r[0] == track) if track else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            if last is not None:
                turns += -360 if lon - last > 180 else 360 if lon - last < -180 else 0
            last = lon
            assert got[track, o] == pytest.approx(lon + turns)
    assert len(got) == len(rows)


def test_a_hot_series_is_spread(spark):
    """One series holds all rows; no window of the plan is by the series alone except over the table of stretches."""
    left = spark.range(20_000).select(F.lit("hot").alias("s"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("time"), "id")
    out = S.asof_join(left, left.select("s", "time", (F.col("id") + 1).alias("key")), "s", "time", "key")
    spread = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in spread) == 20_000 and max(r["count"] for r in spread) < 12_000
    assert out.filter("right_key = id + 1 AND right_time = time").count() == 20_000
