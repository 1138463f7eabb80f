"""Operators over several grids in one call equal a call for each; unlike grids and Lambert boxes against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyframe.operators import grid as A
from skyframe.operators import radar as R


def cells(spark, *grids):
    return spark.createDataFrame([(k, i, j, float(v)) for k, g in enumerate(grids) for (i, j), v in g.items()], "run int, i int, j int, value double")


def test_two_frames_are_not_averaged(spark):
    zero, one = ({(i, j): v for i in range(8) for j in range(8)} for v in (0, 1))
    out = {(r["run"], r["i"], r["j"]): r["smooth"] for r in A.gaussian_smooth(cells(spark, zero, one), 8, 8, by=["run"]).collect()}
    assert len(out) == 128 and all(v == pytest.approx(k[0]) for k, v in out.items())


def test_smooth_of_sparse_frames(spark):
    rng = random.Random(1)
    grids = [{(i, j): rng.uniform(0, 50) for i in range(9) for j in range(7) if rng.random() < 0.6} for _ in range(3)]
    got = {(r["run"], r["i"], r["j"]): r["smooth"] for r in A.gaussian_smooth(cells(spark, *grids), 9, 7, 1.5, 5, 45, by=["run"]).collect()}
    for k, g in enumerate(grids):
        for i in range(9):
            for j in range(7):
                near = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if 0 <= i + a < 9 and 0 <= j + b < 7]
                w = [math.exp(-(a * a + b * b) / 4.5) for a, b in near]
                x = [(g[i + a, j + b] - 5) / 40 if (i + a, j + b) in g else -0.6 for a, b in near]
                assert got[k, i, j] == pytest.approx(sum(map(math.prod, zip(w, x, strict=True))) / sum(w))


def test_guidance_meets_gates_of_its_own_run(spark):
    gates = spark.createDataFrame([(r, 0, 0, 10.0) for r in (0, 1)], "run int, i int, j int, value double")
    guidance = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 2.04)], "run int, i int, j int, value double")
    assert sorted((r["run"], r["exceed"]) for r in R.gate_exceedance(gates, guidance, by=["run"]).collect()) == [(0, 9.0), (1, 8.0)]


def test_unlike_grids(spark):
    rng = random.Random(2)
    shape = lambda: (rng.uniform(-3, 3), rng.uniform(40, 46), rng.choice([0.5, 1.0, 0.7]), rng.choice([0.5, 1.0, 0.9]), rng.randint(3, 9), rng.randint(3, 9))
    ga, gb = [shape() for _ in range(6)], [shape() for _ in range(6)]
    gb[0] = (ga[0][0] + 9e-5, ga[0][1] - 9e-5, *ga[0][2:])
    value = lambda g, k: {(i, j): k * 1000 + i * 10 + j for i in range(g[4]) for j in range(g[5])}
    a, b = cells(spark, *(value(g, k) for k, g in enumerate(ga))), cells(spark, *(value(g, k) for k, g in enumerate(gb)))
    kind = "run int, lon1 double, lat1 double, di double, dj double, ni int, nj int"
    out = A.align_unlike(a, b, spark.createDataFrame([(k, *g) for k, g in enumerate(ga)], kind), spark.createDataFrame([(k, *g) for k, g in enumerate(gb)], kind), ["run"])
    got = {(r["run"], r["i"], r["j"]): r["b"] for r in out.collect()}
    assert len(got) == sum(g[4] * g[5] for g in ga)
    for (k, i, j), v in got.items():
        x, y = ga[k], gb[k]
        ci = i if k == 0 else math.floor((x[0] + i * x[2] - y[0]) / y[2] + 0.5)
        cj = j if k == 0 else math.floor((y[1] - (x[1] - j * x[3])) / y[3] + 0.5)
        assert v == (k * 1000 + ci * 10 + cj if 0 <= ci < y[4] and 0 <= cj < y[5] else None)
    one = A.align_unlike(a.filter("run = 1").drop("run"), b.filter("run = 1").drop("run"), *(spark.createDataFrame([g[1]], kind.split(", ", 1)[1]) for g in (ga, gb)))
    assert {(1, r["i"], r["j"]): r["b"] for r in one.collect()} == {k: v for k, v in got.items() if k[0] == 1}


def lambert(latin1, latin2, lov, lad):
    t = lambda d: math.tan(math.pi / 4 + math.radians(d) / 2)
    p1, p2 = math.radians(latin1), math.radians(latin2)
    n = math.sin(p1) if latin1 == latin2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(t(latin2) / t(latin1))
    f = 6371229 * math.cos(p1) * t(latin1) ** n / n
    r0 = f / t(lad) ** n
    forward = lambda lon, lat: (f / t(lat) ** n * math.sin(n * math.radians(lon - lov)), r0 - f / t(lat) ** n * math.cos(n * math.radians(lon - lov)))
    back = lambda x, y: (lov + math.degrees(math.atan2(x, r0 - y) / n), math.degrees(2 * math.atan((f / math.copysign(math.hypot(x, r0 - y), n)) ** (1 / n)) - math.pi / 2))
    return forward, back


def test_lambert_boxes_of_two_grids(spark):
    specs = [(20, 13, 50_000.0, 60_000.0, -105.0, 31.0, 38.5, 38.5, -97.5, 38.5), (9, 30, 80_000.0, 40_000.0, -100.0, 33.0, 30.0, 60.0, -95.0, 40.0)]
    value = lambda s, k: {(i, j): k * 10_000 + i * 100 + j for i in range(s[0]) for j in range(s[1])}
    kind = "run int, ni int, nj int, dx double, dy double, lo1 double, la1 double, latin1 double, latin2 double, lov double, lad double"
    grids = spark.createDataFrame([(k, *s) for k, s in enumerate(specs)], kind)
    out = A.resample_lambert(cells(spark, *(value(s, k) for k, s in enumerate(specs))), grids, 0.25, ["run"]).collect()
    seen = 0
    for k, s in enumerate(specs):
        forward, back = lambert(*s[6:])
        x0, y0 = forward(s[4], s[5])
        border = [(i, j) for i in range(0, s[0], 8) for j in (0, s[1] - 1)] + [(i, j) for j in range(0, s[1], 8) for i in (0, s[0] - 1)]
        lons, lats = zip(*(back(x0 + i * s[2], y0 + j * s[3]) for i, j in border), strict=True)
        own = {(r["ti"], r["tj"]): r for r in out if r["run"] == k}
        assert len(own) == math.ceil((max(lons) - min(lons) + 0.1) / 0.25) * math.ceil((max(lats) - min(lats) + 0.1) / 0.25)
        for (ti, tj), r in own.items():
            lon, lat = min(lons) - 0.05 + ti * 0.25, max(lats) + 0.05 - tj * 0.25
            assert (r["lon"], r["lat"]) == pytest.approx((lon, lat))
            x, y = forward(lon, lat)
            si, sj = math.floor((x - x0) / s[2] + 0.5), math.floor((y - y0) / s[3] + 0.5)
            want = k * 10_000 + si * 100 + sj if 0 <= si < s[0] and 0 <= sj < s[1] else None
            seen += want is not None
            assert r["value"] == want
    assert seen > 500


def test_freshest_of_the_best_tilts(spark):
    rng = random.Random(3)
    rows = [(s, round(rng.uniform(0, 2), 2), rng.randint(0, 9)) for s in (1, 1, 1, 2, None) for _ in range(20)]
    got = {r["site"]: (r["elevation"], r["time"]) for r in R.pick_sweep(spark.createDataFrame(rows, "site int, elevation double, time int"), ["site"], 0.8).collect()}
    for site in (1, 2, None):
        own = [(e, t) for s, e, t in rows if s == site]
        best = min(abs(e - 0.8) for e, _ in own)
        assert got[site] == min(((e, t) for e, t in own if abs(e - 0.8) <= best + 0.1), key=lambda r: (-r[1], abs(r[0] - 0.8), r[0]))


def test_calendar_of_any_number_of_models(spark):
    from skyframe.sources import catalog as C

    models = spark.range(1500).select(F.col("id").cast("string").alias("model"), F.lit(12).alias("step_h"), F.lit(3).alias("latency_h"), F.lit(6).alias("hourly_to"), F.lit(6).alias("max_hour"), F.lit(3).alias("coarse_h"))
    days = spark.sql("SELECT DATE '2026-07-12' AS day UNION ALL SELECT DATE '2026-07-13'")
    out = C.run_calendar(models, days, F.lit("2026-07-13 12:00:00").cast("timestamp_ntz"))
    assert out.count() == 1500 * 3
