"""Known values, invariants and edge cases of the operators that SQL does not check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import geo, reports, weather
from skyframe.operators import grid, profiles, radar, satellite, series, shapes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("t, rate", [(200, 85.193), (220, 6.692), (235, 0.963), (245, 0.261), (250, 0), (300, 0)])
def test_published_rain_rates(spark, t, rate):
    assert one(spark, weather.auto_estimator_rate(float(t))) == pytest.approx(rate, rel=2e-3, abs=1e-9)


def test_gate_codes_and_missing(spark):
    assert one(spark, weather.gate_value("66", "2", "66")) == 0
    assert one(spark, weather.gate_value("127", "2", "129")) == -1
    assert one(spark, weather.gate_value("1", "2", "66")) is None
    assert one(spark, weather.encode_gate("CAST(NULL AS DOUBLE)", "2", "66", "255")) == 0


def test_lambert_and_fixed_grid_round_trips(spark):
    g, s = geo.lambert(38.5, 38.5, -97.5, 38.5), geo.fixed_grid()
    for lat, lon in ((30.0, -100.0), (45.5, -80.25)):
        assert one(spark, g["lat"](g["x"].sql(lat, lon), g["y"].sql(lat, lon))) == pytest.approx(lat)
        assert one(spark, s["lon"](s["x"].sql(lat, lon), s["y"].sql(lat, lon))) == pytest.approx(lon)
    assert one(spark, s["lon"]("0.2", "0.0")) is None


def test_retrieval_inequalities(spark):
    f = satellite.rate_formula()
    core, anvil = one(spark, f("205", "206", "200", "225", "NULL")), one(spark, f("205", "206", "200", "205", "NULL"))
    assert core > anvil
    assert one(spark, f("215", "210", "200", "225", "NULL")) < one(spark, f("215", "215", "200", "225", "NULL"))  # thin cirrus
    assert one(spark, f("215", "210", "200", "215", "1.5")) > one(spark, f("215", "210", "200", "215", "NULL"))  # lightning
    assert one(spark, f("CAST(NULL AS DOUBLE)", "210", "200", "215", "1.5")) is None


def sweep(v, n=36, gates=40):
    return np.full((n, gates), float(v))


def test_unfolded_velocity_differs_by_whole_intervals():
    rng = np.random.default_rng(1)
    true = np.cumsum(rng.normal(0, 0.6, (36, 40)), axis=1)
    vn = np.full(36, 8.0)
    folded = (true + 8) % 16 - 8
    out = radar.despoke_median(radar.despoke_pairs(radar.unfold(folded, vn), vn), vn)
    k = (out - folded) / 16
    assert np.allclose(k, np.round(k))


def test_despoke_leaves_a_smooth_sweep_alone():
    vn = np.full(36, 8.0)
    smooth = np.sin(np.linspace(0, 2 * np.pi, 36, endpoint=False))[:, None] * 5 + sweep(0)
    assert np.allclose(radar.despoke_median(radar.despoke_pairs(smooth.copy(), vn), vn), smooth)
    spoke = smooth.copy()
    spoke[7] += 16
    assert np.allclose(radar.despoke_pairs(spoke, vn), smooth)
    assert np.isnan(radar.unfold(np.full((3, 5), np.nan), np.full(3, 8.0))).all()


def test_dealias_keeps_missing_gates(spark):
    g = spark.createDataFrame([(1, 0.5, k, None if k == 2 else float(k % 3)) for k in range(6)], "sweep int, azimuth double, gate int, value double")
    rows = {r["gate"]: r["unfolded"] for r in radar.dealias(g, ["sweep"], F.lit(10.0)).collect()}
    assert rows[2] is None and rows[1] == 1.0


def test_storm_relative_velocity_of_a_pure_wind_is_zero(spark):
    g = spark.range(360 * 8).select(F.lit(1).alias("sweep"), (F.col("id") % 360).cast("double").alias("azimuth"), F.floor(F.col("id") / 360).alias("gate"))
    g = g.withColumn("value", 7 * F.sin(F.radians("azimuth")) - 3 * F.cos(F.radians("azimuth")))
    assert radar.storm_relative(g, ["sweep"]).agg(F.max(F.abs("value"))).first()[0] < 1e-9


def test_pooling_a_constant_and_equal_members(spark):
    g = spark.range(720 * 4).select(F.lit(1).alias("sweep"), ((F.col("id") % 720) * 0.5 + 0.25).alias("azimuth"), (2000 + F.floor(F.col("id") / 720) * 250).alias("range_m"), F.lit(12.5).alias("value"))
    assert radar.pool_legacy(g, ["sweep"], 1000.0, 2000.0).select("value").distinct().collect() == [(12.5,)]
    m = spark.createDataFrame([(0, 0, k, 4.0) for k in range(5)], "i int, j int, member int, value double")
    assert grid.ensemble_mean(m, ["i", "j"], 5).first()["value"] == 4.0
    assert grid.ensemble_mean(m.filter("member < 2"), ["i", "j"], 5).first()["value"] is None


def test_contours_lie_on_cell_edges_and_close(spark):
    cells = spark.range(100).select((F.col("id") % 10).cast("int").alias("i"), F.floor(F.col("id") / 10).cast("int").alias("j")).withColumn("value", 50.0 - F.pow(F.col("i") - 4.5, 2) - F.pow(F.col("j") - 4.5, 2))
    seg = grid.contour_segments(cells, 10, 10, 15.0, 30.0)
    assert all(r.x1 == int(r.x1) or r.y1 == int(r.y1) for r in seg.collect())
    lines = grid.contour_lines(seg).collect()
    assert {r["level"] for r in lines} == {30.0, 45.0} and all(r["points"][0] == r["points"][-1] for r in lines)


def test_kept_centres_are_apart(spark):
    df = spark.range(200).select(F.lit("H").alias("kind"), (F.col("id") % 20).alias("i"), F.floor(F.col("id") / 20).alias("j"), ((F.col("id") * 37) % 101).alias("score"))
    kept = grid.suppress_nearby(df, "kind", "score", "i", "j", 4, 18).collect()
    assert all((a.i - b.i) ** 2 + (a.j - b.j) ** 2 >= 16 for a in kept for b in kept if a is not b)


def test_points_in_rectangles(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0))))
    pts = spark.range(64).select((F.col("id") % 8 + 0.5).alias("lon"), (F.floor(F.col("id") / 8) + 0.5).alias("lat"))
    hit = shapes.points_in_polygons(pts, spark.range(1).select(F.col("id").alias("poly"), ring.alias("ring")))
    assert hit.count() == 12


def test_report_texts(spark):
    assert one(spark, reports.report_type_name(F.lit(" TSTM  WND DMG "))) == "T-storm Wind Damage"
    assert one(spark, reports.report_type_name(F.lit(None).cast("string"))) == "Report"
    assert one(spark, reports.report_category(F.lit("marine tstm wind"))) == "wind"
    assert one(spark, reports.report_id([F.lit("a"), F.lit(None).cast("string")], F.lit("77"))) == "lsr:77"
    assert one(spark, reports.parse_motion(F.lit("no motion"))) is None


def test_asof_ties_and_empty_sides(spark):
    left = spark.createDataFrame([(1, 10, 5)], "s int, time long, key int")
    right = spark.createDataFrame([(1, 10, 7), (1, 11, 8)], "s int, time long, key int")
    assert series.asof_join(left, right, "s", "time", "key").first()["right_key"] == 7
    assert series.asof_join(left, right.limit(0), "s", "time", "key").first()["right_key"] is None


def test_wind_at_levels(spark):
    lv = spark.createDataFrame([(1, 1000.0, 0.0, 20.0, 15.0, 2.0, 0.0), (1, 900.0, 1000.0, 15.0, 10.0, 12.0, 0.0), (1, 800.0, 2000.0, 8.0, 2.0, 12.0, 4.0)], "k int, p double, zagl double, t double, td double, u double, v double")
    p = profiles.build_profiles(lv, "k")
    at = p.select(*(profiles.wind_at(F.lit(h))["u"].alias(f"h{int(h)}") for h in (-5.0, 500.0, 9000.0))).first()
    assert tuple(at) == (2.0, 7.0, 12.0)
    parcel = profiles.lift_parcel(p).first()["parcel"]
    assert all(a["p"] > b["p"] and a["t"] > b["t"] for a, b in zip(parcel, parcel[1:]))


def test_open_alerts_stay_active(spark):
    a = spark.sql("SELECT id, sent, CAST(NULL AS TIMESTAMP_NTZ) onset, ends, cancel FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01', NULL, false), (2, TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-03', false), (3, TIMESTAMP_NTZ '2024-01-01', NULL, true), (4, TIMESTAMP_NTZ '2026-01-01', NULL, false) t(id, sent, ends, cancel)")
    t = spark.sql("SELECT k, time FROM VALUES (0, TIMESTAMP_NTZ '2023-12-31'), (1, TIMESTAMP_NTZ '2024-01-02'), (2, TIMESTAMP_NTZ '2024-01-03'), (3, TIMESTAMP_NTZ '2025-06-01') t(k, time)")
    assert sorted((r["k"], r["id"]) for r in shapes.active_at(a, t).collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    assert shapes.active_at(a, t.limit(0)).count() == 0


def test_every_event_is_a_time_of_j10(spark):
    from skyframe.plans.registry import QUERIES

    got = QUERIES["j10_active_at_every_time"](spark, "/root/testdata/sf0.001")
    assert got.filter("event_id % 50 <> 0").count() > got.filter("event_id % 50 = 0").count() > 0


def test_nearest_site_equals_brute_force_beyond_20000_sites(spark):
    rng = np.random.default_rng(3)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 21_000))), rng.uniform(-180, 180, 21_000)
    lat[:9000], lon[:9000] = rng.uniform(40, 41, 9000), rng.uniform(-100, -99, 9000)  # a crowded corner
    places = [(k, float(a), float(o)) for k, (a, o) in enumerate([(90.0, 0.0), (-89.99, 10.0), (0.0, 180.0), (0.0, -179.999), (40.5, -99.5), *zip(rng.uniform(-90, 90, 45), rng.uniform(-180, 180, 45), strict=True)])]
    p = spark.createDataFrame([*places, (99, None, 1.0)], "place long, lat double, lon double")
    for n in (21_000, 9_000, 1):
        s = spark.createDataFrame(list(zip(range(n), lat[:n].tolist(), lon[:n].tolist(), strict=True)), "site long, lat double, lon double")
        got = {r["place"]: (r["site"], r["dist_m"]) for r in shapes.nearest_site(p, s, "place").collect()}
        assert got.pop(99) == (None, None) and len(got) == len(places)
        for k, a, o in places:
            x = np.sin(np.radians(lat[:n] - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(lat[:n])) * np.sin(np.radians(lon[:n] - o) / 2) ** 2
            d = 2 * geo.R_EARTH * np.arcsin(np.minimum(1, np.sqrt(x)))
            assert got[k][1] == pytest.approx(d.min(), rel=1e-9, abs=1e-3) and d[got[k][0]] == pytest.approx(d.min(), rel=1e-9, abs=1e-3)


def test_tilts_are_collected_once_per_elevation(spark):
    s = spark.range(5000).select(F.lit("a").alias("site"), (F.col("id") % 7 * 0.07).alias("elevation"), (F.col("id") * 37 % 5000).alias("time"))
    out = radar.dedupe_tilts(s, ["site"])
    want = []
    for e, t in sorted({(r["elevation"], r["time"]) for r in s.collect()}):
        if want and e - want[-1][0] <= 0.1:
            want[-1] = (e, t) if t > want[-1][1] else want[-1]
        else:
            want.append((e, t))
    assert sorted((r["elevation"], r["time"]) for r in out.collect()) == want
    assert "max(time" in out._jdf.queryExecution().optimizedPlan().toString()  # repeats go before the array is made
