"""Lifted parcels, towns on a storm's track and catalogues of products against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from skyframe.operators import products, profiles, shapes

LEVELS = [(0.0, 1000.0, 30.0, 22.0, 2.0, 3.0), (800.0, 910.0, 22.0, 15.0, 5.0, 4.0), (3000.0, 700.0, 8.0, -2.0, 12.0, 6.0), (5600.0, 500.0, -12.0, -25.0, 20.0, 9.0), (9200.0, 300.0, -40.0, -60.0, 30.0, 9.0), (16000.0, 100.0, -65.0, -90.0, 10.0, 0.0)]


def parcel(p0, t0, td0, top=100.0):
    ratio = lambda td, p: 0.622 * (e := 6.112 * math.exp(17.67 * td / (td + 243.5))) / (p - e)
    theta, w0 = (t0 + 273.15) * (1000 / p0) ** 0.2854, ratio(td0, p0)
    dry = lambda p: theta * (p / 1000) ** 0.2854 - 273.15
    lcl = top
    for k in range(int((p0 - top) // 2) + 1):
        p = p0 - 2 * k
        x = math.log(w0 * p / (0.622 + w0) / 6.112)
        if 243.5 * x / (17.67 - x) >= dry(p):
            lcl = p
            break
    out = [(p, dry(p)) for p in (p0 - 10 * k for k in range(int((p0 - top) // 10) + 1)) if p > lcl]
    p, t = lcl, dry(lcl)
    out.append((p, t))
    for _ in range(int((lcl - top) // 10)):
        tk, w = t + 273.15, ratio(t, p)
        t -= 10 * (287 * tk / p + 2.501e6 * w / p) / (1004 + 2.501e6**2 * 0.622 / 287 * w / tk**2)
        p -= 10
        out.append((p, t))
    return out


def test_parcel_equals_a_plain_loop(spark):
    rows = [(n, z, p, t + n, td + 2 * n, u, v) for n in range(4) for z, p, t, td, u, v in LEVELS]
    held = profiles.build_profiles(spark.createDataFrame(rows, "id int, zagl double, p double, t double, td double, u double, v double"), "id")
    got = {}
    for r in profiles.parcel_buoyancy(held, "id").collect():
        got.setdefault(r["id"], []).append((r["p"], r["t_parcel"], r["t_env"], r["sign"]))
    for n in range(4):
        want = parcel(1000.0, 30.0 + n, 22.0 + 2 * n)
        found = sorted(got[n], reverse=True)
        assert [p for p, *_ in found] == pytest.approx([p for p, _ in want]) and [t for _, t, *_ in found] == pytest.approx([t for _, t in want])
        for p, t, env, sign in found:
            below = [x for x in LEVELS if x[1] >= p][-1]
            above = next((x for x in LEVELS if x[1] < p), None)
            e = LEVELS[-1][2] + n if above is None else below[2] + n + (above[2] - below[2]) * math.log(below[1] / p) / math.log(below[1] / above[1])
            assert env == pytest.approx(e) and sign == (t > e) - (t < e)


def move(lat, lon, brg, dist, r=6371008.8):
    d, la, b = dist / r, math.radians(lat), math.radians(brg)
    s = math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(b)
    return math.degrees(math.asin(s)), lon + math.degrees(math.atan2(math.sin(b) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * s))


def inside(lat, lon, ring):
    odd = False
    for (la, lo), (lb, lp) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (la > lat) != (lb > lat) and lon < (lp - lo) * (lat - la) / (lb - la) + lo:
            odd = not odd
    return odd


def test_towns_on_a_track(spark):
    storms = [(1, 38.0, -97.0, 60.0, 15.0, 90.0), (2, 35.0, -100.0, 200.0, 25.0, 60.0)]
    places = [(k, 33 + (k * 37 % 100) * 0.06, -102 + (k * 61 % 100) * 0.07) for k in range(600)]
    want = []
    for storm, lat, lon, brg, mps, minutes in storms:
        total = mps * minutes * 60
        axis = [(move(lat, lon, brg, total * k / 24), 4000 + 0.28 * total * k / 24) for k in range(25)]
        left, right = ([move(*at, brg + turn, half) for at, half in axis] for turn in (-90, 90))
        ring = left + right[::-1] + left[:1]
        towns = []
        for k, la, lo in places:
            along = (lo - lon) * 111320 * math.cos(math.radians(lat)) * math.sin(math.radians(brg)) + (la - lat) * 111320 * math.cos(math.radians(brg))
            if inside(la, lo, ring) and -2000 <= along <= total:
                towns.append((max(0.0, along) / mps / 60, k))
        want += [(storm, k, pytest.approx(eta), n, len(towns)) for n, (eta, k) in enumerate(sorted(towns)[:5], 1)]
    out = shapes.storm_track(
        spark.createDataFrame(storms, "storm int, lat double, lon double, bearing double, mps double, minutes double"),
        spark.createDataFrame(places, "place int, lat double, lon double").withColumn("name", F.lit("x")), 5,
    )
    got = [(r["storm"], r["place"], r["eta_min"], r["position"], r["n_towns"]) for r in out.orderBy("storm", "position").collect()]
    assert len(got) > 4 and got == want


def test_catalogues():
    assert (len(products.MODEL), len(products.MOSAIC), len(products.ANALYSIS), len(products.MICROWAVE)) == (54, 55, 7, 10)
    assert len(products.model_products("other")) == 54 and products.default_product("gfs") == "REFC" and products.default_product("aigfs") == "W200"
    assert "QPF1" not in products.model_products("nam") and products.model_products("aifs")[0] == "TMP"
    low = products.product_for_model("rap", "LTNG", products.MODEL)
    assert low.fields[0].level == "surface" and products.MODEL["LTNG"].fields[0].level == "entire atmosphere"
    mine = products.with_product(products.MODEL, "OWN", [("TMP", "2 m above ground")])
    assert "OWN" in mine and "OWN" not in products.MODEL


def test_short_totals_and_gaps(spark):
    """A total of a window needs both of its ends; before the window opens it is the total so far."""
    rows = [("APCP", "surface", f"0-{h} hour acc fcst", h, float(v)) for h, v in ((3, 2), (6, 5), (7, 10), (13, 4), (30, 20))]
    cells = spark.createDataFrame(rows, "var string, level string, acc string, hour int, value double").selectExpr("0 AS run", "hour", "0 AS i", "0 AS j", "var", "level", "acc", "value")
    got = {r["hour"]: r["value"] for r in products.product(cells, "QPF6").collect()}
    assert got == {3: 2.0, 6: 5.0, 13: 0.0}  # hour 7 lacks hour 1, hour 30 lacks hour 24, rain never falls back
