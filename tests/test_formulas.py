"""Scalar formulas against Python written from their definitions, over random arguments, in Spark and in DuckDB."""

import math
import random

import duckdb
import pytest

from skyframe.functions import geo as G
from skyframe.functions import weather as M

R, EARTH43 = 6371008.8, 4 / 3 * 6371000.0
rad, deg = math.radians, math.degrees
half_up = lambda x: math.floor(x + 0.5)
clamp = lambda x, lo=0.0, hi=1.0: max(lo, min(hi, x))
mag = lambda t: 17.625 * (t - 273.15) / (243.04 + t - 273.15)


def unit(lat, lon):
    return (math.cos(rad(lat)) * math.cos(rad(lon)), math.cos(rad(lat)) * math.sin(rad(lon)), math.sin(rad(lat)))


def arc(a, b, c, d):
    """Great-circle metres by the angle between unit vectors."""
    p, q = unit(a, b), unit(c, d)
    cross = math.dist((0, 0, 0), (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]))
    return R * math.atan2(cross, sum(map(math.prod, zip(p, q, strict=True))))


def moved(lat, lon, brg, m):
    """The unit vector turned along the bearing by m / R."""
    n = (-math.sin(rad(lat)) * math.cos(rad(lon)), -math.sin(rad(lat)) * math.sin(rad(lon)), math.cos(rad(lat)))
    e = (-math.sin(rad(lon)), math.cos(rad(lon)), 0.0)
    x, y, z = (u * math.cos(m / R) + (a * math.cos(rad(brg)) + b * math.sin(rad(brg))) * math.sin(m / R) for u, a, b in zip(unit(lat, lon), n, e, strict=True))
    return deg(math.asin(z)), deg(math.atan2(y, x))


def ground(s, el):
    h = math.sqrt(s * s + EARTH43**2 + 2 * s * EARTH43 * math.sin(rad(el))) - EARTH43
    return EARTH43 * math.asin(s * math.cos(rad(el)) / (EARTH43 + h))


def slant(d, el):
    s = d / max(math.cos(rad(el)), 0.05)
    for _ in range(2):
        s = s * d / ground(s, el)
    return s


def heat(f, rh):
    simple = 0.5 * (f + 61 + (f - 68) * 1.2 + rh * 0.094)
    if (simple + f) / 2 < 80:
        return simple
    c = [-42.379, 2.04901523, 10.14333127, -0.22475541, -6.83783e-3, -5.481717e-2, 1.22874e-3, 8.5282e-4, -1.99e-6]
    out = sum(a * b for a, b in zip(c, [1, f, rh, f * rh, f * f, rh * rh, f * f * rh, f * rh * rh, f * f * rh * rh], strict=True))
    if rh < 13 and 80 <= f <= 112:
        out -= (13 - rh) / 4 * math.sqrt(max(0, 17 - abs(f - 95)) / 17)
    if rh > 85 and 80 <= f <= 87:
        out += (rh - 85) / 10 * (87 - f) / 5
    return out


def feels(t, rh, u, v):
    f, mph = t * 1.8 - 459.67, math.hypot(u, v) * 3600 / 1609.344
    out = heat(f, rh) if f >= 80 else 35.74 + 0.6215 * f + (0.4275 * f - 35.75) * mph**0.16 if f <= 50 and mph > 3 else f
    return (out + 459.67) / 1.8


def dew_c(t, rh, a=17.67, b=243.5):
    g = math.log(clamp(rh, 1, 100) / 100) + a * t / (b + t)
    return b * g / (a - g)


def nice(span):
    raw = span / 8
    p = 10.0 ** math.floor(math.log10(raw))
    return p * (1 if raw / p < 1.5 else 2 if raw / p < 3.5 else 5 if raw / p < 7.5 else 10)


def sun(lat, lon, day, part):
    g = 2 * math.pi / 365 * (day - 1.5 + part)
    dec = 0.006918 - 0.399912 * math.cos(g) + 0.070257 * math.sin(g) - 0.006758 * math.cos(2 * g) + 0.000907 * math.sin(2 * g) - 0.002697 * math.cos(3 * g) + 0.00148 * math.sin(3 * g)
    eq = 229.18 * (0.000075 + 0.001868 * math.cos(g) - 0.032077 * math.sin(g) - 0.014615 * math.cos(2 * g) - 0.040849 * math.sin(2 * g))
    hour = (part * 1440 + eq + 4 * lon) / 4 - 180
    return math.sin(rad(lat)) * math.sin(dec) + math.cos(rad(lat)) * math.cos(dec) * math.cos(rad(hour))


def weight(s):
    x = clamp((deg(math.asin(s)) + 6) / 12)
    return x * x * (3 - 2 * x)


LAT, LON, PCT, SIGNED, TEMP = (-89, 89), (-179, 179), (-20, 120), (-30, 30), (180, 330)
#: formula, ranges of its arguments (a list: picks), the same in Python.
CASES = {
    "haversine": (G.haversine, [LAT, LON, LAT, LON], arc),
    "bearing": (G.bearing, [LAT, LON, LAT, LON], lambda a, b, c, d: deg(math.atan2(math.sin(rad(d - b)) * math.cos(rad(c)), math.cos(rad(a)) * math.sin(rad(c)) - math.sin(rad(a)) * math.cos(rad(c)) * math.cos(rad(d - b))))),
    "destination_lat": (G.destination_lat, [LAT, LON, (0, 360), (1, 9e5)], lambda *a: moved(*a)[0]),
    "destination_lon": (G.destination_lon, [LAT, LON, (0, 360), (1, 9e5)], lambda *a: moved(*a)[1]),
    "along_track": (G.along_track, [LAT, LON, (0, 360), LAT, LON], lambda a, b, h, c, d: 111320 * ((d - b) * math.cos(rad(a)) * math.sin(rad(h)) + (c - a) * math.cos(rad(h)))),
    "cone_half_width": (G.cone_half_width, [(0, 1e6)], lambda d: 4000 + 0.28 * d),
    "beam_height": (G.beam_height, [(0, 5e5), (0, 20)], lambda s, el: math.sqrt((s * math.cos(rad(el))) ** 2 + (EARTH43 + s * math.sin(rad(el))) ** 2) - EARTH43),
    "ground_distance": (G.ground_distance, [(1, 5e5), (0, 20)], ground),
    "slant_range": (G.slant_range, [(1000, 4e5), (0, 20)], slant),
    "merc_x": (G.merc_x, [LON], lambda x: (x + 180) / 360),
    "merc_y": (G.merc_y, [(-85, 85)], lambda y: (1 - math.asinh(math.tan(rad(y))) / math.pi) / 2),
    "wind_speed": (G.wind_speed, [SIGNED, SIGNED], math.hypot),
    "wind_dir": (G.wind_dir, [SIGNED, SIGNED], lambda u, v: (270 - deg(math.atan2(v, u))) % 360),
    "km_per_pixel": (G.km_per_pixel, [(-1e-3, 1e-3), (4.2e7, 4.3e7), (6.3e6, 6.4e6)], lambda a, h, r: abs(a) * (h - r) / 1000),
    "in_lon_range": (G.in_lon_range, [LON, LON, LON], lambda x, w, e: w <= x <= e if w <= e else x >= w or x <= e),
    "wrap_lon": (G.wrap_lon, [(-900, 900)], lambda x: (x + 180) % 360 - 180),
    "sun_height": (G.sun_height, [LAT, LON, (1, 365), (0, 1)], sun),
    "day_weight": (G.day_weight, [(-0.3, 0.3)], weight),
    "gate_value": (M.gate_value, [[0, 1, 2, 3, 77, 255], [0, 1, 2, 10], [30, 64, 0]], lambda c, s, o: None if c < 2 else (c - o) / (s or 1)),
    "encode_gate": (M.encode_gate, [(-80, 200), [1, 2, 10], [30, 64], [255]], lambda v, s, o, m: min(m, max(2, half_up(v * s + o)))),
    "quantize": (M.quantize, [(-50, 150), [0], [100]], lambda v, a, b: 1 + half_up(clamp((v - a) / (b - a)) * 65534)),
    "dequantize": (M.dequantize, [[0, 1, 2, 40000, 65535], [-10], [90]], lambda c, a, b: a + (c - 1) / 65534 * (b - a) if c > 0 else None),
    "dewpoint": (M.dewpoint, [(230, 320), PCT], lambda t, rh: dew_c(t - 273.15, rh, 17.625, 243.04) + 273.15 if rh > 0 else None),
    "relative_humidity": (M.relative_humidity, [(230, 320), (230, 320)], lambda t, td: clamp(100 * math.exp(mag(td) - mag(t)), 0, 100)),
    "dew_from_rh": (M.dew_from_rh, [(-40, 45), PCT], dew_c),
    "heat_index": (M.heat_index, [(60, 118), (1, 100)], heat),
    "feels_like": (M.feels_like, [(240, 320), (1, 100), SIGNED, SIGNED], feels),
    "feels_like_from_dewpoint": (M.feels_like_from_dewpoint, [(240, 320), (240, 320), SIGNED, SIGNED], lambda t, td, u, v: feels(t, clamp(100 * math.exp(mag(td) - mag(t)), 0, 100), u, v)),
    "lapse_rate": (M.lapse_rate, [TEMP, TEMP, (2000, 6000), (2000, 6000)], lambda a, b, h, g: (a - b) / (h - g) * 1000 if h > g else None),
    "ehi": (M.ehi, [(-500, 5000), (-200, 500)], lambda c, h: max(0, c) * h / 160000),
    "scp": (M.scp, [(0, 5000), (-200, 500), (0, 40)], lambda c, h, s: 0 if s < 10 else max(0, c / 1000 * h / 50 * min(s, 20) / 20)),
    "stp": (M.stp, [(0, 5000), (0, 3000), (-200, 500), (0, 40), (-300, 20)], lambda c, z, h, s, n: max(0, c / 1500 * clamp((2000 - z) / 1000) * h / 150 * (0 if s < 12.5 else 1.5 if s > 30 else s / 20) * (1 if n >= -50 else 0 if n < -200 else (200 + n) / 150))),
    "precip_type_rate": (M.precip_type_rate, [[-1e-3, 0, 1e-4, 0.002, 0.02], [0, 1], [0, 1], [0, 1], [0, 1]], lambda r, a, f, i, s: None if r <= 0 else 50 * (3 if s else 2 if i else 1 if f else 0) + min(49.99, r * 3600)),
    "kuchera_ratio": (M.kuchera_ratio, [(240, 290)], lambda t: 12 + 2 * (271.16 - t) if t <= 271.16 else max(0, 12 + (271.16 - t))),
    "auto_estimator_rate": (M.auto_estimator_rate, [(-5, 300)], lambda t: 1.1183e11 * math.exp(-0.036382 * t**1.2) if 0 < t < 250 else 0),
    "echo_top": (M.echo_top, [[0, 2, 70, 127, 128, 200, 255]], lambda c: (c & 0x7F) - 2),
    "tier4": (M.tier4, [(0, 10), [2], [5], [7]], lambda v, a, b, c: (v >= a) + (v >= b) + (v >= c)),
    "nice_step": (M.nice_step, [(0.1, 900)], nice),
    "pressure_code": (M.pressure_code, [(950, 1060)], lambda p: f"{half_up(p * 10) % 1000:03}"),
    "storm_category": (M.storm_category, [(0, 180)], lambda w: ["Tropical Depression", "Tropical Storm", *(f"Category {k}" for k in range(1, 6))][sum(w >= x for x in (34, 64, 83, 96, 113, 137))]),
    "flight_category": (M.flight_category, [(0, 9), (0, 5000)], lambda v, c: "LIFR" if v < 1 or c < 500 else "IFR" if v < 3 or c < 1000 else "MVFR" if v <= 5 or c <= 3000 else "VFR"),
    "exceedance": (M.exceedance, [(-5, 50), (-1, 3)], lambda q, r: q * (1 - 1 / r) if q > 0 and r > 1 else None),
    "guidance": (M.guidance, [(-5, 50), (-1, 3)], lambda q, r: q / r if q > 0 and r > 0 else None),
    "calibrate": (M.calibrate, [[47, 46, 1000], [0.02], [-3], [47]], lambda c, s, o, f: None if c == f else c * s + o),
    "planck_temperature": (M.planck_temperature, [(-1, 150), [10803.3], [1392.74], [0.0755], [0.99975]], lambda r, a, b, c, d: (b / math.log(a / r + 1) - c) / d if r > 0 else None),
    "ir_gray": (M.ir_gray, [(170, 330)], lambda t: math.floor(255 * clamp((313 - t) / 130))),
    "visible_gray": (M.visible_gray, [(-0.2, 1.3)], lambda x: math.floor(255 * math.sqrt(clamp(x)))),
    "stretch": (M.stretch, [(200, 310), [243.6], [292.6], [1.0, 1.2, 2.2]], lambda v, a, b, g: math.floor(255 * clamp((v - a) / (b - a)) ** (1 / g))),
    "compass": (G.compass, [(-720, 720)], lambda d: "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()[half_up(d % 360 / 22.5) % 16]),
    "boxes_overlap": (G.boxes_overlap, [(0, 5), (0, 5), (5, 9), (5, 9), (0, 12), (0, 12), (12, 15), (12, 15)], lambda w, s, e, n, w2, s2, e2, n2: w <= e2 and w2 <= e and s <= n2 and s2 <= n),
    "best_satellite": (G.best_satellite, [["WP", "IO", "SH", "AL", "EP"], LON], lambda b, x: "HIMAWARI" if b in ("WP", "IO", "SH") and (x > 80 or x < -170) else "WEST" if x < -105 else "EAST"),
}


def rows_of(name):
    rng = random.Random(name)
    return [tuple(rng.choice(r) if isinstance(r, list) else rng.uniform(*r) for r in CASES[name][1]) for _ in range(150)]


def literal(v):
    return f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)"


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        if isinstance(w, float) and g is not None:
            assert float(g) == pytest.approx(w, rel=1e-9, abs=1e-6)
        else:
            assert (float(g) if isinstance(w, int) and not isinstance(w, bool) and g is not None else g) == w


def values(name, rows):
    n = len(rows[0])
    body = ", ".join(f"({k}, {', '.join(map(literal, r))})" for k, r in enumerate(rows))
    return f"SELECT {CASES[name][0].sql(*(f'a{k}' for k in range(n)))} AS v FROM (VALUES {body}) AS t(k, {', '.join(f'a{k}' for k in range(n))}) ORDER BY k"


@pytest.mark.parametrize("name", sorted(CASES))
def test_in_duckdb(name):
    rows = rows_of(name)
    same([r[0] for r in duckdb.sql(values(name, rows)).fetchall()], [CASES[name][2](*r) for r in rows])


@pytest.mark.parametrize("name", sorted(CASES))
def test_in_spark(spark, name):
    rows = rows_of(name)[:60]
    same([r["v"] for r in spark.sql(values(name, rows)).collect()], [CASES[name][2](*r) for r in rows])


def test_lambert_and_back():
    """Known answers: the cone's origin, its true scale along the parallel, and the way back."""
    f = G.lambert(38.5, 38.5, -97.5, 38.5)
    x, y = duckdb.sql(f"SELECT {f['x'].sql('38.5', '-97.5')}, {f['y'].sql('38.5', '-97.5')}").fetchall()[0]
    assert (x, y) == pytest.approx((0, 0), abs=1e-6)
    step = duckdb.sql(f"SELECT {f['x'].sql('38.5', '-97.499')}").fetchall()[0][0]
    assert step == pytest.approx(6371229 * math.cos(rad(38.5)) * rad(0.001), rel=1e-6)
    for lat, lon in ((25.0, -120.0), (50.0, -70.0)):
        x, y = duckdb.sql(f"SELECT {f['x'].sql(str(lat), str(lon))}, {f['y'].sql(str(lat), str(lon))}").fetchall()[0]
        assert duckdb.sql(f"SELECT {f['lat'].sql(repr(x), repr(y))}, {f['lon'].sql(repr(x), repr(y))}").fetchall()[0] == pytest.approx((lat, lon))


def test_fixed_grid_looks_from_the_satellite():
    """The scan angles of a place are those of the ray from the satellite to it on the ellipsoid; off the disk there are none."""
    h, req, rpol, lon0 = G.GEO_H, G.GEO_REQ, G.GEO_RPOL, G.GEO_LON0
    for sweep in "xy":
        f = G.fixed_grid(sweep=sweep)
        for lat, lon in ((35.0, -97.0), (-20.0, -60.0), (0.0, lon0), (50.0, -120.0)):
            c = math.atan((rpol / req) ** 2 * math.tan(rad(lat)))
            n = rpol / math.sqrt(1 - (1 - (rpol / req) ** 2) * math.cos(c) ** 2)
            px, py, pz = h - n * math.cos(c) * math.cos(rad(lon - lon0)), n * math.cos(c) * math.sin(rad(lon - lon0)), n * math.sin(c)
            far = math.sqrt(px * px + py * py + pz * pz)
            want = (math.asin(py / far), math.atan2(pz, px)) if sweep == "x" else (math.atan2(-py, px), math.asin(-pz / far))
            x, y = duckdb.sql(f"SELECT {f['x'].sql(str(lat), str(lon))}, {f['y'].sql(str(lat), str(lon))}").fetchall()[0]
            assert (x, y) == pytest.approx(want, abs=1e-12)
            assert duckdb.sql(f"SELECT {f['lat'].sql(repr(x), repr(y))}, {f['lon'].sql(repr(x), repr(y))}").fetchall()[0] == pytest.approx((lat, lon), abs=1e-9)
        assert duckdb.sql(f"SELECT {f['x'].sql('10.0', '100.0')}").fetchall()[0] == (None,)
