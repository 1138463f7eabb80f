"""Queries of profiles, products and archive catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import geo as G
from skyframe.functions import weather as M
from skyframe.operators import products as K
from skyframe.operators import profiles as V
from skyframe.plans.base import derivation, query
from skyframe.sources import catalog as C

LV = "SELECT profile, p::DOUBLE AS p, t, td, u, v, zagl::DOUBLE AS zagl FROM [profile]"


def _profiles(x):
    return V.build_profiles(x.d("profile"), "profile")


@query("m28_build_profiles", "SELECT profile, count(*)::INT AS n, max(p) AS p_sfc FROM [profile] GROUP BY 1 HAVING count(*) >= 3")
def _(x):
    return _profiles(x).select("profile", F.size("levels").alias("n"), F.element_at("levels", 1)["p"].cast("long").alias("p_sfc"))


@query("w20_m27_wind_shear", f"""WITH l AS ({LV}), a AS (SELECT profile, max(zagl) FILTER (WHERE zagl < 3130) AS z0, min(zagl) FILTER (WHERE zagl >= 3130) AS z1, min(zagl) AS zs FROM l GROUP BY 1)
SELECT a.profile, round(b.u + (c.u - b.u) * (3130 - b.zagl) / (c.zagl - b.zagl), 6) AS u, round(sqrt(pow(b.u + (c.u - b.u) * (3130 - b.zagl) / (c.zagl - b.zagl) - s.u, 2) + pow(b.v + (c.v - b.v) * (3130 - b.zagl) / (c.zagl - b.zagl) - s.v, 2)) * 1.943844, 5) AS shear
FROM a JOIN l b ON b.profile = a.profile AND b.zagl = a.z0 JOIN l c ON c.profile = a.profile AND c.zagl = a.z1 JOIN l s ON s.profile = a.profile AND s.zagl = a.zs""")
def _(x):
    out = _profiles(x).filter(F.exists("levels", lambda z: z["zagl"] < 3130) & F.exists("levels", lambda z: z["zagl"] >= 3130))
    return out.select("profile", F.round(V.wind_at(F.lit(3130.0))["u"], 6).alias("u"), F.round(V.bulk_shear_kt(3130.0), 5).alias("shear"))


_E = lambda td: f"(6.112 * exp(17.67 * {td} / ({td} + 243.5)))"
_W = f"(0.622 * {_E('td')} / (p - {_E('td')}))"


@query("w23_m9_pwat_lapse", f"""WITH l AS (SELECT *, {_W} AS w FROM ({LV})), s AS (SELECT *, (w + lag(w) OVER (PARTITION BY profile ORDER BY zagl)) / 2 * (lag(p) OVER (PARTITION BY profile ORDER BY zagl) - p) * 100 / 9.81 AS part FROM l)
SELECT profile, round(sum(part), 4) AS pwat, round((max(t) FILTER (WHERE p = 700) - max(t) FILTER (WHERE p = 500)) / (max(zagl) FILTER (WHERE p = 500) - max(zagl) FILTER (WHERE p = 700)) * 1000, 5) AS lapse FROM s GROUP BY 1 HAVING count(*) >= 3""")
def _(x):
    return _profiles(x).select("profile", F.round(V.pwat(), 4).alias("pwat"), F.round(V.lapse_700_500(), 5).alias("lapse"))


_DEW = lambda t, rh: f"(243.5 * (ln(least(100, greatest(1, {rh})) / 100) + 17.67 * {t} / ({t} + 243.5)) / (17.67 - (ln(least(100, greatest(1, {rh})) / 100) + 17.67 * {t} / ({t} + 243.5))))"
# Levels in pressure coordinates and a surface per profile, with gaps in both.
_RAW = "SELECT profile, p, 200 + zagl::DOUBLE AS z, CASE WHEN p % 11 > 0 THEN t END AS t, CASE WHEN p % 3 > 0 THEN 60 + td END AS rh, CASE WHEN p % 7 > 0 THEN u END AS u, v FROM [profile]"
_SFC = "SELECT profile, CASE WHEN profile % 4 > 0 THEN 930 - profile % 50 END AS psfc, CASE WHEN profile % 5 > 0 THEN 300 + profile % 40 END AS zsfc, CASE WHEN profile % 9 > 0 THEN 25 + profile % 10 END AS t, CASE WHEN profile % 3 = 0 THEN 28 END AS td, CASE WHEN profile % 3 = 1 THEN 55 END AS rh, 3 AS u, CASE WHEN profile % 2 = 0 THEN 4 END AS v FROM (SELECT DISTINCT profile FROM [profile])"


def _surface_profiles(x):
    table = lambda: f"({derivation('profile', lambda t: '{' + t + '}')})"
    one = lambda text: x.spark.sql(text.replace("[profile]", table()), lineitem=x.t("lineitem"))
    return V.build_surface_profiles(one(_RAW.replace("zagl::DOUBLE", "CAST(zagl AS DOUBLE)")), one(_SFC), "profile")


@query("m28_surface_profiles", f"""WITH raw AS ({_RAW}), sfc AS ({_SFC}), low AS (SELECT profile, max(p) AS pmax FROM raw GROUP BY 1), every AS (
SELECT r.profile, r.p::DOUBLE AS p, r.z - coalesce(s.zsfc, 0) AS zagl, r.t, CASE WHEN r.rh IS NULL THEN r.t - 30 ELSE least(r.t, {_DEW('r.t', 'r.rh')}) END AS td, coalesce(r.u, 0) AS u, coalesce(r.v, 0) AS v FROM raw r JOIN sfc s USING (profile) WHERE r.t IS NOT NULL AND (s.psfc IS NULL OR r.p < s.psfc)
UNION ALL SELECT s.profile, coalesce(s.psfc, l.pmax)::DOUBLE, 0, s.t, least(s.t, coalesce(s.td, CASE WHEN s.rh IS NOT NULL THEN {_DEW('s.t', 's.rh')} END, s.t - 30)), 3, coalesce(s.v, 0) FROM sfc s JOIN low l USING (profile) WHERE s.t IS NOT NULL)
SELECT profile, p, round(zagl, 4) AS zagl, round(t, 5) AS t, round(td, 5) AS td, round(u, 5) AS u, round(v, 5) AS v FROM every WHERE profile IN (SELECT profile FROM every GROUP BY 1 HAVING count(*) >= 3)""")
def _(x):
    out = _surface_profiles(x).select("profile", F.explode("levels").alias("x")).select("profile", "x.*")
    return out.select("profile", "p", F.round("zagl", 4).alias("zagl"), *(F.round(c, 5).alias(c) for c in ("t", "td", "u", "v")))


# Wind at heights, and what follows from it, from the levels as rows.
_WIND = f"""WITH l AS ({LV}), l2 AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY zagl) AS k, count(*) OVER (PARTITION BY profile) AS n FROM l), f AS (SELECT * FROM l2 WHERE n >= 3),
hs AS (SELECT profile, h::DOUBLE AS h FROM (SELECT DISTINCT profile FROM f), (SELECT unnest(range(0, 6001, 100)) AS h)),
wb AS (SELECT hs.profile, hs.h, b.zagl AS bz, b.u AS bu, b.v AS bv FROM hs ASOF LEFT JOIN f b ON b.profile = hs.profile AND b.zagl < hs.h),
w AS (SELECT wb.*, a.zagl AS az, a.u AS au, a.v AS av FROM wb ASOF LEFT JOIN f a ON a.profile = wb.profile AND a.zagl >= wb.h),
winds AS (SELECT profile, h, CASE WHEN bz IS NULL THEN au WHEN az IS NULL THEN bu ELSE bu + (au - bu) * (h - bz) / (az - bz) END AS u, CASE WHEN bz IS NULL THEN av WHEN az IS NULL THEN bv ELSE bv + (av - bv) * (h - bz) / (az - bz) END AS v FROM w),
m AS (SELECT profile, avg(u) AS mu, avg(v) AS mv, avg(u) FILTER (WHERE h >= 5500) - avg(u) FILTER (WHERE h <= 500) AS su, avg(v) FILTER (WHERE h >= 5500) - avg(v) FILTER (WHERE h <= 500) AS sv FROM winds GROUP BY 1),
r AS (SELECT profile, CASE WHEN sqrt(su * su + sv * sv) < 0.1 THEN mu ELSE mu + 7.5 * sv / sqrt(su * su + sv * sv) END AS ru, CASE WHEN sqrt(su * su + sv * sv) < 0.1 THEN mv ELSE mv - 7.5 * su / sqrt(su * su + sv * sv) END AS rv FROM m),
pts AS (SELECT top, f.profile, f.zagl AS z, 0 AS last, f.u, f.v FROM f, (VALUES (1000::DOUBLE), (3000)) t(top) WHERE f.zagl BETWEEN -10 AND top UNION ALL SELECT h, profile, h, 1, u, v FROM winds WHERE h IN (1000, 3000)),
pairs AS (SELECT p.top, p.profile, u - ru AS u, v - rv AS v, lag(u) OVER o - ru AS pu, lag(v) OVER o - rv AS pv FROM pts p JOIN r USING (profile) WINDOW o AS (PARTITION BY p.profile, p.top ORDER BY z, last)),
h AS (SELECT profile, sum(u * pv - pu * v) FILTER (WHERE top = 1000) AS srh1, sum(u * pv - pu * v) FILTER (WHERE top = 3000) AS srh3 FROM pairs WHERE pu IS NOT NULL GROUP BY 1),
sh AS (SELECT a.profile, max(sqrt(pow(a.u - s.u, 2) + pow(a.v - s.v, 2))) FILTER (WHERE a.h = 1000) AS ms1, max(sqrt(pow(a.u - s.u, 2) + pow(a.v - s.v, 2))) FILTER (WHERE a.h = 6000) AS ms6, any_value(greatest(0, 125 * (s.t - s.td))) AS lcl FROM winds a JOIN f s ON s.profile = a.profile AND s.k = 1 GROUP BY 1)"""


@query("w21_w22_m26_m29_profile_params", f"""{_WIND}, e AS (SELECT profile, coalesce(srh1, 0) AS srh1, coalesce(srh3, 0) AS srh3, ms1, ms6, lcl, ru, rv, 500 + profile * 7 % 3000 AS cape, profile % 250 AS cin FROM h RIGHT JOIN r USING (profile) JOIN sh USING (profile))
SELECT profile, round(srh1, 4) AS srh1, round(srh3, 4) AS srh3, round(ms1 * 1.943844, 4) AS shr1, round(ms6 * 1.943844, 4) AS shr6, round(lcl, 4) AS lcl, round(ru, 4) AS rm_u, round(rv, 4) AS rm_v, round(cape * srh1 / 160000, 4) AS ehi1, round(cape * srh3 / 160000, 4) AS ehi3,
round(CASE WHEN ms6 < 10 THEN 0 ELSE greatest(0, cape / 1000 * srh3 / 50 * least(20, ms6) / 20) END, 4) AS scp,
round(greatest(0, cape / 1500 * (CASE WHEN lcl <= 1000 THEN 1 WHEN lcl >= 2000 THEN 0 ELSE (2000 - lcl) / 1000 END) * srh1 / 150 * (CASE WHEN ms6 < 12.5 THEN 0 WHEN ms6 > 30 THEN 1.5 ELSE ms6 / 20 END) * (CASE WHEN cin <= 50 THEN 1 WHEN cin > 200 THEN 0 ELSE (200 - cin) / 150 END)), 4) AS stp FROM e""")
def _(x):
    p = _profiles(x)
    out = V.profile_params(p, "profile", 500 + F.col("profile") * 7 % 3000, F.col("profile") % 250)
    return out.select("profile", *(F.round(c, 4).alias(c) for c in out.columns[1:] if c not in ("lapse", "pwat")))


_FALL_RATE = f"(287 * (t + 273.15) / p + 2.501e6 * {_W.replace('td', 't')} / p) / (1004 + 2.501e6 * 2.501e6 * 0.622 / 287 * {_W.replace('td', 't')} / pow(t + 273.15, 2))"


@query("w24_w25_parcel_buoyancy", f"""
WITH RECURSIVE f AS (
  SELECT *, row_number() OVER (PARTITION BY profile ORDER BY zagl) AS k, count(*) OVER (PARTITION BY profile) AS n FROM ({LV})
), s AS (
  SELECT profile, p AS p0, (t + 273.15) * pow(1000 / p, 0.2854) AS th, {_W} AS w0 FROM f WHERE k = 1 AND n >= 3
), tries AS (
  SELECT *, p0 - 2 * unnest(range(floor((p0 - 100) / 2)::INT + 1)) AS p FROM s
), dews AS (
  SELECT *, ln(w0 * p / (0.622 + w0) / 6.112) AS x FROM tries
), base AS (
  SELECT profile, p0, th, coalesce(max(p) FILTER (WHERE 243.5 * x / (17.67 - x) >= th * pow(p / 1000, 0.2854) - 273.15), 100) AS lcl FROM dews GROUP BY ALL
), dry AS (
  SELECT profile, p, th * pow(p / 1000, 0.2854) - 273.15 AS t FROM (SELECT *, p0 - 10 * unnest(range(floor((p0 - 100) / 10)::INT + 1)) AS p FROM base) WHERE p > lcl
), moist AS (
  SELECT profile, lcl::DOUBLE AS p, (th * pow(lcl / 1000, 0.2854) - 273.15)::DOUBLE AS t, floor((lcl - 100) / 10)::INT AS left_ FROM base
  UNION ALL SELECT profile, p - 10, t - 10 * {_FALL_RATE}, left_ - 1 FROM moist WHERE left_ > 0
), q AS (SELECT profile, p, t FROM dry UNION ALL SELECT profile, p, t FROM moist
), b AS (SELECT q.*, e.p AS bp, e.t AS bt FROM q ASOF LEFT JOIN f e ON e.profile = q.profile AND e.p >= q.p
), a AS (SELECT b.*, e.p AS ap, e.t AS t_up FROM b ASOF LEFT JOIN f e ON e.profile = b.profile AND e.p < b.p
), o AS (SELECT a.*, CASE WHEN ap IS NULL THEN top.t ELSE bt + (t_up - bt) * (ln(bp) - ln(a.p)) / (ln(bp) - ln(ap)) END AS env FROM a JOIN f top ON top.profile = a.profile AND top.k = top.n)
SELECT profile, round(p, 3) AS p, round(t + 1e-7::DOUBLE, 4) AS t_parcel, round(env + 1e-7::DOUBLE, 4) AS t_env, sign(round(t - env, 9))::INT AS sign FROM o""")
def _(x):
    out = V.parcel_buoyancy(_profiles(x), "profile")
    return out.select("profile", F.round("p", 3).alias("p"), *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("t_parcel", "t_env")), "sign")  # no ties of rounding


def _long(x):
    """Fields of the derived grid as long rows (run, hour, i, j, var, level, value)."""
    f = x.d("field")
    pick = lambda var, level, c: F.struct(F.lit(var).alias("var"), F.lit(level).alias("level"), F.expr(c).cast("double").alias("value"))
    rows = F.array(pick("TMP", "2 m above ground", "t"), pick("RH", "2 m above ground", "rh"), pick("UGRD", "10 m above ground", "u"), pick("VGRD", "10 m above ground", "v"), pick("CAPE", "90-0 mb above ground", "cape"), pick("HLCY", "1000-0 m above ground", "srh"), pick("QPE1_FFG", "0 m above mean sea level", "n"))
    return f.select(F.lit(0).alias("run"), F.lit(0).alias("hour"), "i", "j", F.explode(rows).alias("x")).select("run", "hour", "i", "j", "x.*")


@query("m1_m2_m5_m19_k1_products", f"""SELECT 'TMP' AS id, i, j, round(t, 6) AS value FROM [field] UNION ALL SELECT 'WIND', i, j, round({G.wind_speed.sql('u', 'v')}, 6) FROM [field] UNION ALL SELECT 'DPT', i, j, round({M.dewpoint.sql('t', 'rh')}, 6) FROM [field] WHERE rh > 0
UNION ALL SELECT 'EHI1', i, j, round({M.ehi.sql('cape', 'srh')}, 6) FROM [field] UNION ALL SELECT 'QPE1_FFG', i, j, round(n * 0.01, 6) FROM [field] UNION ALL SELECT 'OWN', i, j, round(u - v, 6) FROM [field]""")
def _(x):
    mine = K.with_product(K.MODEL, "OWN", [("UGRD", "10 m above ground"), ("VGRD", "10 m above ground")], lambda u, v: F.col(u) - F.col(v))
    mine = K.with_product(mine, "QPE1_FFG", [("QPE1_FFG", K.MOSAIC_LEVEL)], scale=0.01)
    return K.products(_long(x), ["TMP", "WIND", "DPT", "EHI1", "QPE1_FFG", "OWN"], mine).select("id", "i", "j", F.round("value", 6).alias("value"))


@query("m17_m24_model_override", f"SELECT i, j, round({M.dewpoint.sql('t', 'rh')} * 1.8, 6) AS value FROM [field] WHERE rh > 0")
def _(x):
    return K.product(_long(x), "DPT", model="analysis", overrides={("analysis", "DPT"): {"scale": 1.8}}).select("i", "j", F.round("value", 6).alias("value"))


# Fields of the derived forecast grid as (variable, level, accumulation text, expression over q, d, x, n, hour).
_TOTAL = "concat('0-', CAST(hour AS VARCHAR(9)), ' hour acc fcst')"
_BUCKET = lambda n: f"concat(CAST(hour - {n} AS VARCHAR(9)), '-', CAST(hour AS VARCHAR(9)), ' hour acc fcst')"
_FIELDS = [
    ("REFC", "entire atmosphere", "''", "q + x"), ("TCDC", "entire atmosphere", "''", "2 * q"), ("LTNG", "entire atmosphere", "''", "n / 10"), ("LTNG", "surface", "''", "n / 20"), ("GUST", "surface", "''", "q / 2"),
    ("TMP", "2 m above ground", "''", "245 + q + x"), ("RH", "2 m above ground", "''", "2 * q - x"), ("DPT", "2 m above ground", "''", "240 + q"), ("UGRD", "10 m above ground", "''", "q - 25"), ("VGRD", "10 m above ground", "''", "x - 4"),
    ("PRATE", "surface", "''", "(d - 4) / 1000"), ("CRAIN", "surface", "''", "1e0"), ("CFRZR", "surface", "''", "i - 1e0"), ("CICEP", "surface", "''", "i - 2e0"), ("CSNOW", "surface", "''", "j - 1e0"),
    ("APCP", "surface", _TOTAL, "hour * 2 + q / 10"), ("APCP", "surface", _BUCKET(1), "d / 10"), ("APCP", "surface", _BUCKET(6), "CASE WHEN hour = 6 THEN hour * 2 + q / 10 ELSE d / 2 END"), ("WEASD", "surface", _TOTAL, "hour / 2e0 + q / 5"), ("WEASD", "surface", "concat(CAST(hour AS VARCHAR(9)), ' hour fcst')", "hour / 3e0 + q / 5"),
    ("FROZR", "surface", _TOTAL, "d + hour"), ("FRZR", "surface", _TOTAL, "x + hour"), ("CAPE", "surface", "''", "q * 60"), ("CAPE", "90-0 mb above ground", "''", "q * 50 - 500"), ("CAPE", "180-0 mb above ground", "''", "q * 45"), ("CAPE", "255-0 mb above ground", "''", "q * 70"),
    ("CAPE", "0-3000 m above ground", "''", "q * 3"), ("CIN", "surface", "''", "-n * 20"), ("CIN", "90-0 mb above ground", "''", "-n * 25"), ("CIN", "180-0 mb above ground", "''", "-n * 30"), ("HGT", "level of adiabatic condensation from sfc", "''", "q * 60"), ("HGT", "surface", "''", "d * 40"),
    ("HLCY", "1000-0 m above ground", "''", "q * 8 - 100"), ("HLCY", "3000-0 m above ground", "''", "q * 9 - 100"), ("VUCSH", "0-1000 m above ground", "''", "d"), ("VVCSH", "0-1000 m above ground", "''", "x"), ("VUCSH", "0-6000 m above ground", "''", "q / 2"), ("VVCSH", "0-6000 m above ground", "''", "x"),
    ("USTM", "0-6000 m above ground", "''", "d - 5"), ("VSTM", "0-6000 m above ground", "''", "x"),
    *((v, f"{p} mb", "''", e.format(p=p)) for p in (200, 300, 500, 700, 850, 925) for v, e in (("UGRD", "q - {p} / 40e0"), ("VGRD", "x + {p} / 100e0"))), *(("ABSV", f"{p} mb", "''", f"x / {p}") for p in (850, 700, 500)),
    *(("TMP", f"{p} mb", "''", f"225 + q + {p} / 40e0") for p in (925, 850, 700, 500)), ("HGT", "500 mb", "''", "3000 + q * 50"), ("HGT", "700 mb", "''", "3000 + d * 60"),
]


def _cells(x):
    """The derived forecast grid as long rows, all its fields at once."""
    rows = [c for var, level, acc, value in _FIELDS for c in (F.lit(var), F.lit(level), F.expr(acc), F.expr(value).cast("double"))]
    # not an array: code of one method for all its fields is too long for the JVM to compile
    return x.d("grid").select("run", "hour", "i", "j", F.stack(F.lit(len(_FIELDS)), *rows).alias("var", "level", "acc", "value"))


def _values(frame):
    return frame.select("id", "run", "hour", "i", "j", F.round(F.col("value") + 1e-7, 5).alias("value"))  # no ties of rounding


_WIDE = """WITH g AS (SELECT run, hour, i, j, q::DOUBLE AS q, d::DOUBLE AS d, x::DOUBLE AS x, n FROM [grid]), w AS (SELECT *, 245 + q + x AS t, 2 * q - x AS rh, q - 25 AS u, x - 4 AS v, q * 2 / 4 AS s6, sqrt(q / 2 * q / 2 + x * x) AS sh6, q * 8 - 100 AS srh1, q * 9 - 100 AS srh3,
 hour * 2 + q / 10 AS rain, hour / 2e0 + q / 5 AS snow, hour / 3e0 + q / 5 AS snap, greatest(245 + q + x, 225 + q + 925 / 40e0, 225 + q + 850 / 40e0, 225 + q + 700 / 40e0) AS warm FROM g),
p AS (SELECT a.*, b6.rain AS rain6, b24.rain AS rain24, b6.snow AS snow6, b12.snow AS snow12, b24.snow AS snow24, b6.snap AS snap6, b12.snap AS snap12, b24.snap AS snap24 FROM w a LEFT JOIN w b6 ON (b6.run, b6.i, b6.j, b6.hour) = (a.run, a.i, a.j, a.hour - 6) LEFT JOIN w b12 ON (b12.run, b12.i, b12.j, b12.hour) = (a.run, a.i, a.j, a.hour - 12) LEFT JOIN w b24 ON (b24.run, b24.i, b24.j, b24.hour) = (a.run, a.i, a.j, a.hour - 24)),
tf AS (SELECT *, CASE WHEN warm <= 271.16 THEN 12 + 2 * (271.16 - warm) ELSE greatest(0, 12 + 271.16 - warm) END AS ratio, t * 1.8 - 459.67 AS f, sqrt(u * u + v * v) * 2.2369362920544 AS mph, ln(least(100, greatest(1, rh)) / 100) + 17.625 * (t - 273.15) / (243.04 + t - 273.15) AS gam FROM p) """
_FALL = lambda now, h: f"CASE WHEN hour <= {h} THEN {now} ELSE CASE WHEN {now}{h} IS NOT NULL THEN greatest(0, {now} - {now}{h}) END END"
_HEAT = """CASE WHEN f >= 80 THEN (CASE WHEN (f + 0.5 * (f + 61 + (f - 68) * 1.2 + rh * 0.094)) / 2 < 80 THEN 0.5 * (f + 61 + (f - 68) * 1.2 + rh * 0.094) ELSE
 -42.379 + 2.04901523 * f + 10.14333127 * rh - 0.22475541 * f * rh - 6.83783e-3 * f * f - 5.481717e-2 * rh * rh + 1.22874e-3 * f * f * rh + 8.5282e-4 * f * rh * rh - 1.99e-6 * f * f * rh * rh
 - CASE WHEN rh < 13 AND f <= 112 THEN (13 - rh) / 4 * sqrt((17 - abs(f - 95)) / 17) ELSE 0 END + CASE WHEN rh > 85 AND f <= 87 THEN (rh - 85) / 10 * ((87 - f) / 5) ELSE 0 END END)
 WHEN f <= 50 AND mph > 3 THEN 35.74 + 0.6215 * f - 35.75 * pow(mph, 0.16) + 0.4275 * f * pow(mph, 0.16) ELSE f END"""
_BY_ID = {
    "REFC": "q + x", "PTYPE": "CASE WHEN d > 4 THEN (CASE WHEN j > 1 THEN 150 WHEN i > 2 THEN 100 WHEN i > 1 THEN 50 ELSE 0 END) + least(49.99, (d - 4) / 1000 * 3600) END", "TMP": "t", "FEELS": f"(({_HEAT}) + 459.67) / 1.8", "WIND": "sqrt(u * u + v * v)",
    "GUST": "q / 2", "RH": "rh", "DPT": "CASE WHEN rh > 0 THEN 243.04 * gam / (17.625 - gam) + 273.15 END", "TCDC": "2 * q", "QPF1": "d / 10", "QPF6": _FALL("rain", 6), "QPF24": _FALL("rain", 24), "QPF": "rain",
    **{f"W{p}": f"sqrt(pow(q - {p} / 40e0, 2) + pow(x + {p} / 100e0, 2))" for p in (200, 300, 500, 700, 850, 925)}, **{f"VORT{p}": f"x / {p}" for p in (850, 700, 500)}, **{f"TMP{p}": f"225 + q + {p} / 40e0" for p in (925, 850, 700, 500)},
    "SBCAPE": "q * 60", "MLCAPE": "q * 50 - 500", "MUCAPE": "q * 70", "CAPE3": "q * 3", "SBCIN": "n * 20", "MLCIN": "n * 25", "LAPSE": "CASE WHEN q * 50 > d * 60 THEN 5e0 / (q * 50 - d * 60) * 1000 END", "LCL": "greatest(0, q * 60 - d * 40)",
    "SRH1": "srh1", "SRH3": "srh3", "SHEAR1": "sqrt(d * d + x * x)", "SHEAR6": "sh6", "STORM": "sqrt((d - 5) * (d - 5) + x * x)", "LTNG": "n / 10",
    "STP": "greatest(0, q * 60 / 1500 * least(1, greatest(0, (2000 - (q * 60 - d * 40)) / 1000)) * srh1 / 150 * CASE WHEN sh6 < 12.5 THEN 0 WHEN sh6 > 30 THEN 1.5 ELSE sh6 / 20 END * CASE WHEN n * 20 > 200 THEN 0 ELSE least(1, (200 - n * 20) / 150) END)",
    "SCP": "CASE WHEN sh6 < 10 THEN 0 ELSE greatest(0, q * 70 / 1000 * srh3 / 50 * least(sh6, 20) / 20) END", "EHI1": "greatest(0, q * 50 - 500) * srh1 / 160000", "EHI3": "greatest(0, q * 50 - 500) * srh3 / 160000",
    **{f"SNOW{h}": f"10 * ({_FALL('snow', h)})" for h in (6, 12, 24)}, "SNOWT": "10 * snow", **{f"KUCH{h}": f"ratio * ({_FALL('snow', h)})" for h in (6, 12, 24)}, "KUCHT": "ratio * snow", "ICET": "d + hour", "FZRA": "x + hour",
}


def _sql_of(ids: dict[str, str], source: str = "tf") -> str:
    """A row per id and cell, values rounded, missing ones left out."""
    rows = " UNION ALL ".join(f"SELECT '{id}' AS id, run, hour, i, j, round({e} + 1e-7::DOUBLE, 5) AS value FROM {source}" for id, e in ids.items())
    return f"{_WIDE} SELECT * FROM ({rows}) WHERE value IS NOT NULL"


@query("m1_m18_all_model_products", _sql_of(_BY_ID))
def _(x):
    return _values(K.products(_cells(x), list(K.MODEL)))


_RH_TD = "(100 * exp(17.625 * (240 + q - 273.15) / (243.04 + 240 + q - 273.15) - 17.625 * (t - 273.15) / (243.04 + t - 273.15)))"
_SNAP = {**{f"SNOW{h}": f"10 * ({_FALL('snap', h)})" for h in (6, 12, 24)}, "SNOWT": "10 * snap", **{f"KUCH{h}": f"ratio * ({_FALL('snap', h)})" for h in (6, 12, 24)}, "KUCHT": "ratio * snap"}
_VARIANTS = {
    "gefsens": {"DPT": "240 + q", "QPF6": "CASE WHEN hour = 6 THEN rain ELSE d / 2 END", "TCDC": "2 * q", "MLCAPE": "q * 45", "MLCIN": "n * 30", **_SNAP}, "gfs": _SNAP, "rap": {"LTNG": "n / 20"},
    "ecmwf": {"DPT": "240 + q", "FEELS": f"(({_HEAT.replace('rh', 'rh2')}) + 459.67) / 1.8"},
}


@query("m3_m17_model_variants", _sql_of({f"{m}:{id}": e for m, held in _VARIANTS.items() for id, e in held.items()}, f"(SELECT *, least(100, {_RH_TD}) AS rh2 FROM tf)"))
def _(x):
    cells = _cells(x).filter((F.col("var") != "WEASD") | ~F.col("acc").startswith("0-"))  # gfs and gefsens have snapshots in place of totals; the others read neither
    out = K.products_of_models(cells, {model: [i for i in held if i in K.model_products(model)] for model, held in _VARIANTS.items()})
    return _values(out.withColumn("id", F.concat("model", F.lit(":"), "id")))


_FOLDERS = {folder: f"q + {k}" for k, folder in enumerate([*K.MOSAIC_FOLDERS.values(), "RadarOnly_QPE_01H_00.00", "RadarOnly_QPE_03H_00.00", "RadarOnly_QPE_06H_00.00"])}
_MOSAIC_SQL = {id: f"({_FOLDERS[folder]})" + (" * 0.01" if id.startswith("FFG") else "") for id, folder in K.MOSAIC_FOLDERS.items()}
for _h in (1, 3, 6):
    _rain, _ratio = _FOLDERS[f"RadarOnly_QPE_{_h:02}H_00.00"], f"(({_FOLDERS[f'FLASH_QPE_FFG{_h:02}H_00.00']}) * 4 * 0.01)"
    _MOSAIC_SQL[f"FFGX{_h}"] = f"CASE WHEN {_ratio} > 1 THEN ({_rain}) - ({_rain}) / {_ratio} END"
    _MOSAIC_SQL[f"FFG{_h}H"] = _ratio


@query("m19_m21_all_mosaic_products", _sql_of(_MOSAIC_SQL))
def _(x):
    stored = {f: f"({e}) * 4" if "FLASH_QPE_FFG0" in f else e for f, e in _FOLDERS.items()}
    rows = F.array(*(F.struct(F.lit(f).alias("var"), F.lit(K.MOSAIC_LEVEL).alias("level"), F.expr(e).cast("double").alias("value")) for f, e in stored.items()))
    cells = x.d("grid").select("run", "hour", "i", "j", F.explode(rows).alias("x")).select("run", "hour", "i", "j", "x.*")
    return _values(K.products(cells, list(K.MOSAIC), K.MOSAIC))


_SOUNDER = {("BT", "channel 15"): "200 + q", ("BT", "channel 21"): "180 + q", ("BT", "channel 3"): "q", **{(v, "surface"): f"q / {k}" for k, v in enumerate(("RR", "TPW", "CLW", "IWP", "SFR", "SWE", "SIce", "TSkin"), 2)}}
_SURFACE = {("TMP", "2 m above ground"): "t", ("DPT", "2 m above ground"): "240 + q", ("TCDC", "entire atmosphere"): "2 * q", ("WIND", "10 m above ground"): "q / 3", ("GUST", "10 m above ground"): "q / 2", ("VIS", "surface"): "q * 300"}


@query("m24_m25_analysis_microwave", _sql_of({
    "TMP": "t", "DPT": "240 + q", "RH": f"least(100, greatest(0, {_RH_TD}))", "TCDC": "2 * q", "WIND": "q / 3", "GUST": "q / 2", "VIS": "q * 300", "BT89": "200 + q", "BT183": "180 + q",
    **{id: f"q / {k}" for k, id in enumerate(("RR", "TPW", "CLW", "IWP", "SFR", "SWE", "SICE", "TSKIN"), 2)},
}))
def _(x):
    rows = lambda held: F.array(*(F.struct(F.lit(v).alias("var"), F.lit(level).alias("level"), F.expr("245 + q + x" if e == "t" else e).cast("double").alias("value")) for (v, level), e in held.items()))
    cells = lambda held: x.d("grid").select("run", "hour", "i", "j", F.explode(rows(held)).alias("x")).select("run", "hour", "i", "j", "x.*")
    return _values(K.products(cells(_SURFACE), list(K.ANALYSIS), K.ANALYSIS).unionAll(K.products(cells(_SOUNDER), list(K.MICROWAVE), K.MICROWAVE)))


@query("m18_m35_overlay_fields", """SELECT run, hour, i, j, round(q - 20, 5) AS u, round(x + 2, 5) AS v, round(sqrt(pow(q - 20, 2) + pow(x + 2, 2)), 5) AS speed, round(5000 + q * 3, 5) AS hgt, round(CASE WHEN run % 3 = 0 THEN 100000 + q WHEN run % 3 = 1 THEN 99000 + x END / 100, 5) AS mslp_hpa
FROM (SELECT run, hour, i, j, q::DOUBLE AS q, x::DOUBLE AS x FROM [grid])""")
def _(x):
    pick = lambda var, level, c: F.struct(F.lit(var).alias("var"), F.lit(level).alias("level"), F.expr(c).cast("double").alias("value"))
    held = F.array(
        pick("UGRD", "500 mb", "q - 20"), pick("VGRD", "500 mb", "x + 2"), pick("HGT", "500 mb", "5000 + q * 3"), pick("UGRD", "700 mb", "q"), pick("MSLMA", "mean sea level", "CASE WHEN run % 3 = 0 THEN 100000 + q END"),
        pick("PRES", "surface", "CASE WHEN run % 3 < 2 THEN 99000 + x END"),
    )
    cells = x.d("grid").select("run", "hour", "i", "j", F.explode(held).alias("x")).select("run", "hour", "i", "j", "x.*")
    out = K.overlay_fields(cells, 500)
    return out.select("run", "hour", "i", "j", *(F.round(c, 5).alias(c) for c in ("u", "v", "speed", "hgt", "mslp_hpa")))


_KEYS = "SELECT event_id, ts, user_id FROM events"


@query("c1_key_times", "SELECT event_id, strftime(date_trunc('second', ts), '%Y%m%d%H%M%S') AS volume, strftime(date_trunc('second', ts), '%Y%m%d%H%M%S') AS mosaic, strftime(date_trunc('second', ts), '%Y%m%d%H%M%S') AS scene, strftime(date_trunc('minute', ts) + to_seconds((150 * (event_id % 4))::BIGINT), '%Y%m%d%H%M%S') AS himawari, strftime(date_trunc('minute', ts), '%Y%m%d%H%M%S') AS analysis, NULL::VARCHAR AS none FROM events")
def _(x):
    e, f = x.t("events"), F.date_format
    key = {
        "volume": F.concat(F.lit("KTLX"), f("ts", "yyyyMMdd_HHmmss"), F.lit("_V06")), "mosaic": F.concat(F.lit("M_00.50_"), f("ts", "yyyyMMdd-HHmmss"), F.lit(".grib2.gz")), "scene": F.concat(F.lit("OR_s"), f("ts", "yyyy"), F.lpad(F.dayofyear("ts").cast("string"), 3, "0"), f("ts", "HHmmss"), F.lit("0_e")),
        "himawari": F.concat(F.lit("HIMAWARI:fd:"), f("ts", "yyyyMMddHHmm"), F.lit(":"), (F.col("event_id") % 4 + 1).cast("string")), "analysis": F.concat(F.lit("rtma2p5_ru."), f("ts", "yyyyMMdd"), F.lit("/rtma2p5_ru.t"), f("ts", "HHmm"), F.lit("z.2dvaranl")),
    }
    return e.select("event_id", *(f(C.key_time(k, g), "yyyyMMddHHmmss").alias(g) for g, k in key.items()), f(C.key_time(F.lit("nothing"), "swath"), "yyyyMMddHHmmss").alias("none"))


@query("c2_c8_volume_listing", "SELECT '2024/01/05/KTLX/KTLX20240105_' || lpad((event_id % 240000)::VARCHAR, 6, '0') || '_V06' AS key FROM events WHERE event_id % 4 < 2")
def _(x):
    stem = F.concat(F.lit("KTLX20240105_"), F.lpad((F.col("event_id") % 240000).cast("string"), 6, "0"))
    tail = F.when(F.col("event_id") % 4 == 2, "_MDM").when(F.col("event_id") % 4 == 3, ".003").otherwise("")
    return C.list_volumes(x.t("events").select(F.concat(C.archive_key(stem), tail).alias("key")), "KTLX", "2024/01/05")


@query("c3_recent_scenes", "WITH k AS (SELECT user_id, event_id, datediff('hour', date_trunc('hour', ts), TIMESTAMP '2024-01-20 12:30:00') AS back FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY back RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer FROM k WHERE back BETWEEN 0 AND 3) SELECT user_id, event_id FROM c WHERE newer < 2")
def _(x):
    k = x.t("events").select("user_id", "event_id", "ts", F.col("event_id").alias("key"))
    return C.recent_scenes(k, "user_id", "ts", F.lit("2024-01-20 12:30:00").cast("timestamp_ntz"), want=2).select("user_id", "event_id")


@query("c9_c10_c11_index_fields", """WITH r AS (SELECT l_orderkey AS file, l_linenumber AS rec, (l_linenumber * 1000)::BIGINT AS start, CASE WHEN l_linenumber % 2 = 0 THEN 'APCP' ELSE 'TMP' END AS var FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
e AS (SELECT *, lead(start) OVER (PARTITION BY file ORDER BY start) - 1 AS "end" FROM r) SELECT file, rec::INT AS rec, start, "end", '0-90 mb above ground' AS level FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start) k FROM e WHERE var = 'APCP') WHERE k = 1""")
def _(x):
    l = x.t("lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber").distinct()  # noqa: E741
    n = F.col("l_linenumber")
    lines = l.select("file", F.concat_ws(":", n.cast("string"), (n * 1000).cast("string"), F.lit("d=2026071200"), F.when(n % 2 == 0, "APCP").otherwise("TMP"), F.lit("90-0 mb above ground (considered as a single layer)"), F.lit("0-7 hour acc fcst"), F.lit("")).alias("value"))
    return C.select_field(C.parse_idx(lines), "APCP", "0-90 mb above ground", "acc").select("file", "rec", "start", "end", "level")


@query("c12_c13_json_index", "SELECT event_id, (event_id % 5)::INT AS member, event_id * 10 AS start, round(value * 1000, 4) AS value FROM events WHERE event_id % 3 = 0")
def _(x):
    n = F.col("event_id")
    e = x.t("events").select("event_id", "value", F.when(n % 3 == 0, F.concat(F.lit('{"param": "tp", "number": "'), (n % 5).cast("string"), F.lit('", "_offset": '), (n * 10).cast("string"), F.lit(', "_length": 5}'))).when(n % 3 == 1, F.lit('{"param": "tp", "levelist": "500", "_offset": 1, "_length": 5}')).otherwise("{broken").alias("text"))
    idx = C.parse_json_index(e.select("event_id", F.col("value").alias("v"), F.col("text").alias("value")), "tp")
    out = C.translate_fields(idx.withColumn("param", F.lit("tp")).withColumnRenamed("v", "value"))
    return out.select("event_id", "member", "start", F.round("value", 4).alias("value"))


@query("c15_run_calendar", """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), m AS (SELECT * FROM (VALUES ('a', 6, 4), ('b', 12, 7)) t(model, step_h, latency_h)), r AS (SELECT model, day + to_hours(c::INT) AS run, latency_h FROM d, m, (SELECT unnest(range(24)) AS c) WHERE c % step_h = 0)
SELECT model, strftime(run, '%Y%m%d%H') AS run, CASE model WHEN 'a' THEN 49 ELSE 17 END AS n_hours FROM r WHERE run + to_hours(latency_h) <= TIMESTAMP '1997-06-01 12:00:00'""")
def _(x):
    models = x.spark.createDataFrame([("a", 6, 4, 36, 72, 3), ("b", 12, 7, 16, 16, 6)], "model string, step_h int, latency_h int, hourly_to int, max_hour int, coarse_h int")
    out = C.run_calendar(models, x.t("orders").select(F.to_date("o_orderdate").alias("day")).distinct(), F.lit("1997-06-01 12:00:00").cast("timestamp_ntz"))
    return out.select("model", F.date_format("run", "yyyyMMddHH").alias("run"), F.size("fhours").alias("n_hours"))


@query("c16_available_runs", "SELECT l_orderkey AS run FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40))")
def _(x):
    need = x.t("lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("file"))
    return C.available_runs(need, x.t("part").filter("p_size <= 40").select(F.col("p_partkey").alias("file")), ["run"], "file")


@query("c17_storms_in_cycle", "SELECT strftime(ts, '%Y%m%d') AS day, strftime(ts, '%H') AS cycle, lpad((user_id % 20)::VARCHAR, 2, '0') || 'l' AS storm, count(DISTINCT event_id % 126)::INT AS n_hours FROM events GROUP BY 1, 2, 3")
def _(x):
    k = F.concat(F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"), F.lit("l."), F.date_format("ts", "yyyyMMddHH"), F.lit(".storm.atm.f"), F.lpad((F.col("event_id") % 126).cast("string"), 3, "0"))
    return C.storms_in_cycle(x.t("events").select(k.alias("key"))).select("day", "cycle", "storm", F.size("hours").alias("n_hours"))


@query("c18_f25_hourly_frames", "SELECT event_id, strftime(date_trunc('hour', ts) - to_hours((2 - k)::INT), '%y%m%d%H') AS label, (k = 2) AS newest FROM events, (VALUES (0), (1), (2)) t(k)")
def _(x):
    f = x.t("events").select("event_id", F.explode(C.hourly_frames(F.col("ts"), 3)).alias("f"))
    return f.select("event_id", "f.label", "f.newest")


@query("c19_c21_geojson", "SELECT 'Point' AS type, name, '[' || lon::DOUBLE::VARCHAR || ',' || lat::DOUBLE::VARCHAR || ']' AS coordinates FROM [place]")
def _(x):
    text = C.to_geojson(x.d("place"), "lon", "lat", ["name"]).select(F.concat(F.lit('{"features": ['), "value", F.lit(', {"properties": {}, "geometry": null}]}')).alias("value"))
    return C.parse_geojson(text).select("type", F.col("properties")["name"].alias("name"), "coordinates")


@query("c20_column_table", "SELECT place::VARCHAR AS id, name FROM [place]")
def _(x):
    text = x.d("place").select(F.concat(F.lit('{"table": {"columnNames": ["id", "name"], "rows": [["'), F.col("place").cast("string"), F.lit('", "'), "name", F.lit('"]]}}')).alias("value"))
    return C.parse_column_table(text).select(F.col("row")["id"].alias("id"), F.col("row")["name"].alias("name"))


# Hints of derived palettes and, by hand, what they are for.
_HINTS = (
    ("BR", "REF"), ("bv", "VEL"), ("Storm CC", "RHO"), ("accuracy", None), ("ZDR dB", "ZDR"), ("differential reflectivity", "ZDR"), ("KDP", "KDP"), ("differential phase", "PHI"), ("SW", "SW"), ("sweep", None),
    ("spectrum width", "SW"), ("knots", "VEL"), ("m/s", "VEL"), ("dbz", "REF"), ("abrupt", None), ("Z", "REF"), ("relative velocity", "VEL"), ("CORRELATION of V", "RHO"),
)


@query("f23_f24_palettes", f"""WITH h AS (SELECT * FROM (VALUES {", ".join(f"({k}, {'NULL' if t is None else repr(t)})" for k, (_, t) in enumerate(_HINTS))}) v(k, target))
SELECT place AS palette, CASE WHEN place % 3 > 0 THEN 3 END AS n_colours, CASE WHEN place % 3 = 0 THEN 'no usable Color entries found' END AS error, CASE WHEN place % 3 > 0 THEN (place % 80)::DOUBLE END AS v,
CASE WHEN place % 3 > 0 THEN '10.0,20.0,30.0,255.0' END AS first, CASE WHEN place % 3 > 0 THEN '1.0,2.0,3.0,4.0>5.0,6.0,7.0,8.0' END AS second, CASE WHEN place % 3 > 0 THEN '9.0,9.0,9.0,255.0>9.0,9.0,9.0,255.0' END AS third,
'7.0,0.0,0.0,255.0' AS rf, h.target AS target FROM [place] JOIN h ON h.k = place % {len(_HINTS)}""")
def _(x):
    p = F.col("place")
    text = F.array(
        F.concat(F.lit("Color: "), (p % 80).cast("string"), F.lit(" 10 20 30 ; note")), F.lit("; only a comment"), F.lit("Color: 10 20 x"), F.lit("Color4: 5 1 2 3"), F.lit("RF: 7"),
        F.concat(F.lit("Product: "), F.element_at(F.array(*(F.lit(h) for h, _ in _HINTS)), (p % len(_HINTS) + 1).cast("int"))), F.when(p % 3 > 0, "color4: 90,1,2,3,4,5,6,7,8").otherwise("nothing"), F.when(p % 3 > 0, "SolidColor 95 9 9 9").otherwise("Step: 5"),
    )
    lines = x.d("place").select(p.alias("palette"), F.posexplode(text).alias("pos", "value"))
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    seg = lambda k: F.try_element_at("segments", F.lit(k))
    both = lambda k: F.concat_ws(">", join(seg(k)["c1"]), join(seg(k)["c2"]))
    out = C.palettes(lines)
    fine = F.col("segments").isNotNull()
    return out.select(
        "palette", F.when(fine, F.size("segments")).alias("n_colours"), "error", seg(1)["v"].alias("v"), F.when(fine, both(1)).alias("first"), F.when(fine, both(2)).alias("second"), F.when(fine, both(3)).alias("third"),
        join("rf").alias("rf"), C.palette_target(F.col("hint"), F.col("units")).alias("target"),
    )


@query("a16_scene_bbox", f"SELECT round(min(lon), 5) AS west, round(max(lat), 5) AS north FROM (SELECT {G.fixed_grid()['lon'].sql('(i - 32) * 0.004', '(j - 32) * 0.004')} AS lon, {G.fixed_grid()['lat'].sql('(i - 32) * 0.004', '(j - 32) * 0.004')} AS lat FROM [cell])")
def _(x):
    g = G.fixed_grid()
    at = x.d("cell").select(g["lon"]("(i - 32) * 0.004", "(j - 32) * 0.004").alias("lon"), g["lat"]("(i - 32) * 0.004", "(j - 32) * 0.004").alias("lat"))
    return at.agg(F.round(F.min("lon"), 5).alias("west"), F.round(F.max("lat"), 5).alias("north"))
