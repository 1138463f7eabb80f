"""Vertical profiles: one row per profile with its levels as an array ordered from the ground up.

`levels` is array<struct<zagl, p, t, td, u, v>>; a profile is a few dozen levels, so folds run inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.weather import dew_from_rh, ehi, scp, stp

FIELDS = ("zagl", "p", "t", "td", "u", "v")


def build_profiles(levels: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Levels (p, zagl, t, td, u, v) that lie above ground already, `least` of them at least, as one array per profile."""
    s = F.struct(*(F.col(c).cast("double").alias(c) for c in FIELDS))
    return levels.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("levels")).filter(F.size("levels") >= least)


def build_surface_profiles(levels: DataFrame, surface: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Profiles on a surface: levels (key, p hPa, z, t C, rh, u, v) and a row (key, psfc hPa, zsfc, t, td, rh, u, v) per profile.

    Levels at or under the surface pressure are dropped, and those without a height or a temperature; the surface is the lowest level, at
    its pressure or else that of the lowest level given. Dew points come from humidity where there is none, are at most the
    temperature, and 30 degrees under it if unknown; unknown wind is calm. Heights are above the surface (0 if unknown).
    Profiles under `least` levels are left out. (key, psfc, zsfc, levels).
    """
    dew = lambda t, rh: dew_from_rh(t, f"least(100, greatest(1, {rh}))")
    base = surface.select(
        key, "psfc", F.coalesce("zsfc", F.lit(0.0)).alias("zsfc"), F.struct(F.col("t").cast("double").alias("t"), F.coalesce("td", F.when(F.col("rh").isNotNull(), dew("t", "rh"))).cast("double").alias("td"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).alias("s")
    )
    level = F.struct(F.col("p").cast("double").alias("p"), F.col("z").cast("double").alias("z"), F.col("t").cast("double").alias("t"), F.when(F.col("rh").isNotNull(), dew("t", "rh")).cast("double").alias("td"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    held = levels.groupBy(key).agg(F.collect_list(level).alias("held"))
    met = held.join(base.hint("merge"), key)
    above = F.filter("held", lambda x: (F.col("psfc").isNull() | (x["p"] < F.col("psfc"))) & x["z"].isNotNull() & x["t"].isNotNull())
    lowest = F.coalesce("psfc", F.array_max(F.transform("held", lambda x: x["p"])))
    ground = F.array(F.struct(lowest.cast("double").alias("p"), F.col("zsfc").cast("double").alias("z"), F.col("s.t").alias("t"), F.col("s.td").alias("td"), F.col("s.u").alias("u"), F.col("s.v").alias("v")))
    ordered = F.array_sort(F.concat(F.when(F.col("s.t").isNotNull(), ground).otherwise(F.slice(ground, 1, 0)), above), lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
    finished = F.transform(ordered, lambda x: F.struct(
        (x["z"] - F.col("zsfc")).alias("zagl"), x["p"].alias("p"), x["t"].alias("t"), F.least(x["t"], F.coalesce(x["td"], x["t"] - 30)).alias("td"), F.coalesce(x["u"], F.lit(0.0)).alias("u"), F.coalesce(x["v"], F.lit(0.0)).alias("v")
    ))
    return met.select(key, "psfc", "zsfc", finished.alias("levels")).filter(F.size("levels") >= least)


def wind_at(h: Column, levels: str = "levels") -> Column:
    """struct<u, v> at a height above ground, linear between levels, the end levels beyond them."""
    lv = F.col(levels)
    below = F.try_element_at(F.filter(lv, lambda x: x["zagl"] < h), F.lit(-1))
    above = F.try_element_at(F.filter(lv, lambda x: x["zagl"] >= h), F.lit(1))
    f = (h - below["zagl"]) / F.coalesce(F.nullif(above["zagl"] - below["zagl"], F.lit(0.0)), F.lit(1.0))
    at = lambda c: F.when(below.isNull(), F.element_at(lv, 1)[c]).when(above.isNull(), F.element_at(lv, -1)[c]).otherwise(below[c] + (above[c] - below[c]) * f)
    return F.struct(at("u").alias("u"), at("v").alias("v"))


def mean_wind(lo: int, hi: int) -> Column:
    """Mean of the wind every 100 m from lo to hi, both included."""
    winds = F.transform(F.sequence(F.lit(lo), F.lit(hi), F.lit(100)), lambda z: wind_at(z.cast("double")))
    mean = lambda c: F.aggregate(winds, F.lit(0.0), lambda a, w: a + w[c]) / F.lit((hi - lo) // 100 + 1)
    return F.struct(mean("u").alias("u"), mean("v").alias("v"))


def with_bunkers(profiles: DataFrame, deviation: float = 7.5) -> DataFrame:
    """Mean wind of 0-6 km and the right and left movers, 7.5 m/s across the shear."""
    p = profiles.withColumns({"mean": mean_wind(0, 6000), "_low": mean_wind(0, 500), "_high": mean_wind(5500, 6000)})
    p = p.withColumns({"_su": F.col("_high.u") - F.col("_low.u"), "_sv": F.col("_high.v") - F.col("_low.v")}).withColumn("_mag", F.hypot("_su", "_sv"))
    move = lambda s: F.when(F.col("_mag") < 0.1, F.col("mean")).otherwise(F.struct((F.col("mean.u") + s * deviation * F.try_divide("_sv", "_mag")).alias("u"), (F.col("mean.v") - s * deviation * F.try_divide("_su", "_mag")).alias("v")))
    return p.withColumns({"right": move(1), "left": move(-1)}).drop("_low", "_high", "_su", "_sv", "_mag")


def srh(top: float, motion: str) -> Column:
    """Storm-relative helicity from the ground to `top` for a motion column."""
    inside = F.transform(F.filter("levels", lambda x: (x["zagl"] >= -10) & (x["zagl"] <= top)), lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v")))
    pts = F.concat(inside, F.array(wind_at(F.lit(top))))
    cu, cv = F.col(f"{motion}.u"), F.col(f"{motion}.v")
    pair = F.zip_with(F.slice(pts, F.lit(1), F.size(pts) - 1), F.slice(pts, F.lit(2), F.size(pts) - 1), lambda a, b: (b["u"] - cu) * (a["v"] - cv) - (a["u"] - cu) * (b["v"] - cv))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)


def bulk_shear_kt(top: float) -> Column:
    """Wind difference between the lowest level and a height."""
    w, s = wind_at(F.lit(top)), F.element_at(F.col("levels"), 1)
    return F.hypot(w["u"] - s["u"], w["v"] - s["v"]) * 1.943844


def mixing_ratio(td: Column, p: Column) -> Column:
    e = 6.112 * F.exp(17.67 * td / (td + 243.5))
    return 0.622 * e / (p - e)


def pwat() -> Column:
    """Precipitable water (mm), trapezoids of the mixing ratio over pressure."""
    lv, n = F.col("levels"), F.size("levels") - 1
    part = F.zip_with(F.slice(lv, F.lit(1), n), F.slice(lv, F.lit(2), n), lambda a, b: (mixing_ratio(a["td"], a["p"]) + mixing_ratio(b["td"], b["p"])) / 2 * (a["p"] - b["p"]) * 100 / 9.81)
    return F.aggregate(part, F.lit(0.0), lambda s, x: s + x)


def lapse_700_500() -> Column:
    """M9: C/km between the levels of exactly 700 and 500 hPa; null without them."""
    at = lambda p: F.try_element_at(F.filter("levels", lambda x: x["p"] == p), F.lit(1))
    return F.try_divide(at(700)["t"] - at(500)["t"], at(500)["zagl"] - at(700)["zagl"]) * 1000


def lift_parcel(profiles: DataFrame, top: float = 100.0) -> DataFrame:
    """Adds parcel, array<struct<p, t>> of the surface parcel: dry to its LCL (2 hPa search), then moist in steps of 10 hPa."""
    s = F.element_at(F.col("levels"), 1)
    q = profiles.withColumns({"_p0": s["p"], "_th": (s["t"] + 273.15) * F.pow(1000 / s["p"], F.lit(0.2854)), "_w0": mixing_ratio(s["td"], s["p"])})
    dry = lambda p: F.col("_th") * F.pow(p / 1000, F.lit(0.2854)) - 273.15
    ln = lambda p: F.log(F.col("_w0") * p / (0.622 + F.col("_w0")) / 6.112)
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.col("_p0") - top) / 2).cast("int")), lambda k: F.col("_p0") - k * 2)
    q = q.withColumn("_lcl", F.coalesce(F.try_element_at(F.filter(steps, lambda p: 243.5 * ln(p) / (17.67 - ln(p)) >= dry(p)), F.lit(1)), F.lit(top)))
    below = F.transform(F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.col("_p0") - top) / 10).cast("int")), lambda k: F.col("_p0") - k * 10), lambda p: p > F.col("_lcl")), lambda p: F.struct(p.alias("p"), dry(p).alias("t")))

    def fall(t: Column, p: Column) -> Column:
        tk, w = t + 273.15, mixing_ratio(t, p)
        return (287 * tk / p + 2.501e6 * w / p) / (1004 + 2.501e6 * 2.501e6 * 0.622 / 287 * w / (tk * tk))

    n = F.floor((F.col("_lcl") - top) / 10).cast("int")
    start = F.struct(F.col("_lcl").alias("p"), dry(F.col("_lcl")).alias("t"), F.array(F.struct(F.col("_lcl").alias("p"), dry(F.col("_lcl")).alias("t"))).alias("out"))

    def climb(acc: Column, _: Column) -> Column:
        p, t = acc["p"] - 10, acc["t"] - fall(acc["t"], acc["p"]) * 10
        return F.struct(p.alias("p"), t.alias("t"), F.concat(acc["out"], F.array(F.struct(p.alias("p"), t.alias("t")))).alias("out"))

    moist = F.aggregate(F.filter(F.sequence(F.lit(0), n), lambda k: k > 0), start, climb, lambda acc: acc["out"])
    return q.withColumn("parcel", F.concat(below, moist)).drop("_p0", "_th", "_w0", "_lcl")


def parcel_buoyancy(profiles: DataFrame, key: str) -> DataFrame:
    """(key, p, t_parcel, t_env, sign) of each parcel level, the environment interpolated in ln p; under 5e-10 K apart they are equal, as at the surface."""
    x = lift_parcel(profiles).select(key, "levels", F.explode_outer("parcel").alias("q"))
    x = x.withColumns({"_b": F.try_element_at(F.filter("levels", lambda lv: lv["p"] >= F.col("q.p")), F.lit(-1)), "_a": F.try_element_at(F.filter("levels", lambda lv: lv["p"] < F.col("q.p")), F.lit(1))})
    f = F.try_divide(F.log("_b.p") - F.log("q.p"), F.log("_b.p") - F.log("_a.p"))
    env = F.when(F.col("_a").isNull(), F.element_at(F.col("levels"), -1)["t"]).otherwise(F.col("_b.t") + (F.col("_a.t") - F.col("_b.t")) * f)
    return x.withColumn("t_env", env).select(key, F.col("q.p").alias("p"), F.col("q.t").alias("t_parcel"), "t_env", F.signum(F.round(F.col("q.t") - F.col("t_env"), 9)).cast("int").alias("sign"))


def profile_params(profiles: DataFrame, key: str, cape: Column | None = None, cin: Column | None = None) -> DataFrame:
    """Helicity, shear, lapse rate, LCL, precipitable water and motions of each profile, and with its CAPE (and CIN as a positive
    magnitude) the energy-helicity indices, the supercell and the significant tornado parameter; these are null without."""
    b, s = with_bunkers(profiles), F.element_at(F.col("levels"), 1)
    given = lambda c: (F.lit(None) if c is None else c).cast("double")
    out = b.select(
        key, srh(1000.0, "right").alias("srh1"), srh(3000.0, "right").alias("srh3"), bulk_shear_kt(1000.0).alias("shr1"), bulk_shear_kt(6000.0).alias("shr6"), lapse_700_500().alias("lapse"),
        F.greatest(F.lit(0.0), 125 * (s["t"] - s["td"])).alias("lcl"), pwat().alias("pwat"), F.col("right.u").alias("rm_u"), F.col("right.v").alias("rm_v"), given(cape).alias("_cape"), given(cin).alias("_cin"),
    )
    known = lambda e: F.when(F.col("_cape").isNotNull(), e)
    return out.withColumns({
        "ehi1": known(ehi("_cape", "srh1")), "ehi3": known(ehi("_cape", "srh3")), "scp": known(scp("_cape", "srh3", "shr6 / 1.943844")),
        "stp": F.when(F.col("_cin").isNotNull(), known(stp("_cape", "lcl", "srh1", "shr6 / 1.943844", "-_cin"))),
    }).drop("_cape", "_cin")
