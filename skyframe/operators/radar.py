"""Radar sweeps: codes, sweeps and their geometry, velocity unfolding, sampling, sections.

Gate rows are (sweep keys..., azimuth, gate, value); radial rows carry `moments`, a map of arrays of codes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions import geo
from skyframe.functions.weather import encode_gate, gate_value
from skyframe.operators.joins import dimension


def explode_gates(radials: DataFrame, moment: str) -> DataFrame:
    """One row per gate of a moment, with range and value; radials without it are left out."""
    m = F.col("moments")[moment]
    rows = radials.filter(F.map_contains_key("moments", F.lit(moment))).select(*(c for c in radials.columns if c != "moments"), m.alias("_m"), F.posexplode(m["raw"]).alias("gate", "code"))
    return rows.withColumns({"range_m": F.col("_m.first_gate") + F.col("gate") * F.col("_m.gate_spacing"), "value": gate_value("code", "_m.scale", "_m.offset")}).drop("_m")


def with_site(df: DataFrame, sites: DataFrame) -> DataFrame:
    """P5: missing site positions from the catalogue, by header id, else by key id."""
    by = lambda k: sites.select(F.col("site").alias(k), F.struct("lat", "lon").alias(f"_{k}"))
    out = df.join(dimension(by("icao")), "icao", "left").join(dimension(by("key_id")), "key_id", "left")
    place = F.coalesce(F.col("_icao"), F.col("_key_id"))
    return out.withColumns({"lat": F.coalesce("lat", place["lat"]), "lon": F.coalesce("lon", place["lon"])}).drop("_icao", "_key_id")


def build_sweeps(radials: DataFrame, by: Sequence[str] = ("volume", "elevation_number")) -> DataFrame:
    """A1: per elevation number its elevation, moments, super-resolution flag and the time of the lowest azimuth."""
    return radials.groupBy(*by).agg(F.min_by("elevation", "azimuth_number").alias("elevation"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("moments"))))).alias("moments"), F.bool_or(F.col("azimuth_spacing") < 0.75).alias("super_res"), F.min_by("time", "azimuth").alias("time"), F.count("*").alias("n_radials"))


def sweep_max_range(gates: DataFrame, by: Sequence[str]) -> DataFrame:
    """A2: the far end of the farthest gate."""
    return gates.groupBy(*by).agg(F.max("range_m").alias("max_range_m"))


def azimuth_spacing(gates: DataFrame, by: Sequence[str]) -> DataFrame:
    """A3: median gap between distinct azimuths (over 0.01 from the last kept one), gaps of (0.01, 5] with the one across north."""
    sorted_ = gates.groupBy(*by).agg(F.array_sort(F.collect_set("azimuth")).alias("_a"))
    kept = F.aggregate("_a", F.array().cast("array<double>"), lambda acc, a: F.when((F.size(acc) == 0) | (a - F.element_at(acc, -1) > 0.01), F.concat(acc, F.array(a))).otherwise(acc))
    k = sorted_.withColumn("_k", kept)
    gaps = F.concat(F.transform(F.slice("_k", F.lit(2), F.greatest(F.size("_k") - 1, F.lit(0))), lambda x, i: x - F.get("_k", i)), F.when(F.size("_k") > 1, F.array(F.element_at("_k", 1) + 360 - F.element_at("_k", -1))).otherwise(F.array().cast("array<double>")))
    each = k.select(*by, F.explode_outer(gaps).alias("gap")).withColumn("gap", F.when((F.col("gap") > 0.01) & (F.col("gap") <= 5), F.col("gap")))
    return each.groupBy(*by).agg(F.percentile("gap", F.lit(0.5)).alias("spacing"))


def describe_resolution(gates: DataFrame, by: Sequence[str], fine_gate: float = 1000.0) -> DataFrame:
    """A4: gate counts, azimuth and gate spacing, range, and whether the sweep is of super resolution."""
    step = F.col("range_m") - F.lag("range_m").over(Window.partitionBy(*by, "azimuth").orderBy("gate"))
    per_gate = step / (F.col("gate") - F.lag("gate").over(Window.partitionBy(*by, "azimuth").orderBy("gate")))
    g = gates.withColumn("_step", per_gate).groupBy(*by).agg(F.count("*").alias("n_gates"), F.count_distinct("azimuth").alias("n_radials"), F.percentile("_step", F.lit(0.5)).alias("gate_spacing"), F.min("_step").alias("min_gate_spacing"), F.max("range_m").alias("max_range_m"))
    out = g.join(azimuth_spacing(gates, by).hint("merge"), list(by))
    return out.withColumn("super_res", (F.col("spacing") < 0.75) | (F.col("gate_spacing") < fine_gate))


def pool_legacy(gates: DataFrame, by: Sequence[str], gate_m: float, first_m: float, scale: float = 2, offset: float = 66) -> DataFrame:
    """A5: mean value in cells of one degree and gate_m metres, with the cell's centre azimuth and code."""
    az = F.pmod(F.floor(F.col("azimuth") + 1e-6), F.lit(360))
    bin_ = F.floor((F.col("range_m") - first_m) / gate_m + 1e-6)
    out = gates.filter("value IS NOT NULL").groupBy(*by, (az + 0.5).alias("azimuth"), bin_.alias("gate")).agg(F.avg("value").alias("value"))
    return out.withColumn("code", encode_gate("value", scale, offset, 255))


def vad_fit(gates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least squares of velocity on sine and cosine of azimuth over every fourth gate; no fit is no wind."""
    s, c, v = F.sin(F.radians("azimuth")), F.cos(F.radians("azimuth")), F.col("value")
    sums = gates.filter((F.col("gate") % 4 == 0) & v.isNotNull()).groupBy(*by).agg(F.sum(s * s).alias("ss"), F.sum(c * c).alias("cc"), F.sum(s * c).alias("sc"), F.sum(v * s).alias("vs"), F.sum(v * c).alias("vc"))
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    fit = lambda x: F.when(F.abs(det) > 1e-6, x / det).otherwise(0.0)
    return sums.select(*by, fit(F.col("vs") * F.col("cc") - F.col("vc") * F.col("sc")).alias("u"), fit(F.col("vc") * F.col("ss") - F.col("vs") * F.col("sc")).alias("v"))


def storm_relative(gates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Velocity less the component of the fitted wind along the beam."""
    return gates.join(vad_fit(gates, by).hint("merge"), list(by)).withColumn("value", F.col("value") - F.col("u") * F.sin(F.radians("azimuth")) - F.col("v") * F.cos(F.radians("azimuth"))).drop("u", "v")


def kdp(gates: DataFrame, by: Sequence[str], gate_km: float = 0.25, half: int = 4) -> DataFrame:
    """Half the range derivative of differential phase over +-4 gates, wrapped to +-180 degrees, in steps of 0.01; ends are missing.

    `gates` must have a row for every gate, missing values being null.
    """
    w = Window.partitionBy(*by, "azimuth").orderBy("gate")
    d = F.pmod(F.lead("value", half).over(w) - F.lag("value", half).over(w) + 180, F.lit(360.0)) - 180
    return gates.withColumn("kdp", F.floor(d / (2 * 2 * half * gate_km) * 100 + 0.5) / 100)


def _half_up(x):
    return np.floor(x + 0.5)


def unfold(values: np.ndarray, nyquist: np.ndarray) -> np.ndarray:
    """Fold each gate toward the median of up to 5 unfolded gates before it on the beam (3 at least), else the gate of the beam before."""
    out, before = values.copy(), None
    for r in range(len(out)):
        two = 2 * nyquist[r]
        if 0 < nyquist[r] < 100:
            last: list[float] = []
            for g in range(out.shape[1]):
                v = out[r, g]
                if np.isnan(v):
                    last = []
                    continue
                ref = np.median(last) if len(last) >= 3 else (before[g] if before is not None and not np.isnan(before[g]) else None)
                if ref is not None:
                    v = v + _half_up((ref - v) / two) * two
                out[r, g] = v
                last = [*last[-4:], v]
        before = out[r]
    return out


def despoke_pairs(v: np.ndarray, nyquist: np.ndarray, passes: int = 3) -> np.ndarray:
    """Where both neighbour beams imply the same non-zero fold, apply it; in place, beam after beam, azimuth wraps."""
    n = len(v)
    for _ in range(passes if n >= 3 else 0):
        changed = 0
        for r in range(n):
            if not 0 < nyquist[r] < 100:
                continue
            two = 2 * nyquist[r]
            fa, fb = _half_up((v[r - 1] - v[r]) / two), _half_up((v[(r + 1) % n] - v[r]) / two)
            hit = (fa == fb) & (fa != 0)
            v[r, hit] += fa[hit] * two
            changed += hit.sum()
        if not changed:
            break
    return v


def despoke_median(v: np.ndarray, nyquist: np.ndarray, passes: int = 2, reach: int = 4, gain: float = 0.35) -> np.ndarray:
    """Fold toward the median of the +-4 neighbour beams (4 finite ones at least) if that gains 0.35 of the interval."""
    n = len(v)
    for _ in range(passes if n >= reach + 1 else 0):
        changed = 0
        for r in range(n):
            if not 0 < nyquist[r] < 100:
                continue
            two = 2 * nyquist[r]
            near = np.stack([v[(r + k) % n] for k in range(-reach, reach + 1) if k and (r + k) % n != r])
            enough = (~np.isnan(near)).sum(axis=0) >= 4
            with np.errstate(all="ignore"):
                med = np.nanmedian(np.where(enough, near, 0), axis=0)
            k = _half_up((med - v[r]) / two)
            better = np.abs(v[r] - med) - np.abs(v[r] + k * two - med) >= gain * two
            hit = enough & ~np.isnan(v[r]) & (k != 0) & better
            v[r, hit] += k[hit] * two
            changed += hit.sum()
        if not changed:
            break
    return v


def revert_runs(v: np.ndarray, raw: np.ndarray, least: int = 18, fast: float = 44.0, share: float = 0.35, support: float = 22.0) -> np.ndarray:
    """W5, in place, beam after beam (azimuth wraps; under 3 beams a beam is its own neighbour): runs of 18 or more folded gates of 44 m/s or more that under 35 % of neighbours back (same sign, 22 m/s) go back to native values."""
    n = len(v)
    for r in range(n):
        odd = (np.abs(v[r]) >= fast) & (np.abs(v[r] - raw[r]) > 1e-6)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], odd.astype(int), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= least:
                seg = v[r, a:b]
                backed = sum(((np.sign(v[k, a:b]) == np.sign(seg)) & (np.abs(v[k, a:b]) >= support)).astype(int) for k in ((r - 1, (r + 1) % n) if n >= 3 else (r,))) > 0
                if backed.mean() < share:
                    v[r, a:b] = raw[r, a:b]
    return v


def dealias(gates: DataFrame, by: Sequence[str], nyquist: Column, steps: bool = False, runs: dict | None = None) -> DataFrame:
    """Unfolded velocity of every gate (null stays null). A sweep is one group: each gate depends on the ones before it.

    steps: also what W2, W3 and W4 gave, as columns of these names. runs: other limits of W5 (arguments of revert_runs).
    """
    rows = gates.select(*by, F.col("azimuth").cast("double").alias("azimuth"), F.col("gate").cast("long").alias("gate"), F.col("value").cast("double").alias("value"), nyquist.cast("double").alias("nyquist"))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        az, row = np.unique(pdf["azimuth"].to_numpy(), return_inverse=True)
        grid = np.full((len(az), int(pdf["gate"].max()) + 1), np.nan)
        grid[row, pdf["gate"]] = pdf["value"]
        vn = np.zeros(len(az))
        vn[row] = pdf["nyquist"]
        held = {"w2": unfold(grid, vn)}
        held["w3"] = despoke_pairs(held["w2"].copy(), vn)
        held["w4"] = despoke_median(held["w3"].copy(), vn)
        held["unfolded"] = revert_runs(held["w4"].copy(), grid, **(runs or {}))
        at = lambda v: pd.Series(v[row, pdf["gate"]], index=pdf.index).where(pdf["value"].notna(), None).astype("float64")
        return pdf.assign(**{c: at(held[c]) for c in made})

    made = ["w2", "w3", "w4", "unfolded"] if steps else ["unfolded"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {c} double" for c in made)
    return rows.groupBy(*by).applyInPandas(sweep, schema).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in made})


def find_runs(gates: DataFrame, by: Sequence[str], flag: Column) -> DataFrame:
    """W5's stand-alone form: runs of flagged gates along a beam as (by, azimuth, first, last, n)."""
    w = Window.partitionBy(*by, "azimuth").orderBy("gate")
    hit = gates.filter(flag).withColumn("_k", F.col("gate") - F.row_number().over(w))
    return hit.groupBy(*by, "azimuth", "_k").agg(F.min("gate").alias("first"), F.max("gate").alias("last"), F.count("*").alias("n")).drop("_k")


def dedupe_tilts(sweeps: DataFrame, by: Sequence[str], tolerance: float = 0.1) -> DataFrame:
    """Ascending tilts, those within 0.1 degrees of the last kept one merged, the freshest kept: (by, elevation, time)."""
    freshest = sweeps.groupBy(*by, F.col("elevation").cast("double").alias("elevation")).agg(F.max("time").alias("time"))
    a = freshest.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("elevation", "time"))).alias("_s"))
    kind = a.schema["_s"].dataType.simpleString()
    fold = F.aggregate("_s", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) > 0) & (x["elevation"] - F.element_at(acc, -1)["elevation"] <= tolerance), F.when(x["time"] > F.element_at(acc, -1)["time"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    return a.select(*by, F.explode(fold).alias("x")).select(*by, "x.*")


def pick_sweep(sweeps: DataFrame, by: Sequence[str], elevation: float, slack: float = 0.1) -> DataFrame:
    """Of the tilts within 0.1 degrees of the best fit, the freshest. Two groupings, so no volume or site is sorted in one task."""
    d = F.abs(F.col("elevation") - elevation)
    best = sweeps.groupBy(*by).agg(F.min(d).alias("_best")).select(*(F.col(k).alias(f"_{k}_of") for k in by), "_best")
    near = sweeps.join(best.hint("merge"), [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in by]).filter(d <= F.col("_best") + slack)
    rest = [c for c in sweeps.columns if c not in by]
    first = F.max_by(F.struct(*rest), F.struct("time", -d, -F.col("elevation"))).alias("_x")
    return near.groupBy(*by).agg(first).select(*by, "_x.*").select(*sweeps.columns)


def coherent_tilts(sweeps: DataFrame, by: Sequence[str], tolerance: float = 0.15) -> DataFrame:
    """Tilts within 0.15 degrees of a group's first form a group; each gives its newest scan up to the time all groups have reached."""
    a = sweeps.groupBy(*by).agg(F.array_sort(F.collect_set(F.col("elevation").cast("double"))).alias("_e"))
    heads = F.aggregate("_e", F.array().cast("array<double>"), lambda acc, e: F.when((F.size(acc) == 0) | (e - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(e))).otherwise(acc))
    g = sweeps.join(a.select(*by, heads.alias("_h")).hint("merge"), list(by)).withColumn("tilt", F.array_max(F.filter("_h", lambda h: h <= F.col("elevation"))))
    newest = g.groupBy(*by, "tilt").agg(F.max("time").alias("_new")).groupBy(*by).agg(F.min("_new").alias("_cut"))
    cut = g.join(newest.hint("merge"), list(by)).filter(F.col("time") <= F.col("_cut"))
    return cut.groupBy(*by, "tilt").agg(F.max(F.struct("time", "elevation")).alias("x")).select(*by, "tilt", "x.time", "x.elevation")


def fullest_volume(sweeps: DataFrame, by: str, volume: str, last: int = 6, tolerance: float = 0.1) -> DataFrame:
    """Of the last 6 volumes the one with most distinct tilts x 100 + top tilt, the newest on ties."""
    a = sweeps.groupBy(by, volume).agg(F.array_sort(F.collect_set(F.col("elevation").cast("double"))).alias("_e"))
    kept = F.aggregate("_e", F.array().cast("array<double>"), lambda acc, e: F.when((F.size(acc) == 0) | (e - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(e))).otherwise(acc))
    s = a.withColumns({"tilts": F.size(kept), "top": F.array_max("_e")}).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(volume)))).filter(F.col("_r") <= last)
    return s.groupBy(by).agg(F.max(F.struct((F.col("tilts") * 100 + F.col("top")).alias("score"), F.col(volume).alias(volume))).alias("x")).select(by, f"x.{volume}", "x.score")


def regrid_azimuth(radials: DataFrame, by: Sequence[str], bins: int = 1440, max_gap: float = 1.5) -> DataFrame:
    """To each of 1440 azimuth bins the nearest beam within 1.5 degrees, the lower one on ties: (by, bin, azimuth)."""
    beams = radials.select(*by, F.col("azimuth").cast("double").alias("azimuth")).distinct()
    around = beams.select(*by, F.explode(F.array(F.col("azimuth") - 360, F.col("azimuth"), F.col("azimuth") + 360)).alias("at"), "azimuth")
    grid = beams.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("at", (F.col("bin") + 0.5) * 360 / bins)
    both = around.unionByName(grid, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("at", F.col("bin").asc_nulls_first())
    beam = F.when(F.col("azimuth").isNotNull(), F.struct("at", "azimuth"))
    b = both.withColumns({"_lo": F.last(beam, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_hi": F.first(beam, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).filter("bin IS NOT NULL")
    dl, dh = F.col("at") - F.col("_lo.at"), F.col("_hi.at") - F.col("at")
    near = F.when((dl <= dh) & (dl <= max_gap), F.col("_lo.azimuth")).when((dh < dl) & (dh <= max_gap), F.col("_hi.azimuth"))
    return b.select(*by, "bin", near.alias("azimuth"))


def _from_site(site_lat: Column | float, site_lon: Column | float) -> tuple[Column, Column]:
    """Metres east and north of a site to (lat, lon), on a flat earth; the site's place is a number or a column."""
    la, lo = (F.lit(c) if isinstance(c, float | int) else c for c in (site_lat, site_lon))
    return (F.col("lon") - lo) * geo.M_PER_DEG * F.cos(F.radians(la)), (F.col("lat") - la) * geo.M_PER_DEG


def sample_radar(points: DataFrame, gates: DataFrame, by: Sequence[str], site_lat: Column | float, site_lon: Column | float, first_m: float, gate_m: float, bins: int = 720, site: Sequence[str] = ()) -> DataFrame:
    """The gate under each point (lat, lon) on a flat earth: nearest beam by azimuth, then nearest gate; null out of range.

    With `site`, some of `by` that points have too, points meet the gates of their own site, whose place is in columns. Beams are first put on `bins` azimuth bins, so points meet them in an equi-join.
    """
    east, north = _from_site(site_lat, site_lon)
    az = F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))
    p = points.withColumns({"_bin": F.floor(az * bins / 360).cast("int"), "_gate": F.floor((F.sqrt(east * east + north * north) - first_m) / gate_m + 0.5).cast("long")})
    beams = regrid_azimuth(gates, by, bins, 360.0)
    g = gates.join(beams.hint("merge"), [*by, "azimuth"]).select(*by, F.col("bin").alias("_b"), F.col("gate").cast("long").alias("_g"), "azimuth", "value").withColumnsRenamed({k: f"_{k}_of" for k in site})
    same = [F.col("_bin") == F.col("_b"), F.col("_gate") == F.col("_g"), *(F.col(k) == F.col(f"_{k}_of") for k in site)]
    return p.join(g.hint("merge"), same).drop("_bin", "_gate", "_b", "_g", *(f"_{k}_of" for k in site))


def gates_to_cells(gates: DataFrame, site_lat: Column | float, site_lon: Column | float, lon1: float, lat1: float, step: float) -> DataFrame:
    """I, j of the guidance cell under each gate, on a flat earth; the site's place is a number or a column of gates."""
    site_lat, site_lon = (F.lit(c) if isinstance(c, float | int) else c for c in (site_lat, site_lon))
    lat = site_lat + F.col("range_m") * F.cos(F.radians("azimuth")) / geo.M_PER_DEG
    lon = site_lon + F.col("range_m") * F.sin(F.radians("azimuth")) / (geo.M_PER_DEG * F.cos(F.radians(site_lat)))
    return gates.withColumns({"i": F.floor((lon - lon1) / step + 0.5), "j": F.floor((F.lit(lat1) - lat) / step + 0.5)})


def gate_exceedance(gates: DataFrame, guidance: DataFrame, least: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """Rain at a gate over the guidance of its cell, kept from 0.25 mm up, in steps of 0.1; `by`: the run and whatever
    else gates and guidance have in common."""
    out = gates.join(guidance.select(*by, "i", "j", F.col("value").alias("ffg")).hint("merge"), [*by, "i", "j"])
    over = F.col("value") - F.col("ffg")
    return out.withColumn("exceed", F.when(over >= least, F.floor(over * 10 + 0.5) / 10)).filter("exceed IS NOT NULL")


def cross_section(gates: DataFrame, columns: DataFrame, by: Sequence[str], site_lat: Column | float, site_lon: Column | float, first_m: float, gate_m: float, elevation: Column, bins: int = 720, site: Sequence[str] = ()) -> DataFrame:
    """Per column point (col, lat, lon) and tilt of its site (`site`, some of `by`) with a beam within 1.6 degrees: value and beam height of the gate over it."""
    east, north = _from_site(site_lat, site_lon)
    c = columns.withColumns({"dist_m": F.greatest(F.sqrt(east * east + north * north), F.lit(2.0)), "_bin": F.floor(F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)) * bins / 360).cast("int")})
    beams = regrid_azimuth(gates, by, bins, 1.6).filter("azimuth IS NOT NULL").withColumnRenamed("bin", "_bin").withColumn("elevation", elevation)
    at = c.join(beams.hint("merge"), ["_bin", *site]).withColumn("slant_m", geo.slant_range("dist_m", "elevation"))
    at = at.withColumns({"_gate": F.floor((F.col("slant_m") - first_m) / gate_m + 0.5).cast("long"), "height_m": geo.beam_height("slant_m", "elevation")})
    g = gates.select(*by, F.col("azimuth").cast("double").alias("azimuth"), F.col("gate").cast("long").alias("_gate"), "value")
    return at.join(g.hint("merge"), [*by, "azimuth", "_gate"], "left").drop("_bin", "_gate")


def available_products(sweeps: DataFrame, products: dict[str, str]) -> DataFrame:
    """Products whose moment a volume has; dual-polarisation ones are left out for terminal radars (`terminal`)."""
    table = F.create_map(*(F.lit(v) for kv in products.items() for v in kv))
    dual = ("ZDR", "CC", "KDP")
    names = F.filter(F.map_keys(table), lambda p: F.array_contains("moments", F.element_at(table, p)) & ~(F.col("terminal") & p.isin(*dual)))
    return sweeps.withColumn("products", F.array_sort(names))


def range_rings(sites: DataFrame, max_range_m: float, every_m: float = 100_000.0, vertices: int = 73) -> DataFrame:
    """(site, ring_m, ring array<struct<lon, lat>>), a ring every 100 km."""
    r = sites.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(int(max_range_m // every_m))))).withColumn("ring_m", F.col("_k") * every_m).drop("_k")
    step = 360.0 / (vertices - 1)
    turn = lambda k: F.radians(k * step)
    d = F.col("ring_m") / geo.R_EARTH
    la = F.radians("lat")
    lat2 = lambda k: F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(turn(k)))
    lon2 = lambda k: F.col("lon") + F.degrees(F.atan2(F.sin(turn(k)) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(lat2(k))))
    return r.withColumn("ring", F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), lambda k: F.struct(lon2(k).alias("lon"), F.degrees(lat2(k)).alias("lat"))))
