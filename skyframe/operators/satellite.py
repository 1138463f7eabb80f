"""Satellite pixels, lightning and microwave swaths. Pixels are (scene keys..., row, col, bands...)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.formula import Formula
from skyframe.functions.weather import auto_estimator_rate, stretch
from skyframe.operators import grid, series
from skyframe.operators.joins import dealt, dimension
from skyframe.sources.shared import staged

# The retrieval's constants.
PRECIP = {
    "tMax": 250, "meanRadiusKm": 60, "cloudMaxK": 265, "anomWarm": -1.5, "anomCold": 3, "thinLo": -1, "thinHi": 1.5, "otLo": -3, "otHi": 0, "otGain": 0.9,
    "ltgRadiusKm": 15, "ltgSat": 1.5, "ltgGain": 1.2, "compress": 0.5, "compressRef": 4, "gain": 1.1, "maxRate": 150, "floor": 0.2,
}
# The bands of each product.
BANDS = {"truecolor": (1, 2, 3), "natural": (2, 3, 5), "daycloud": (2, 5, 13), "airmass": (8, 10, 12, 13), "nightmicro": (7, 13, 15), "geocolor": (1, 2, 3, 13), "precip": (8, 13, 15)}


def bands_for(product: str) -> tuple[int, ...]:
    """The bands a product reads; a band's own id for single channels."""
    return BANDS.get(product) or (int(product.removeprefix("band")),)


def rate_formula(params: dict | None = None) -> Formula:
    """Rate from t13 {0}, t15 {1}, t8 {2}, the cloud mean {3} and flashes a minute {4}; nulls switch a term off. `params` overrides constants."""
    p = PRECIP | (params or {})
    clamp = lambda e: f"least(1.0, greatest(0.0, {e}))"
    conv = f"coalesce({clamp('{4} / ' + str(float(p['ltgSat'])))}, 0.0)"
    anom = f"greatest(coalesce({clamp('({3} - {0} - (' + str(p['anomWarm']) + ')) / ' + str(float(p['anomCold'] - p['anomWarm'])))}, 1.0), {conv})"
    thin = f"CASE WHEN {{1}} IS NULL THEN 1.0 ELSE greatest({clamp('1.0 - ({0} - {1} - (' + str(p['thinLo']) + ')) / ' + str(float(p['thinHi'] - p['thinLo'])))}, {conv}) END"
    over = f"CASE WHEN {{2}} IS NULL THEN 1.0 ELSE 1.0 + {p['otGain']} * {clamp('({2} - {0} - (' + str(p['otLo']) + ')) / ' + str(float(p['otHi'] - p['otLo'])))} END"
    core = auto_estimator_rate.sql("{0}")
    raw = f"(({core}) * ({anom}) * ({thin}) * ({over}) * (1.0 + {p['ltgGain']} * {conv}))"
    squeezed = raw if p["compress"] == 1 else f"(CASE WHEN {raw} > 0 THEN {p['compressRef']} * pow({raw} / {p['compressRef']}, {p['compress']}) ELSE 0 END)"
    out = f"least({float(p['maxRate'])}, {squeezed} * {p['gain']})"
    return Formula("rain rate", f"CASE WHEN {{0}} IS NULL THEN NULL WHEN {{0}} >= {p['tMax']} THEN 0.0 WHEN {out} < {p['floor']} THEN 0.0 ELSE {out} END")


def flash_counts(flashes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flashes per pixel; `flashes` has row and col (of sample_scene)."""
    return flashes.groupBy(*by, "row", "col").agg(F.count("*").alias("n"))


def flash_density(flashes: DataFrame, n_rows: int, n_cols: int, radius: int, minutes: float = 5, by: Sequence[str] = ()) -> DataFrame:
    """Flashes a minute in the box around every pixel: (row, col, density)."""
    c = flash_counts(flashes, by).select(*by, F.col("row").alias("i"), F.col("col").alias("j"), F.col("n").cast("double").alias("value"))
    return grid.box_sum(c, n_rows, n_cols, radius, by).select(*by, F.col("i").alias("row"), F.col("j").alias("col"), (F.col("sum") / minutes).alias("density"))


def satellite_precip(pixels: DataFrame, n_rows: int, n_cols: int, radius: int, density: DataFrame | None = None, by: Sequence[str] = (), params: dict | None = None) -> DataFrame:
    """Rain rate of pixels (row, col, t13, t15, t8), with lightning where a density is given."""
    p = PRECIP | (params or {})
    cells = pixels.select(*by, F.col("row").alias("i"), F.col("col").alias("j"), F.col("t13").alias("value"))
    mean = grid.box_mean(cells, n_rows, n_cols, radius, p["cloudMaxK"], by).select(*by, F.col("i").alias("row"), F.col("j").alias("col"), "mean")
    out = pixels.join(mean.hint("merge"), [*by, "row", "col"])
    out = out.join(density.hint("merge"), [*by, "row", "col"], "left") if density is not None else out.withColumn("density", F.lit(None).cast("double"))
    return out.withColumn("rate", rate_formula(params)("t13", "t15", "t8", "mean", "density"))


def recent_flashes(flashes: DataFrame, scenes: DataFrame, minutes: int = 5) -> DataFrame:
    """Flashes of the `minutes` before each scene's time, by minute buckets: (scene, row, col)."""
    span = minutes * 60_000_000
    f = flashes.select(series.micros("time").alias("_us"), "row", "col").withColumn("_b", F.floor(F.col("_us") / span))
    s = scenes.select("scene", series.micros("time").alias("_at")).withColumn("_b2", F.explode(F.array(F.floor(F.col("_at") / span) - 1, F.floor(F.col("_at") / span))))
    return f.join(s.hint("merge"), (F.col("_b") == F.col("_b2")) & (F.col("_us") >= F.col("_at") - span) & (F.col("_us") < F.col("_at"))).select("scene", "row", "col")


def recent_flash_counts(flashes: DataFrame, scenes: DataFrame, minutes: int = 5) -> DataFrame:
    """Flashes per pixel of the `minutes` before each scene's time, a row of `scenes` each: (scene, row, col, n).

    A scene has one bucket of time, a flash its own and the next. Pairs are counted where they meet: only flashes and scenes are shuffled.
    """
    span = minutes * 60_000_000
    own = F.floor(F.col("_us") / span)
    f = flashes.select(series.micros("time").alias("_us"), "row", "col").withColumn("_b", F.explode(F.array(own, own + 1)))
    s = scenes.select("scene", series.micros("time").alias("_at")).withColumn("_b2", F.floor(F.col("_at") / span))
    met = f.join(s.hint("merge"), (F.col("_b") == F.col("_b2")) & (F.col("_us") >= F.col("_at") - span) & (F.col("_us") < F.col("_at")))
    return flash_counts(met, ["_b2", "scene"]).drop("_b2")


def sample_scene(points: DataFrame, pixels: DataFrame, row: Column, col: Column, by: Sequence[str] = ()) -> DataFrame:
    """The pixel under each point by its navigated row and column, of the point's own scene (`by`); null off the disk."""
    p = points.withColumns({"_r": F.floor(row + 0.5).cast("long"), "_c": F.floor(col + 0.5).cast("long")})
    x = pixels.withColumnsRenamed({"row": "_row", "col": "_col", **{k: f"_{k}_of" for k in by}})
    same = [(F.col("_r") == F.col("_row")) & (F.col("_c") == F.col("_col")), *(F.col(k) == F.col(f"_{k}_of") for k in by)]
    return p.join(x.hint("merge"), same, "left").drop("_r", "_c", "_row", "_col", *(f"_{k}_of" for k in by))


def pair_fields(cells: DataFrame, pixels: DataFrame, row: Column, col: Column, by: Sequence[str] = ()) -> DataFrame:
    """Radar cells (radar) with the satellite value (sat) over them in their scene (`by`); both present, radar not negative."""
    return sample_scene(cells, pixels, row, col, by).filter(F.col("sat").isNotNull() & (F.col("radar") >= 0))


def verify_precip(pairs: DataFrame, frame: str, thresholds: Sequence[float] = (0.5, 2.5, 10)) -> DataFrame:
    """Scores of paired fields per frame and, with a null frame, pooled; all in one grouping."""
    both = pairs.select(F.explode(F.array(F.col(frame).cast("string"), F.lit(None).cast("string"))).alias(frame), "sat", "radar")
    scores = both.groupBy(frame).agg(*series.continuous_columns(), series.contingency(thresholds).alias("_k"))
    return series.with_skill(scores.select(*(c for c in scores.columns if c != "_k"), F.inline("_k")))


# The box that radar rain covers (west, south, east, north).
RADAR_BOX = (-125.0, 25.0, -66.5, 49.0)


def box_share(west: str, south: str, east: str, north: str, box: tuple[float, float, float, float] = RADAR_BOX) -> Column:
    """The share of a scene's bounds that lies inside a box."""
    w, s, e, n = box
    across, up = F.least(F.col(east), F.lit(e)) - F.greatest(F.col(west), F.lit(w)), F.least(F.col(north), F.lit(n)) - F.greatest(F.col(south), F.lit(s))
    return F.when((across > 0) & (up > 0), across * up / ((F.col(east) - F.col(west)) * (F.col(north) - F.col(south)))).otherwise(0.0)


Rows = Callable[[DataFrame], DataFrame]


def verification_pairs(
    scenes: DataFrame, pixels: DataFrame | Rows, frames: DataFrame, cells: DataFrame | Rows, row: Column, col: Column, least_share: float = 0.25, tolerance_s: int = 720, per_task: int = 2_000
) -> DataFrame:
    """(scene, frame, ..., sat, radar) of all scenes that radar can verify.

    scenes (scene, time, west, south, east, north) with a quarter of their bounds in the radar's box meet the radar frame (frame, time)
    nearest in time, within 12 minutes; its cells (frame, lat, lon, radar) inside the scene and the box take the pixel
    (scene, row, col, sat) that they are navigated to: `row` and `col` are expressions over lat, lon and the scene's bounds.

    pixels and cells are tables, or functions that give the pixels of a table's scenes and the cells of a table's frames, a row for
    each and the table's columns beside. Of functions only scenes and frames that pair are asked for, in the tasks that `per_task` scenes
    are dealt to, and nothing finer than a scene is shuffled: cells and pixels meet in a window over each place of a scene.
    """
    seen = scenes.filter(box_share("west", "south", "east", "north") >= least_share).withColumn("_all", F.lit(0))
    near = series.nearest_join(seen, frames.withColumn("_all", F.lit(0)), "_all", "time", "scene", "frame", tolerance_s).select(F.col("left_key").alias("scene"), F.col("right_key").alias("frame"))
    paired = staged(near.join(seen.drop("time", "_all").hint("merge"), "scene"), "scenes-and-frames")
    paired = dealt(paired, paired.count(), "scene", per_task=per_task)
    met = cells(paired) if callable(cells) else cells.join(paired.hint("merge"), "frame")
    w, s, e, n = RADAR_BOX
    inside = F.col("lon").between(F.greatest(F.col("west"), F.lit(w)), F.least(F.col("east"), F.lit(e))) & F.col("lat").between(F.greatest(F.col("south"), F.lit(s)), F.least(F.col("north"), F.lit(n)))
    met = met.filter(inside & (F.col("radar") >= 0)).withColumns({"_r": F.floor(row + 0.5).cast("long"), "_c": F.floor(col + 0.5).cast("long")}).filter("_r IS NOT NULL AND _c IS NOT NULL")
    x = pixels(paired.select("scene").distinct()) if callable(pixels) else pixels
    x = x.filter("sat IS NOT NULL").select("scene", F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col("sat").alias("_sat"))
    sats = F.collect_list("_sat").over(Window.partitionBy("scene", "_r", "_c"))
    both = met.unionByName(x, allowMissingColumns=True).withColumn("_sats", sats).filter("radar IS NOT NULL")
    return both.withColumn("sat", F.explode("_sats")).drop("_r", "_c", "_sat", "_sats")


def scene_window(x0: float, y0: float, x1: float, y1: float, width: int, height: int, pad: int = 8) -> tuple[int, int, int, int] | None:
    """Rows and columns of a box's navigated bounds, padded; None if that is over 80 % of the grid."""
    c0, c1, r0, r1 = max(0, int(min(x0, x1)) - pad), min(width, int(max(x0, x1)) + pad + 1), max(0, int(min(y0, y1)) - pad), min(height, int(max(y0, y1)) + pad + 1)
    return None if (c1 - c0) * (r1 - r0) > 0.8 * width * height else (r0, r1, c0, c1)


def segments_for(row: Column, n_rows: int, n: int = 10) -> Column:
    """Which of n bands of rows a row lies in, 1 to n."""
    return F.least(F.lit(n), F.floor(row * n / n_rows) + 1)


def resample_fixed(pixels: DataFrame, row_scale: float, row_offset: float, col_scale: float, col_offset: float, n_rows: int, n_cols: int, by: Sequence[str] = ()) -> DataFrame:
    """Nearest source pixel of each pixel of another fixed grid, in every scene (`by`): source = target x scale + offset."""
    target = (pixels.select(*by).distinct() if by else pixels.sparkSession.range(1)).select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("row"))
    target = target.select(*by, F.col("row").cast("long").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("col")).withColumn("col", F.col("col").cast("long"))
    at = target.withColumns({"_r": F.floor(F.col("row") * row_scale + row_offset + 0.5), "_c": F.floor(F.col("col") * col_scale + col_offset + 0.5)})
    src = pixels.withColumnsRenamed({"row": "_row", "col": "_col", **{k: f"_{k}_of" for k in by}})
    same = [(F.col("_r") == F.col("_row")) & (F.col("_c") == F.col("_col")), *(F.col(k) == F.col(f"_{k}_of") for k in by)]
    return at.join(src.hint("merge"), same).drop("_r", "_c", "_row", "_col", *(f"_{k}_of" for k in by))


def decimate(pixels: DataFrame, n: int) -> DataFrame:
    """R12"""
    return pixels.filter((F.col("row") % n == 0) & (F.col("col") % n == 0))


def composite(pixels: DataFrame, recipe: dict[str, tuple[str, float, float, float]]) -> DataFrame:
    """Red, green, blue from (expression, low, high, gamma) each."""
    return pixels.withColumns({c: stretch(*recipe[c]) for c in ("red", "green", "blue")})


def geocolor(pixels: DataFrame, weight: Column) -> DataFrame:
    """Day colours and the night infrared blended by the weight of day."""
    mix = lambda c: F.floor(F.col(c) * weight + F.col("ir") * (1 - weight) + 0.5).cast("int")
    return pixels.withColumns({c: mix(c) for c in ("red", "green", "blue")})


# The composites as (band or two bands, low, high, gamma) of red, green and blue; the green of true colour is synthetic.
COMPOSITES = {
    "truecolor": (((2,), 0, 1, 2.2), ((3,), 0, 1, 2.2), ((1,), 0, 1, 2.2)),
    "natural": (((5,), 0, 1, 1), ((3,), 0, 1, 1), ((2,), 0, 1, 1)),
    "daycloud": (((13,), 280.65, 219.65, 1), ((2,), 0, 0.78, 1), ((5,), 0.01, 0.59, 1)),
    "airmass": (((8, 10), -26.2, 0.6, 1), ((12, 13), -43.2, 6.7, 1), ((8,), 243.9, 208.5, 1)),
    "nightmicro": (((15, 13), -6.7, 2.6, 1), ((13, 7), -3.1, 5.2, 1), ((13,), 243.6, 292.6, 1)),
}
# Enhancements of infrared and water-vapour channels as (degrees C, red, green, blue), warmest first.
IR_RAMP = (
    (50, 0, 0, 0), (30, 105, 105, 105), (20, 160, 160, 160), (0, 225, 225, 225), (-20, 0, 230, 240), (-25, 0, 150, 230), (-32, 0, 40, 200), (-40, 10, 10, 120), (-42, 0, 90, 40), (-50, 0, 210, 0), (-55, 180, 230, 0),
    (-60, 240, 240, 0), (-63, 250, 150, 0), (-68, 240, 0, 0), (-72, 120, 0, 0), (-75, 10, 10, 10), (-78, 90, 90, 90), (-83, 180, 180, 180), (-87, 240, 240, 240), (-90, 255, 0, 255), (-95, 150, 0, 180),
)
WV_RAMP = (
    (0, 120, 0, 0), (-10, 230, 0, 0), (-14, 255, 120, 0), (-18, 255, 200, 0), (-20, 255, 255, 0), (-24, 150, 140, 0), (-28, 40, 40, 180), (-34, 0, 60, 200), (-40, 10, 10, 90), (-44, 120, 90, 180), (-48, 220, 210, 235),
    (-52, 255, 255, 255), (-58, 200, 235, 200), (-62, 80, 200, 90), (-70, 0, 160, 70), (-78, 0, 120, 60), (-82, 0, 180, 160), (-88, 0, 230, 220), (-95, 0, 255, 255),
)
LAST_VISIBLE, VAPOUR_BANDS, RAMP_STEPS = 6, (8, 9, 10), 4096


def _unit(bands: tuple[int, ...], lo: float, hi: float, gamma: float) -> Column:
    """A band or the difference of two, stretched to 0..1 (low above high inverts), with gamma; null where a band is missing."""
    x = F.col(f"b{bands[0]}") - F.col(f"b{bands[1]}") if len(bands) == 2 else F.col(f"b{bands[0]}")
    t = F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo))))
    return t if gamma == 1 else F.pow(t, F.lit(1 / gamma))


def _byte(x: Column) -> Column:
    return F.when(x.isNotNull(), F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 255).cast("int"))


def rgb_composite(pixels: DataFrame, product: str) -> DataFrame:
    """Red, green, blue (0..255) of a composite from bands b1 .. b16; all null where a band that it reads is missing."""
    r, g, b = (_unit(*c) for c in COMPOSITES[product])
    if product == "truecolor":
        g = 0.45 * r + 0.45 * b + 0.1 * g
    whole = r.isNotNull() & g.isNotNull() & b.isNotNull()
    return pixels.withColumns({name: F.when(whole, _byte(c)) for name, c in (("red", r), ("green", g), ("blue", b))})


def geocolor_rgb(pixels: DataFrame, weight: Column) -> DataFrame:
    """True colour by day and infrared clouds over a navy earth by night, blended by the weight of day, per pixel."""
    r, veg, b = (_unit(*c) for c in COMPOSITES["truecolor"])
    day = (r, 0.45 * r + 0.45 * b + 0.1 * veg, b)
    cloud = F.when(F.col("b13").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (290 - F.col("b13")) / 70)))
    night = tuple((base + cloud * span) / 255 for base, span in ((6, 224), (14, 226), (38, 200)))
    w = F.when(F.col("b13").isNull(), 1.0).when(r.isNull(), 0.0).otherwise(F.coalesce(weight, F.lit(1.0)))
    seen = r.isNotNull() | b.isNotNull() | F.col("b13").isNotNull()
    mix = lambda d, n: _byte(F.coalesce(d, F.lit(0.0)) * w + F.coalesce(n, F.lit(0.0)) * (1 - w))
    return pixels.withColumns({name: F.when(seen, mix(F.when(r.isNotNull(), d), n)) for name, d, n in zip(("red", "green", "blue"), day, night, strict=True)})


def channel_rgb(pixels: DataFrame, band: int, enhance: bool = False) -> DataFrame:
    """Red, green, blue of one channel b<band>: reflectance as its square root in grey; temperature in grey, cold white, or by the
    enhancement of its kind, in 4096 steps."""
    v = F.col(f"b{band}")
    if band <= LAST_VISIBLE or not enhance:
        t = F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))) if band <= LAST_VISIBLE else (313 - v) / 130
        return pixels.withColumns(dict.fromkeys(("red", "green", "blue"), F.when(v.isNotNull(), _byte(t))))
    ramp = [(c + 273.15, rgb) for c, *rgb in (WV_RAMP if band in VAPOUR_BANDS else IR_RAMP)]
    warm, cold = ramp[0][0], ramp[-1][0]
    step = F.least(F.lit(RAMP_STEPS - 1), F.greatest(F.lit(0), F.floor((warm - v) * ((RAMP_STEPS - 1) / (warm - cold)))))
    k, out = warm - step / (RAMP_STEPS - 1) * (warm - cold), {}
    for at, name in enumerate(("red", "green", "blue")):
        e = F.when(k >= warm, F.lit(float(ramp[0][1][at])))
        for (a, ca), (b, cb) in zip(ramp, ramp[1:], strict=False):
            e = e.when(k >= b, ca[at] + (cb[at] - ca[at]) * (a - k) / (a - b))
        out[name] = F.when(v.isNotNull(), F.floor(e.otherwise(float(ramp[-1][1][at]))).cast("int"))
    return pixels.withColumns(out)


def colorize(df: DataFrame, value: str, stops: Sequence[tuple[float, tuple[int, int, int]]]) -> DataFrame:
    """Red, green, blue by linear interpolation between a palette's stops, flat beyond them."""
    v, out = F.col(value), {}
    for k, name in enumerate(("red", "green", "blue")):
        e = F.when(v <= stops[0][0], F.lit(float(stops[0][1][k])))
        for (a, ca), (b, cb) in zip(stops, stops[1:], strict=False):
            e = e.when(v <= b, ca[k] + (v - a) / (b - a) * (cb[k] - ca[k]))
        out[name] = F.when(v.isNotNull(), F.floor(e.otherwise(float(stops[-1][1][k])) + 0.5).cast("int"))
    return df.withColumns(out)


def swath_to_grid(footprints: DataFrame, step: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian splat of the footprints (scan, fov, lat, lon, value) of every granule (`by`) on a grid: weight exp(-2.3 d2 / r2), r = 0.72 x the wider gap
    to a neighbour of 1 to 9 cells, cells kept from a total weight of 0.10: (by..., i, j, value)."""
    gap = lambda w: F.greatest(*(F.coalesce(F.sqrt(F.pow(F.col("lat") - f("lat").over(w), 2) + F.pow((F.col("lon") - f("lon").over(w)) * F.cos(F.radians("lat")), 2)), F.lit(0.0)) for f in (F.lag, F.lead)))
    across, along = Window.partitionBy(*by, "scan").orderBy("fov"), Window.partitionBy(*by, "fov").orderBy("scan")
    f = staged(footprints.filter("value IS NOT NULL"), "footprints")
    rows, widest = (f.groupBy(*by).count() if by else f.agg(F.count("*").alias("count"))).agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    # a footprint makes dozens of rows; where no granule holds more than a task's, granules stay whole and only footprints are shuffled
    whole, most = bool(by) and (widest or 0) <= 50_000, 50_000
    f = dealt(f, rows, *by, *(() if whole else ("scan",)), per_task=most).withColumn("_gap", gap(across))
    f = (f if whole else dealt(f, rows, *by, "fov", per_task=most)).withColumn("_r", F.least(F.lit(9.0), F.greatest(F.lit(1.0), 0.72 * F.greatest("_gap", gap(along)) / step)))
    f = f.withColumns({"_x": F.col("lon") / step, "_y": F.col("lat") / step, "_k": F.cos(F.radians("lat"))})
    span = lambda c, r: F.sequence(F.ceil(F.col(c) - r).cast("int"), F.floor(F.col(c) + r).cast("int"))
    cells = f.withColumn("i", F.explode(span("_x", F.col("_r") / F.col("_k")))).withColumn("j", F.explode(span("_y", F.col("_r"))))
    d2 = F.pow((F.col("i") - F.col("_x")) * F.col("_k"), 2) + F.pow(F.col("j") - F.col("_y"), 2)
    w = F.exp(-2.3 * d2 / (F.col("_r") * F.col("_r")))
    near = cells.filter(d2 <= F.col("_r") * F.col("_r"))
    return near.groupBy(*by, "i", "j").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"), F.sum(w).alias("weight")).filter("weight >= 0.10").drop("weight")


def scene_bbox(scenes: DataFrame, lon: Formula, lat: Formula, n: int = 25) -> DataFrame:
    """(scene, west, south, east, north) of scenes (scene, x0, y0, x1, y1 in scan angles) from an n x n sample of navigated points; null off the disk.

    A scanner repeats its sectors, so each extent is navigated once, for all scenes that have it.
    """
    step, extent = F.sequence(F.lit(0), F.lit(n - 1)), ["x0", "y0", "x1", "y1"]
    pts = scenes.select(*extent).distinct().withColumn("_a", F.explode(step)).withColumn("_b", F.explode(step))
    pts = pts.select(*extent, (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("_a") / (n - 1)).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("_b") / (n - 1)).alias("y"))
    at = pts.select(*extent, lon("x", "y").alias("lon"), lat("x", "y").alias("lat"))
    boxes = at.groupBy(*extent).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    boxes = dimension(staged(boxes.withColumnsRenamed({c: f"_{c}" for c in extent}), "scene-extents"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in extent]
    return scenes.join(boxes, same).groupBy("scene").agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
