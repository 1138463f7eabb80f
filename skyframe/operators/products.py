"""Catalogues of gridded products: what fields they read and the Column rule over them.

Fields are long rows (run, hour, i, j, var, level, acc, value), acc being the accumulation text of an index, as in
"0-6 hour acc fcst". All fields that some products read are laid side by side in one grouping; a field of an earlier
hour is counted to the hour that asks for it, so there is no join. Missing is null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions import geo, weather


@dataclass(frozen=True)
class Field:
    """A (variable, level). `total`: accumulated since the run began; `bucket`: over so many hours up to now; `back`: so many hours earlier."""

    var: str
    level: str
    total: bool = False
    bucket: int = 0
    back: int = 0


@dataclass(frozen=True)
class ByHour:
    """K1: a source that depends on the forecast hour: (first hour, last hour or None for no end, field), ranges apart from each other."""

    ranges: tuple[tuple[int, int | None, Field], ...]


Source = Field | ByHour


def by_hour(*ranges: tuple[int, int | None, tuple | Field]) -> ByHour:
    """K1: by_hour((0, 36, ("APCP", "surface")), (37, None, ("TP", "surface")))."""
    return ByHour(tuple((lo, hi, f if isinstance(f, Field) else Field(*f)) for lo, hi, f in ranges))


def _ranges(source: Source) -> tuple[tuple[int, int | None, Field], ...]:
    return source.ranges if isinstance(source, ByHour) else ((0, None, source),)


def _changed(source: Source, change: Callable[[Field], Field]) -> Source:
    """The source with each of its fields changed."""
    return ByHour(tuple((lo, hi, change(f)) for lo, hi, f in source.ranges)) if isinstance(source, ByHour) else change(source)


@dataclass(frozen=True)
class Product:
    """The rule gets the names of the fields' columns, in order; there is a value where the `needed` fields (all, or these places)
    have one. With a `window` the last field is a total: the rule gets what of it
    fell in the last `window` hours, or since the run began. Before `min_hour` there are no values."""

    id: str
    fields: tuple[Source, ...]
    rule: Callable[..., Column]
    scale: float = 1.0
    window: int = 0
    min_hour: int = 0
    needed: tuple[int, ...] | None = None


Catalogue = Mapping[str, Product]


def _first(column: str, *_: str) -> Column:
    return F.col(column)


def make_product(id: str, fields: Sequence[tuple | Source], rule: Callable[..., Column] = _first, **how) -> Product:
    """K1: a product of the user's own; without a rule it is the first field (M1)."""
    return Product(id, tuple(f if isinstance(f, Source) else Field(*f) for f in fields), rule, **how)


def with_product(catalogue: Catalogue, id: str, fields: Sequence[tuple | Source], rule: Callable[..., Column] = _first, **how) -> Catalogue:
    """K1: the catalogue and one more product; the catalogue given stays as it is."""
    return {**catalogue, id: make_product(id, fields, rule, **how)}


def product_for_model(model: str | None, id: str, catalogue: Catalogue, overrides: Mapping[tuple[str, str], dict] | None = None) -> Product:
    """The product as a model has it: its overrides of sources and rule, and its own names of levels."""
    held = OVERRIDES if overrides is None else overrides
    p = replace(catalogue[id], **held.get((model, id), {}))
    names = LEVEL_NAMES.get(model, {})
    return replace(p, fields=tuple(_changed(s, lambda f: replace(f, level=names.get(f.var, f.level))) for s in p.fields))


def model_products(model: str, order: Sequence[str] | None = None) -> list[str]:
    """Products a model offers in display order; a model without a list of its own offers all."""
    only = SUPPORT.get(model)
    return [i for i in (order or MODEL) if only is None or i in only]


def default_product(model: str) -> str:
    """Composite reflectivity if the model has it, else its first product."""
    offered = model_products(model)
    return "REFC" if "REFC" in offered or not offered else offered[0]


def offered(runs: DataFrame, model: str) -> DataFrame:
    """Runs with a row for each product of their model: product, its position in display order from 1, and the model's first choice."""
    models = [m for m in SUPPORT]
    lists = F.create_map(*(c for m in models for c in (F.lit(m), F.array(*map(F.lit, model_products(m))))))
    firsts = F.create_map(*(c for m in models for c in (F.lit(m), F.lit(default_product(m)))))
    every = F.array(*map(F.lit, model_products("")))
    held = runs.withColumn("_p", F.coalesce(F.try_element_at(lists, F.col(model)), every)).withColumn("first", F.coalesce(F.try_element_at(firsts, F.col(model)), F.lit(default_product(""))))
    return held.select(*runs.columns, F.posexplode("_p").alias("_at", "product"), "first").withColumn("position", F.col("_at") + 1).drop("_at")


def products(cells: DataFrame, ids: Sequence[str], catalogue: Catalogue | None = None, by: Sequence[str] = ("run", "hour", "i", "j"), hour: str = "hour", model: str | None = None, overrides: Mapping[tuple[str, str], dict] | None = None) -> DataFrame:
    """(id, by..., value) of products from cells (by..., var, level, value and, for totals, acc). Missing values are left out.

    One grouping for all products: a cell is looked up in a table of the fields that some product reads, by its variable and
    level, and goes to the places that ask for it at its hour. `hour`, one of `by`, is the forecast hour; tables without it
    can have no windows and take sources that depend on the hour at hour 0. Cells without a column acc are taken to match
    every accumulation.
    """
    return products_of_models(cells, {model: ids}, catalogue, by, hour, overrides).drop("model")


def products_of_models(cells: DataFrame, ids: Mapping[str | None, Sequence[str]], catalogue: Catalogue | None = None, by: Sequence[str] = ("run", "hour", "i", "j"), hour: str = "hour", overrides: Mapping[tuple[str, str], dict] | None = None) -> DataFrame:
    """(model, id, by..., value) of each model's products, as `products`, from the same cells in one grouping; what models share is worked out once."""
    held: dict[Product, list[str | None]] = {}
    for model, of in ids.items():
        for i in of:
            held.setdefault(product_for_model(model, i, MODEL if catalogue is None else catalogue, overrides), []).append(model)
    wanted = list(held)
    earlier = lambda p: _changed(p.fields[-1], lambda f: replace(f, back=p.window))
    fields = list(dict.fromkeys(f for p in wanted for f in (*p.fields, *((earlier(p),) if p.window else ()))))
    timed, acc = hour in cells.columns, "acc" in cells.columns

    entries = [(f.var, f.level, k, f.back, f.total, f.bucket, lo, hi) for k, source in enumerate(fields) for lo, hi, f in _ranges(source)]
    kind = "array<struct<var: string, level: string, k: int, back: int, total: boolean, bucket: int, lo: int, hi: int>>"
    names = [n.split(":")[0] for n in kind[13:-2].split(", ")]
    literal = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, e, strict=True))) for e in entries)).cast(kind)
    lookup = cells.sparkSession.range(1).select(F.explode(literal).alias("hit"))  # a row for each field of a catalogue
    lookup = lookup.select("hit", F.col("hit.var").alias("_var"), F.col("hit.level").alias("_level"))
    rows = cells.join(F.broadcast(lookup), (F.col("var") == F.col("_var")) & (F.col("level") == F.col("_level")))
    if acc:
        now = F.col(hour).cast("int") if timed else F.lit(0)
        bucket = F.concat((now - F.col("hit.bucket")).cast("string"), F.lit("-"), now.cast("string"), F.lit(" hour acc"))
        rows = rows.filter((~F.col("hit.total") | F.col("acc").startswith("0-")) & ((F.col("hit.bucket") == 0) | F.col("acc").startswith(bucket)))
    asked = F.col(hour) + F.col("hit.back") if timed else F.lit(0)
    if any(isinstance(f, ByHour) for f in fields):
        rows = rows.filter((asked >= F.col("hit.lo")) & (F.col("hit.hi").isNull() | (asked <= F.col("hit.hi"))))
    rows = rows.select(*by, "value", "hit")
    if timed:
        rows = rows.withColumn(hour, asked)
    wide = rows.groupBy(*by).agg(*(F.max(F.when(F.col("hit.k") == k, F.col("value"))).alias(f"_f{k}") for k in range(len(fields))))
    name = {f: f"_f{k}" for k, f in enumerate(fields)}
    values, out = [], []
    for k, p in enumerate(wanted):
        args = [name[f] for f in p.fields]
        if p.window:
            now, then = F.col(args[-1]), F.col(name[earlier(p)])
            fell = F.when(F.col(hour) <= p.window, now).when(now.isNotNull() & then.isNotNull(), F.greatest(now - then, F.lit(0.0)))
            wide, args[-1] = wide.withColumn(f"_w{k}", fell), f"_w{k}"
        value = p.rule(*args) * p.scale
        for at in range(len(args)) if p.needed is None else p.needed:
            value = F.when(F.col(args[at]).isNotNull(), value)
        if p.min_hour and timed:
            value = F.when(F.col(hour) >= p.min_hour, value)
        values.append(value.cast("double").alias(f"_v{k}"))
        out += [F.struct(F.lit(m).cast("string").alias("model"), F.lit(p.id).alias("id"), F.col(f"_v{k}").alias("value")) for m in held[p]]
    return wide.select(*by, *values).select(*by, F.explode(F.array(*out)).alias("x")).select("x.model", "x.id", *by, "x.value").filter("value IS NOT NULL")


def product(cells: DataFrame, id: str, by: Sequence[str] = ("run", "hour", "i", "j"), model: str | None = None, catalogue: Catalogue | None = None, overrides: Mapping[tuple[str, str], dict] | None = None) -> DataFrame:
    """One product as (by..., value)."""
    return products(cells, [id], catalogue, by, model=model, overrides=overrides).drop("id")


#: Heights between height contours by level (hPa), and pressure (Pa) between isobars.
MSLP_STEP = 400
MSLP_SOURCES = tuple((v, level) for level in ("mean sea level", "surface") for v in ("PRMSL", "MSLMA", "MSLET", "PRES"))


def height_step(level_hpa: int) -> int:
    """Interval of height contours (m) on a pressure level."""
    return 120 if level_hpa <= 300 else 60 if level_hpa <= 500 else 30


def overlay_fields(cells: DataFrame, level_hpa: int, by: Sequence[str] = ("run", "hour", "i", "j")) -> DataFrame:
    """(by..., u, v, speed, hgt, mslp_hpa) that lie over a product: wind and height of a level, and pressure from the first field that has it."""
    level = f"{level_hpa} mb"
    one = lambda var, lv: F.max(F.when((F.col("var") == var) & (F.col("level") == lv), F.col("value")))
    wanted = F.struct("var", "level").isin(*(F.struct(F.lit(v), F.lit(lv)) for v, lv in (*((v, level) for v in ("UGRD", "VGRD", "HGT")), *MSLP_SOURCES)))
    wide = cells.filter(wanted).groupBy(*by).agg(one("UGRD", level).alias("u"), one("VGRD", level).alias("v"), one("HGT", level).alias("hgt"), *(one(*s).alias(f"_p{k}") for k, s in enumerate(MSLP_SOURCES)))
    return wide.select(*by, "u", "v", geo.wind_speed("u", "v").alias("speed"), "hgt", (first_available(*(f"_p{k}" for k in range(len(MSLP_SOURCES)))) / 100).alias("mslp_hpa"))


def first_available(*sources: str | Column) -> Column:
    """The first source that has a value."""
    return F.coalesce(*sources)


def snow_10_to_1(water: str) -> Column:
    """Snow (mm) at ten times its water."""
    return F.greatest(F.col(water), F.lit(0.0)) * 10


def snow_kuchera(t2m: str, t925: str, t850: str, t700: str, water: str) -> Column:
    """Snow (mm) by the warmest of the four temperatures; 10 to 1 without any."""
    return F.greatest(F.col(water), F.lit(0.0)) * weather.kuchera_ratio(f"greatest({t2m}, {t925}, {t850}, {t700})")


def significant_tornado(cape: str, lcl: str, ground: str, srh: str, u: str, v: str, cin: str) -> Column:
    return weather.stp(cape, f"{lcl} - {ground}", srh, geo.wind_speed.sql(u, v), cin)


def supercell(cape: str, srh: str, u: str, v: str) -> Column:
    return weather.scp(cape, srh, geo.wind_speed.sql(u, v))


_2M, _10M, _SFC, _ALL, _ML, _MU = "2 m above ground", "10 m above ground", "surface", "entire atmosphere", "90-0 mb above ground", "255-0 mb above ground"
_LCL, _SRH1, _SRH3, _SH1, _SH6 = "level of adiabatic condensation from sfc", "1000-0 m above ground", "3000-0 m above ground", "0-1000 m above ground", "0-6000 m above ground"
_TOTAL, _SNOW = Field("APCP", _SFC, total=True), Field("WEASD", _SFC, total=True)
_TEMPS = (Field("TMP", _2M), *(Field("TMP", f"{p} mb") for p in (925, 850, 700)))
_uv = lambda level: [("UGRD", level), ("VGRD", level)]
_shear = lambda level: [("VUCSH", level), ("VVCSH", level)]


def _snow(id: str, hours: int = 0, kuchera: bool = False, water: Field = _SNOW) -> Product:
    return make_product(id, [*_TEMPS, water] if kuchera else [water], snow_kuchera if kuchera else snow_10_to_1, window=hours, needed=(4,) if kuchera else None)


def _snows(water: Field) -> list[Product]:
    return [_snow(f"{name}{hours or 'T'}", hours, name == "KUCH", water) for name in ("SNOW", "KUCH") for hours in (6, 12, 24, 0)]


#: Model products in display order.
MODEL: Catalogue = {p.id: p for p in (
    make_product("REFC", [("REFC", _ALL)]),
    make_product("PTYPE", [(v, _SFC) for v in ("PRATE", "CRAIN", "CFRZR", "CICEP", "CSNOW")], weather.precip_type_rate, needed=(0,)),
    make_product("TMP", [("TMP", _2M)]),
    make_product("FEELS", [("TMP", _2M), ("RH", _2M), *_uv(_10M)], weather.feels_like, needed=(0,)),
    make_product("WIND", _uv(_10M), geo.wind_speed),
    make_product("GUST", [("GUST", _SFC)]),
    make_product("RH", [("RH", _2M)]),
    make_product("DPT", [("TMP", _2M), ("RH", _2M)], weather.dewpoint),
    make_product("TCDC", [("TCDC", _ALL)]),
    make_product("QPF1", [Field("APCP", _SFC, bucket=1)], min_hour=1),
    make_product("QPF6", [_TOTAL], window=6),
    make_product("QPF24", [_TOTAL], window=24),
    make_product("QPF", [_TOTAL]),
    *(make_product(f"W{p}", _uv(f"{p} mb"), geo.wind_speed) for p in (200, 300, 500, 700, 850, 925)),
    *(make_product(f"VORT{p}", [("ABSV", f"{p} mb")]) for p in (850, 700, 500)),
    *(make_product(f"TMP{p}", [("TMP", f"{p} mb")]) for p in (925, 850, 700, 500)),
    make_product("SBCAPE", [("CAPE", _SFC)]),
    make_product("MLCAPE", [("CAPE", _ML)]),
    make_product("MUCAPE", [("CAPE", _MU)]),
    make_product("CAPE3", [("CAPE", "0-3000 m above ground")]),
    make_product("SBCIN", [("CIN", _SFC)], weather.negate),
    make_product("MLCIN", [("CIN", _ML)], weather.negate),
    make_product("LAPSE", [("TMP", "700 mb"), ("TMP", "500 mb"), ("HGT", "500 mb"), ("HGT", "700 mb")], weather.lapse_rate),
    make_product("LCL", [("HGT", _LCL), ("HGT", _SFC)], weather.lcl_height),
    make_product("SRH1", [("HLCY", _SRH1)]),
    make_product("SRH3", [("HLCY", _SRH3)]),
    make_product("SHEAR1", _shear(_SH1), geo.wind_speed),
    make_product("SHEAR6", _shear(_SH6), geo.wind_speed),
    make_product("STORM", [("USTM", _SH6), ("VSTM", _SH6)], geo.wind_speed),
    make_product("STP", [("CAPE", _SFC), ("HGT", _LCL), ("HGT", _SFC), ("HLCY", _SRH1), *_shear(_SH6), ("CIN", _SFC)], significant_tornado),
    make_product("SCP", [("CAPE", _MU), ("HLCY", _SRH3), *_shear(_SH6)], supercell),
    make_product("EHI1", [("CAPE", _ML), ("HLCY", _SRH1)], weather.ehi),
    make_product("EHI3", [("CAPE", _ML), ("HLCY", _SRH3)], weather.ehi),
    make_product("LTNG", [("LTNG", _ALL)]),
    *_snows(_SNOW),
    make_product("ICET", [Field("FROZR", _SFC, total=True)]),
    make_product("FZRA", [Field("FRZR", _SFC, total=True)]),
)}

# Groups of products that models lack or have as a whole.
_WINDS = [f"W{p}" for p in (200, 300, 500, 700, 850, 925)]
_AIR = [*_WINDS, *(f"TMP{p}" for p in (925, 850, 700, 500))]
_VORT = ["VORT850", "VORT700", "VORT500"]
_SNOWS = [p.id for p in _snows(_SNOW)]
_QPF = ["QPF6", "QPF24", "QPF"]
_BASE = ["TMP", "FEELS", "WIND", "DPT", "TCDC"]
_GROUND = ["REFC", "PTYPE", *_BASE, "GUST", "RH"]
_STORMS = ["SRH1", "SRH3", "SHEAR6", "STORM", "SCP", "EHI1", "EHI3", "LTNG"]
_ECMWF = [*_BASE, *_QPF, *_AIR, *_SNOWS]
_HURRICANE = [*_GROUND, *_AIR, *_VORT, "SBCAPE", "SBCIN", "SRH3"]
#: Products of each model.
SUPPORT: dict[str, frozenset[str]] = {model: frozenset(only) for model, only in {
    "nam": [*_GROUND, *_QPF, *_AIR, *_VORT, "SBCAPE", "SBCIN", "LAPSE", "SRH3", "SHEAR6", "LTNG", *_SNOWS],
    "namnest": [*_GROUND, *_AIR, *_VORT, "SBCAPE", "MLCAPE", "MUCAPE", "SBCIN", "MLCIN", "LAPSE", "LCL", *_STORMS, "STP"],
    "rap": [*_GROUND, "QPF1", *_QPF, *_AIR, "VORT500", "SBCAPE", "MLCAPE", "MUCAPE", "CAPE3", "SBCIN", "MLCIN", "LAPSE", *_STORMS, *_SNOWS, "ICET", "FZRA"],
    "gfs": [*_GROUND, *_QPF, *_AIR, *_VORT, "SBCAPE", "MLCAPE", "MUCAPE", "SBCIN", "MLCIN", "LAPSE", "SRH3", "STORM", "EHI3", *_SNOWS],
    "hrrrcast": [*_BASE, "REFC", "GUST", "RH", *_AIR, "SBCAPE", "SBCIN", "LAPSE", "SRH1", "SRH3", "STORM"],
    "ecmwf": [*_ECMWF, "GUST", "MUCAPE"], "ecmwfens": [*_ECMWF, "GUST", "MUCAPE"], "aifs": _ECMWF, "aifsens": _ECMWF,
    "gefsens": [*_BASE, "PTYPE", "GUST", "RH", "QPF6", *_AIR, "SBCAPE", "MLCAPE", "SBCIN", "MLCIN", "SRH3", *_SNOWS],
    "aigfs": _AIR, "aigefsens": _AIR, "hgefs": _AIR,
    "hfsa": _HURRICANE, "hfsaparent": _HURRICANE, "hfsb": _HURRICANE, "hfsbparent": _HURRICANE,
}.items()}
#: Levels that a model names otherwise, by (model, variable).
LEVEL_NAMES: dict[str | None, dict[str, str]] = {m: {"LTNG": _SFC} for m in ("nam", "namnest", "rap")}

_DPT = (Field("DPT", _2M),)
_DEWPOINT = {"DPT": {"fields": _DPT, "rule": _first}}
_FROM_DEWPOINT = {**_DEWPOINT, "FEELS": {"fields": (Field("TMP", _2M), *_DPT, *(Field(*f) for f in _uv(_10M))), "rule": weather.feels_like_from_dewpoint}}
_SNAPSHOTS = {p.id: {"fields": p.fields} for p in _snows(Field("WEASD", _SFC))}
_GEFS = {
    **_DEWPOINT, **_SNAPSHOTS, "QPF6": {"fields": (Field("APCP", _SFC, bucket=6),), "window": 0, "min_hour": 6}, "TCDC": {"min_hour": 3},
    "MLCAPE": {"fields": (Field("CAPE", "180-0 mb above ground"),)}, "MLCIN": {"fields": (Field("CIN", "180-0 mb above ground"),)},
}
#: Replaced attributes by (model, product).
OVERRIDES: Mapping[tuple[str | None, str], dict] = {
    (model, id): how
    for models, held in ((("ecmwf", "aifs", "ecmwfens", "aifsens"), _FROM_DEWPOINT), (("gfs",), _SNAPSHOTS), (("gefsens",), _GEFS))
    for model in models
    for id, how in held.items()
}

MOSAIC_LEVEL = "0 m above mean sea level"
# Mosaic products and the archive folders that hold them, in display order.
MOSAIC_FOLDERS = {
    "REFC": "MergedReflectivityQCComposite_00.50", "LLREF": "LowLevelCompositeReflectivity_00.50",
    "RALA": "MergedReflectivityAtLowestAltitude_00.50", "REF0C": "Reflectivity_0C_00.50", "REFM20C": "Reflectivity_-20C_00.50",
    "AZSHEAR": "MergedAzShear_0-2kmAGL_00.50", "AZSHEAR36": "MergedAzShear_3-6kmAGL_00.50", "ROT1H": "RotationTrack60min_00.50",
    "ROT6H": "RotationTrack360min_00.50", "ROT24H": "RotationTrack1440min_00.50", "ROTML1H": "RotationTrackML60min_00.50",
    "ROTML6H": "RotationTrackML360min_00.50", "ROTML24H": "RotationTrackML1440min_00.50", "MESH": "MESH_00.50",
    "MESH1H": "MESH_Max_60min_00.50", "MESH6H": "MESH_Max_360min_00.50", "MESH24H": "MESH_Max_1440min_00.50", "POSH": "POSH_00.50",
    "SHI": "SHI_00.50", "LTG30": "LightningProbabilityNext30minGrid_scale_1", "LTG60": "LightningProbabilityNext60minGrid_scale_1",
    "CGD1": "NLDN_CG_001min_AvgDensity_00.00", "CGD5": "NLDN_CG_005min_AvgDensity_00.00", "CGD15": "NLDN_CG_015min_AvgDensity_00.00",
    "CGD30": "NLDN_CG_030min_AvgDensity_00.00", "PRATE": "PrecipRate_00.00", "QPE1H": "MultiSensor_QPE_01H_Pass2_00.00",
    "QPE3H": "MultiSensor_QPE_03H_Pass2_00.00", "QPE6H": "MultiSensor_QPE_06H_Pass2_00.00", "QPE12H": "MultiSensor_QPE_12H_Pass2_00.00",
    "QPE24H": "MultiSensor_QPE_24H_Pass2_00.00", "QPE48H": "MultiSensor_QPE_48H_Pass2_00.00", "QPE72H": "MultiSensor_QPE_72H_Pass2_00.00",
    "QPEST": "RadarOnly_QPE_Since12Z_00.00", "ARI1H": "FLASH_QPE_ARI01H_00.00", "ARI3H": "FLASH_QPE_ARI03H_00.00",
    "ARI6H": "FLASH_QPE_ARI06H_00.00", "ARI24H": "FLASH_QPE_ARI24H_00.00", "ARIMAX": "FLASH_QPE_ARIMAX_00.00",
    "FFG1H": "FLASH_QPE_FFG01H_00.00", "FFG3H": "FLASH_QPE_FFG03H_00.00", "FFG6H": "FLASH_QPE_FFG06H_00.00",
    "FFGMAX": "FLASH_QPE_FFGMAX_00.00", "ET18": "EchoTop_18_00.50", "ET30": "EchoTop_30_00.50", "ET50": "EchoTop_50_00.50",
    "ET60": "EchoTop_60_00.50", "VIL": "VIL_00.50", "VILD": "VIL_Density_00.50", "VIL2H": "VIL_Max_120min_00.50",
    "VIL24H": "VIL_Max_1440min_00.50", "VII": "VII_00.50",
}
#: Mosaic products; ratios of rain to guidance are stored in hundredths, exceedance is worked out from rain and its ratio.
_EXCEEDANCE = {
    f"FFGX{h}": make_product(f"FFGX{h}", [(f"RadarOnly_QPE_{h:02}H_00.00", MOSAIC_LEVEL), (f"FLASH_QPE_FFG{h:02}H_00.00", MOSAIC_LEVEL)], lambda rain, ratio: weather.exceedance(rain, f"{ratio} * 0.01"))
    for h in (1, 3, 6)
}
_STORED = {id: make_product(id, [(folder, MOSAIC_LEVEL)], scale=0.01 if id.startswith("FFG") else 1.0) for id, folder in MOSAIC_FOLDERS.items()}
#: Exceedance stands between the sums of rain and what else tells of floods.
MOSAIC: Catalogue = {key: product for id, own in _STORED.items() for key, product in ({**_EXCEEDANCE, id: own} if id == "ARI1H" else {id: own}).items()}
#: Surface analysis.
ANALYSIS: Catalogue = {p.id: p for p in (
    make_product("TMP", [("TMP", _2M)]), make_product("DPT", [("DPT", _2M)]), make_product("RH", [("TMP", _2M), ("DPT", _2M)], weather.relative_humidity), make_product("TCDC", [("TCDC", _ALL)]),
    make_product("WIND", [("WIND", _10M)]), make_product("GUST", [("GUST", _10M)]), make_product("VIS", [("VIS", _SFC)]),
)}
#: Microwave products; brightness temperatures by channel.
MICROWAVE: Catalogue = {
    **{id: make_product(id, [("BT", f"channel {c}")]) for id, c in (("BT89", 15), ("BT183", 21))},
    **{id: make_product(id, [(var, _SFC)]) for id, var in (("RR", "RR"), ("TPW", "TPW"), ("CLW", "CLW"), ("IWP", "IWP"), ("SFR", "SFR"), ("SWE", "SWE"), ("SICE", "SIce"), ("TSKIN", "TSkin"))},
}
