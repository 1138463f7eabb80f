"""Queries of the scalar functions: geodesy, physics and text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyframe.functions import geo as G
from skyframe.functions import reports as R
from skyframe.functions import weather as M

from skyframe.plans.base import ORACLES, QUERIES, Inputs, query, sql
from skyframe.sources.catalog import write_lake
from skyframe.sources.shared import shared_dir


def scalar(name: str, source: str, keys: str, digits: int = 6, **columns: str):
    """A query that computes expressions over a derived input, and the same expressions as SQL."""
    is_text = lambda e: e.startswith("@")  # noqa: E731  text, whole numbers and booleans are not rounded
    exprs = {k: e[1:] if is_text(e) else f"round(CAST({e} AS DOUBLE), {digits})" for k, e in columns.items()}
    body = f"SELECT {keys}, " + ", ".join(f"{e} AS {k}" for k, e in exprs.items()) + f" FROM [{source}] AS q"

    def run(spark, sf_dir):
        return Inputs(spark, sf_dir).d(source).select(*keys.split(", "), *(F.expr(e).alias(k) for k, e in exprs.items()))

    QUERIES[name], ORACLES[name] = run, sql(body)


P = ("lat", "lon", "39.1", "-94.6")
scalar("g1_g2_haversine_bearing", "place", "place", 4, dist_m=G.haversine.sql(*P), brg=G.bearing.sql("39.1", "-94.6", "lat", "lon"))
scalar("g3_destination", "place", "place", 6, lat2=G.destination_lat.sql("lat", "lon", "place % 360", "place * 100.0"), lon2=G.destination_lon.sql("lat", "lon", "place % 360", "place * 100.0"))
_C = ("38.0", "-97.0", "60.0")
scalar("g4_g5_storm_cone_ring", "place", "place", 5, **{f"{side}_{c}": getattr(G, f"destination_{c}").sql(G.destination_lat.sql("lat", "lon", "60.0", "50000.0"), G.destination_lon.sql("lat", "lon", "60.0", "50000.0"), b, G.cone_half_width.sql("50000.0")) for side, b in (("left", "-30.0"), ("right", "150.0")) for c in ("lat", "lon")})
scalar("g6_along_track", "place", "place", 3, along_m=G.along_track.sql(*_C, "lat", "lon"))
scalar("g8_beam_geometry", "gate", "sweep, azimuth, gate", 3, height_m=G.beam_height.sql("range_m", "0.5 + sweep"), ground_m=G.ground_distance.sql("range_m", "0.5 + sweep"), slant_m=G.slant_range.sql("range_m", "0.5 + sweep"))
_L = G.lambert(38.5, 38.5, -97.5, 38.5)
_L2 = G.lambert(30.0, 60.0, -96.0, 45.0)
scalar("g10_lambert_forward_inverse", "place", "place", 4, x=_L["x"].sql("lat", "lon"), y=_L["y"].sql("lat", "lon"), x2=_L2["x"].sql("lat", "lon"), lat_back=_L["lat"].sql(_L["x"].sql("lat", "lon"), _L["y"].sql("lat", "lon")), lon_back=_L["lon"].sql(_L["x"].sql("lat", "lon"), _L["y"].sql("lat", "lon")))
_S, _SY = G.fixed_grid(), G.fixed_grid(140.7, sweep="y")
scalar("g12_scan_to_lonlat", "cell", "i, j", 5, lon=_S["lon"].sql("(i - 32) * 0.004", "(j - 32) * 0.004"), lat=_S["lat"].sql("(i - 32) * 0.004", "(j - 32) * 0.004"), lat_y=_SY["lat"].sql("(i - 32) * 0.004", "(j - 32) * 0.004"))
scalar("g13_lonlat_to_scan", "place", "place", 8, sx=_S["x"].sql("lat", "lon"), sy=_S["y"].sql("lat", "lon"), x_y=_SY["x"].sql("lat", "lon + 240.0"), row_0=f"({_S['y'].sql('lat', 'lon')} - 0.12) / -0.000056")
scalar("g17_g18_grid_scale_mercator", "place", "place", 8, km=G.km_per_pixel.sql("0.000056 * (1 + place % 3)", "42164160.0", "6378137.0"), mx=G.merc_x.sql("lon"), my=G.merc_y.sql("lat"))
scalar("g19_m2_wind_dir_speed", "field", "i, j", 5, speed=G.wind_speed.sql("u", "v"), dir=G.wind_dir.sql("u", "v"), barb=f"CASE WHEN i % 3 = 0 AND j % 3 = 0 THEN {G.wind_speed.sql('u', 'v')} * 1.943844 END")
scalar("g20_subsolar_day_weight", "place", "place", 3, decl=G.declination.sql("1 + place % 365", "(place % 24) / 24e0"), sublon=G.subsolar_lon.sql("1 + place % 365", "(place % 24) / 24e0"), weight=G.day_weight.sql(G.sun_height.sql("lat", "lon", "1 + place % 365", "(place % 24) / 24e0")))
scalar("p1_p2_gate_codes", "gate", "sweep, azimuth, gate", 6, v=M.gate_value.sql("code", "2", "30"), v0=M.gate_value.sql("code", "0", "30"), back="@" + M.encode_gate.sql(M.gate_value.sql("code", "2", "30"), "2", "30", "255"))
scalar("p6_p7_display_floor", "cell", "i, j", 4, shown=M.to_display.sql("value", "0.0393701", "0.5"), data="@" + M.above_floor.sql("value", "100"))
scalar("p8_lon_range", "place", "place", near="@" + G.in_lon_range.sql("lon", "170", "-100"), inside="@" + G.in_lon_range.sql("lon", "-110", "-90"), wrapped="@" + G.wrap_lon.sql("lon + 360"))
scalar("p10_boxes_overlap", "place", "place", hit="@" + G.boxes_overlap.sql("lon", "lat", "lon + 2", "lat + 2", "-100", "30", "-90", "40"))
scalar("p11_crop_and_p12_p13_orientation", "cell", "i, j", 6, inside="@" + "i BETWEEN 10 AND 40 AND j BETWEEN 5 AND 60", north_row="@63 - j", lon=G.wrap_lon.sql("i * 5.625"), kept="@" + "abs(85.06 - j * 2.7) <= 85.06")
scalar("p15_p16_storm_satellite_box", "place", "place", 4, sat="@" + G.best_satellite.sql("CASE WHEN place % 3 = 0 THEN 'WP' ELSE 'AL' END", "lon * 1.5"), west=G.storm_west.sql("lon"), east=G.storm_east.sql("lon"), south=G.storm_south.sql("lat * 2 - 70"), north=G.storm_north.sql("lat * 2"))
scalar("p17_quantize", "cell", "i, j", 7, code="@" + M.quantize.sql("value", "0", "500"), v=M.dequantize.sql(M.quantize.sql("value", "0", "500"), "0e0", "500e0"))
scalar("m4_precip_type_rate", "field", "i, j", 5, ptype=M.precip_type_rate.sql("rh / 3600 - 0.005", "1", "i % 3 - 1", "i % 5 - 3", "j % 4 - 2"), phase="@" + M.precip_phase.sql(M.precip_type_rate.sql("rh / 3600 + 0.001", "1", "i % 3 - 1", "i % 5 - 3", "j % 4 - 2")))
scalar("m5_m6_m7_moisture", "field", "i, j", 5, td=M.dewpoint.sql("t", "rh"), rh2=M.relative_humidity.sql("t", M.dewpoint.sql("t", "rh")), tdc=M.dew_from_rh.sql("t - 273.15", "rh"))
scalar("m8_feels_like", "field", "i, j", 5, feels=M.feels_like.sql("t + 40", "rh", "u", "v"), cold=M.feels_like.sql("t", "rh", "u", "v"), from_td=M.feels_like_from_dewpoint.sql("t + 40", "t + 30", "u", "v"))
scalar("m9_m10_m11_lapse_lcl", "field", "i, j", 5, lapse=M.lapse_rate.sql("t", "t - 20", "5500 + u", "3000 + v * 200"), lcl=M.lcl_height.sql("cape", "1000"), lcl2=M.lcl_from_spread.sql("t", "t - 10"), cin=M.negate.sql("u"))
scalar("m12_m13_m14_composites", "field", "i, j", 6, ehi=M.ehi.sql("cape", "srh"), scp=M.scp.sql("cape", "srh", G.wind_speed.sql("u", "v")), stp=M.stp.sql("cape", "rh * 25", "srh", G.wind_speed.sql("u", "v"), "-n * 40"))
scalar("m16_kuchera_ratio", "field", "i, j", 6, ratio=M.kuchera_ratio.sql("t"), warm=M.kuchera_ratio.sql("greatest(t, t + 10, t - u)"))
scalar("m18_first_available_source", "field", "i, j", 6, first="coalesce(CASE WHEN i % 3 = 0 THEN t END, CASE WHEN i % 3 = 1 THEN rh END, u)")
scalar("m20_m21_guidance_exceedance", "field", "i, j", 6, ffg=M.guidance.sql("u", "rh / 50"), exceed=M.exceedance.sql("u", "rh / 50"))
scalar("m23_derived_radial_values", "gate", "sweep, azimuth, gate", 5, top="@" + M.echo_top.sql("code"), rain=M.hundredths_to_mm.sql("code"))
scalar("m25_microwave_values", "cell", "i, j", 4, bt="CASE WHEN value * 0.01 > -999 AND i % 7 <> 0 THEN value * 0.01 END")
scalar("m30_m32_tiers_steps", "cell", "i, j", 8, tier="@" + M.tier4.sql("value", "50", "150", "300"), step=M.nice_step.sql("value + 1"))
scalar("r1_r2_calibration", "cell", "i, j", 4, v=M.calibrate.sql("value", "0.02", "-3", "47"), bt=M.planck_temperature.sql("value - 60", "10803.3", "1392.74", "0.0755", "0.99975"))
scalar("r4_r5_satellite_rgb", "pixel", "row, col", ir="@" + M.ir_gray.sql("t13"), vis="@" + M.visible_gray.sql("(t13 - 190) / 90.0"), red="@" + M.stretch.sql("t15 - t13", "-4.0", "2.0", "1.0"), green="@" + M.stretch.sql("t13 - t8", "-15.0", "10.0", "1.2"), blue="@" + M.stretch.sql("t13", "243.0", "292.0", "1.0"), syn=M.synthetic_green.sql("t13 / 300", "t15 / 300", "t8 / 300"))
scalar("r7_auto_estimator", "pixel", "row, col", 4, rate=M.auto_estimator_rate.sql("t13"))
scalar("f8_compass", "place", "place", point="@" + G.compass.sql("place * 7.3 - 400"))
scalar("f16_f18_f20_categories", "place", "place", cat="@" + M.flight_category.sql("CASE WHEN place % 5 > 0 THEN (place % 70) / 10.0 END", "CASE WHEN place % 4 > 0 THEN place * 10 % 4000 END"), pcode="@" + M.pressure_code.sql("980 + place % 600 / 10.0"), storm="@" + M.storm_category.sql("place % 160"))
scalar("f17_f19_station_units", "place", "place", 5, tc=M.fahrenheit_to_c.sql("place % 120"), slp=M.sea_level_pressure.sql("CASE WHEN place % 2 = 0 THEN 1000 + place % 30 END", "29 + place % 100 / 100.0"), gust=M.gust.sql("CASE WHEN place % 3 = 0 THEN place % 50 END", "place % 70"), wave_m="(place % 30) * 0.3048")
scalar("f6_f15_place_and_age_text", "place", "place", coords="@" + R.coord_text.sql("lat", "lon"), age="@" + R.age_text.sql("place * 97"))
scalar("f3_magnitude_text", "report", "id", mag="@" + R.magnitude_text.sql("CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id % 10 AS VARCHAR(9)) END", "CASE WHEN id % 2 = 0 THEN CAST(n_chars AS VARCHAR(9)) END", "CASE WHEN id % 5 > 0 THEN 'INCH' ELSE '' END"))
_CASES = " ".join(f"WHEN regexp_matches(typetext, '{p}') THEN '{c}'" for p, c in R.CATEGORY_RULES)


@query("f1_f2_report_category_name", f"""SELECT id, CASE {_CASES} ELSE 'other' END AS category, CASE typetext WHEN 'TSTM WND DMG' THEN 'T-storm Wind Damage' WHEN 'NON-TSTM WND GST' THEN 'Non-t-storm Wind Gust'
WHEN 'TORNADO' THEN 'Tornado' WHEN 'FUNNEL CLOUD' THEN 'Funnel Cloud' WHEN 'HAIL' THEN 'Hail' WHEN 'HEAVY SNOW' THEN 'Heavy Snow' WHEN 'FLASH FLOOD' THEN 'Flash Flood' ELSE 'Lightning' END AS name FROM [report]""")
def _(x):
    return x.d("report").select("id", R.report_category(F.col("typetext")).alias("category"), R.report_type_name(F.col("typetext")).alias("name"))


@query("f4_report_id", "SELECT id, 'lsr:' || lower(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(source || chr(31) || id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda h, u: (xor(h, u) * 16777619) % 4294967296)::VARCHAR) AS rid FROM [report]")
def _(x):
    from pyspark.sql.functions import conv, regexp_replace

    rid = R.report_id([F.col("source"), F.col("id")])
    return x.d("report").select("id", F.concat(F.lit("lsr:"), conv(F.upper(regexp_replace(rid, "^lsr:", "")), 36, 10)).alias("rid"))


@query("f9_f10_f11_alert_class_motion", """SELECT id, CASE WHEN event = 'Tornado Warning' AND id % 4 = 0 THEN 'Tornado Emergency' WHEN event = 'Tornado Warning' AND id % 4 = 1 THEN 'PDS Tornado Warning'
WHEN event = 'Severe Thunderstorm Warning' AND id % 4 = 0 THEN 'Destructive Severe Thunderstorm Warning' WHEN event = 'Severe Thunderstorm Warning' AND id % 4 = 1 THEN 'Considerable Severe Thunderstorm Warning'
WHEN event = 'Flash Flood Warning' AND id % 4 = 0 THEN 'Flash Flood Emergency' WHEN id % 5 = 0 THEN 'EDS ' || event WHEN id % 5 = 1 THEN 'PDS ' || event ELSE event END AS display,
((id % 360) + 180) % 360 AS heading, floor((id % 60) * 1.151 + 0.5)::INT AS mph FROM [alert]""")
def _(x):
    m = F.col("id")
    level = lambda top: F.when(m % 4 == 0, top).when(m % 4 == 1, "considerable")
    said = F.when(m % 5 == 0, "This is an extremely dangerous situation").when(m % 5 == 1, "A PARTICULARLY DANGEROUS SITUATION exists").when(m % 5 == 2, "a tornado emergency was talked of").otherwise("")
    text = F.concat(F.lit("MOT "), (m % 360).cast("string"), F.lit("DEG AT "), (m % 60).cast("string"), F.lit("KT "), said)
    shown = R.classify_alert(F.col("event"), level("catastrophic"), level("destructive"), level("Catastrophic"), text)
    motion = R.parse_motion(text)
    return x.d("alert").select("id", shown.alias("display"), motion["heading"].cast("long").alias("heading"), motion["mph"].alias("mph"))


@query("t1_alert_order", f"""SELECT id, (CASE event {' '.join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(R.PRIORITY, 1))} ELSE {len(R.PRIORITY) + 1} END)::INT AS rank FROM [alert]""")
def _(x):
    return x.d("alert").select("id", R.alert_rank(F.col("event")).cast("int").alias("rank")).orderBy("rank", "id")


@query("a19_cloud_cover_ceiling", "SELECT place, (CASE WHEN place % 3 = 0 THEN 8 WHEN place % 3 = 1 THEN 6 ELSE 4 END)::INT AS oktas, CASE WHEN place % 3 = 0 THEN least(3000 + place % 900, 5000) WHEN place % 3 = 1 THEN 3000 + place % 900 END AS ceiling FROM [place]")
def _(x):
    layer = lambda cover, base: F.struct(F.lit(cover).alias("cover"), base.cast("long").alias("base"))
    low, top = 3000 + F.col("place") % 900, F.lit(5000)
    clouds = F.when(F.col("place") % 3 == 0, F.array(layer("few", F.lit(100)), layer("BKN", low), layer("OVC", top))).when(F.col("place") % 3 == 1, F.array(layer("sct", F.lit(900)), layer("bkn", low))).otherwise(F.array(layer("FEW", F.lit(200)), layer("SCT", low)))
    return x.d("place").select("place", R.max_cover(clouds).alias("oktas"), R.ceiling_ft(clouds).alias("ceiling"))


@query("f5_f7_details_names", "SELECT id, 'Buoy ' || source AS name, CASE WHEN id % 2 = 0 THEN source ELSE 'none' END AS detail FROM [report]")
def _(x):
    r = x.d("report").withColumn("sid", (41000 + F.col("id") % 1000).cast("string"))
    title = F.concat("sid", F.lit(" - Buoy "), "source", F.lit(" (LLNR 815)"))
    extra = R.extra_details(F.create_map(F.lit("gauge_source"), F.when(F.col("id") % 2 == 0, F.col("source")).otherwise(" "), F.lit("city"), F.col("sid")), ("city",))
    return r.select("id", R.catalog_name(title, F.col("sid")).alias("name"), F.coalesce(F.try_element_at(extra, F.lit("Gauge Source")), F.lit("none")).alias("detail"))


@query("f14_parse_mixed_time", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y%m%d%H%M') AS t FROM events")
def _(x):
    e = x.t("events")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMddHHmm")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", F.date_format(R.parse_mixed_time(text), "yyyyMMddHHmm").alias("t"))


@query("f12_parse_discussion", """SELECT id, (id % 2000)::INT AS number, 'area ' || source AS areas, CASE WHEN id % 3 > 0 THEN (id % 100)::INT END AS watch, '0245 PM CDT Sun Jul 12 2026' AS issued, 'Severe potential...Watch likely... soon' AS concerning,
'Severe potential' AS category, 'Watch likely · soon' AS watch_status, '121200Z - 121400Z' AS valid, 'Storms of ' || source || '.' || chr(10) || chr(10) || 'More follows.' AS body, CASE WHEN id % 2 = 0 THEN '60-70 MPH' END AS wind FROM [report]""")
def _(x):
    n = F.col("id")
    watch = F.when(n % 3 > 0, F.concat(F.lit("Probability of Watch Issuance... "), (n % 100).cast("string"), F.lit(" percent\n"))).otherwise("")
    end = F.when(n % 3 == 0, "\n   ..SMITH/JONES.. 07/12/2026\n").when(n % 3 == 1, "\n...Please see www for the graphic\n").otherwise("\n LAT...LON 3510 9720")
    text = F.concat(
        F.lit("Mesoscale Discussion "), (n % 2000).cast("string"), F.lit("\nNWS\n  0245 PM CDT Sun   Jul 12 2026\n\nAreas affected...area "), "source", F.lit("\n\nConcerning...Severe potential...Watch likely... soon\nValid 121200Z - 121400Z\n"), watch,
        F.lit("\nStorms of "), "source", F.lit(".\n\nMore follows.\n"), end, F.when(n % 2 == 0, "\nMOST PROBABLE PEAK WIND GUST...60-70  MPH\n").otherwise(""),
    )
    d = x.d("report").select("id", R.parse_discussion(text).alias("d"))
    return d.select("id", "d.number", "d.areas", F.col("d.watch_probability").alias("watch"), "d.issued", "d.concerning", "d.category", "d.watch_status", "d.valid", "d.body", F.col("d.peak_wind").alias("wind"))


@query("f11_impact_tags", "SELECT id, CASE WHEN id % 3 = 0 THEN 2 WHEN id % 3 = 1 THEN 1 ELSE 0 END AS n, CASE WHEN id % 3 < 2 THEN (id % 4)::VARCHAR || ' IN' END AS hail, CASE WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN false END AS strong FROM [alert]")
def _(x):
    m = F.col("id")
    hail = F.array((m % 4).cast("string"))
    params = F.when(m % 3 == 0, F.create_map(F.lit("maxHailSize"), hail, F.lit("tornadoDetection"), F.array(F.lit("observed")))).when(m % 3 == 1, F.create_map(F.lit("maxHailSize"), hail)).otherwise(F.create_map(F.lit("other"), hail))
    tags = R.impact_tags(params)
    one = F.try_element_at(F.filter(tags, lambda t: t["label"] == "MAX HAIL"), F.lit(1))["value"]
    strong = F.when(F.size(tags) > 0, F.exists(tags, lambda t: t["strong"]))
    return x.d("alert").select("id", F.size(tags).alias("n"), one.alias("hail"), strong.alias("strong"))


@query("f21_f22_f25_outlook_windows", """SELECT event_id, CASE WHEN event_id % 8 < 2 THEN 4 WHEN event_id % 8 = 2 THEN 2 ELSE 1 END AS n_types, strftime(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 36 HOUR, '%Y%m%d%H%M') AS a,
strftime(time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE, '%Y%m%d%H%M') AS b, strftime(date_trunc('hour', ts) + to_hours((event_id % 120)::INT), '%Y%m%d%H') AS valid FROM events""")
def _(x):
    e = x.t("events")
    w, f = R.alert_window(F.col("ts")), F.date_format
    return e.select("event_id", F.size(R.outlook_types(F.col("event_id") % 8 + 1)).alias("n_types"), f(w["start"], "yyyyMMddHHmm").alias("a"), f(w["end"], "yyyyMMddHHmm").alias("b"), f(R.valid_time(F.date_trunc("hour", "ts"), F.col("event_id") % 120), "yyyyMMddHH").alias("valid"))


@query("p18_filter_reports", "SELECT id FROM [report] WHERE typetext IN ('TORNADO', 'FUNNEL CLOUD', 'HAIL') AND id % 5 <> 0")
def _(x):
    r = x.d("report").withColumn("lon", F.when(F.col("id") % 5 != 0, F.col("id") * 1.0))
    return r.filter(R.shown_report(R.report_category(F.col("typetext")), F.col("lon"), F.col("id") * 1.0, ("tornado", "hail"))).select("id")


@query("c22_lake_round_trip", "SELECT kind AS source, count(*) AS n, count(DISTINCT station) AS stations FROM [obs] GROUP BY 1")
def _(x):
    """Writes the observations as a lake table in the shared folder and reads it back."""
    root = f"{shared_dir(x.spark)}/lake-{uuid.uuid4().hex}"
    obs = x.d("obs").withColumnRenamed("kind", "source").withColumn("day", F.to_date("time"))
    write_lake(obs, root, "obs", sort=("station", "time"))
    return x.spark.read.parquet(f"{root}/obs").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("station").alias("stations"))
