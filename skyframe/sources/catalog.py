"""Archive catalogues: keys, listings, indexes, calendars, and the library's text sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.operators.joins import dimension

# The time in the object keys of each source: pattern, format, seconds a frame adds.
GRAMMARS = {
    "volume": (r"(\d{8}_\d{6})", "yyyyMMdd_HHmmss"), "mosaic": (r"_(\d{8}-\d{6})\.", "yyyyMMdd-HHmmss"), "level3": (r"_(\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2})", "yyyy_MM_dd_HH_mm_ss"),
    "scene": (r"_s(\d{13})", "yyyyDDDHHmmss"), "swath": (r"_s(\d{14})", "yyyyMMddHHmmss"),
}


def key_time(key: Column, grammar: str) -> Column:
    """UTC time in an object key by one of seven grammars; null if it has none."""
    none = lambda c: F.when(c != "", c)
    at = lambda c, f: F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz")
    if grammar == "analysis":
        return at(F.concat(none(F.regexp_extract(key, r"rtma2p5_ru\.(\d{8})/", 1)), none(F.regexp_extract(key, r"t(\d{4})z", 1))), "yyyyMMddHHmm")
    if grammar == "himawari":
        frame = none(F.regexp_extract(key, r":(\d+)$", 1)).cast("int")
        start = at(none(F.regexp_extract(key, r"HIMAWARI:[^:]*:(\d{12}):", 1)), "yyyyMMddHHmm")
        return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((frame - 1) * 150).cast("decimal(18,6)"))
    pattern, form = GRAMMARS[grammar]
    text = none(F.regexp_extract(key, pattern, 1))
    if grammar == "scene":
        day = F.date_add(F.make_date(F.substring(text, 1, 4).cast("int"), F.lit(1), F.lit(1)), F.substring(text, 5, 3).cast("int") - 1)
        return at(F.concat(F.date_format(day, "yyyyMMdd"), F.substring(text, 8, 6)), "yyyyMMddHHmmss")
    return at(text, form)


def list_volumes(keys: DataFrame, site: str, day: str) -> DataFrame:
    """Volume keys of a site and day (yyyy/MM/dd), metadata and numbered parts left out, in order."""
    return keys.filter(F.col("key").startswith(f"{day}/{site}/") & ~F.col("key").endswith("_MDM") & ~F.col("key").rlike(r"\.\d+$")).orderBy("key")


def recent_scenes(keys: DataFrame, by: str, time: str, at: Column, max_back: int = 3, want: int = 6) -> DataFrame:
    """Back hour by hour, at most 3, until there are 6 keys; distinct, in order of time."""
    hour = F.floor((F.unix_timestamp(F.date_trunc("hour", at)) - F.unix_timestamp(F.date_trunc("hour", time))) / 3600)
    k = keys.dropDuplicates([by, "key"]).withColumn("_back", hour).filter(F.col("_back").between(0, max_back))
    newer = F.count("*").over(Window.partitionBy(by).orderBy("_back").rangeBetween(Window.unboundedPreceding, -1))
    return k.withColumn("_newer", newer).filter(F.col("_newer") < want).drop("_back", "_newer")


def archive_key(name: Column) -> Column:
    """SITEyyyymmdd_hhmmss as an archive key; _V08 for sites that start with T, else _V06."""
    p = r"^([A-Z]{4})(\d{4})(\d{2})(\d{2})_(\d{6})"
    g = lambda k: F.regexp_extract(name, p, k)
    return F.when(name.rlike(p), F.concat(g(2), F.lit("/"), g(3), F.lit("/"), g(4), F.lit("/"), g(1), F.lit("/"), g(1), g(2), g(3), g(4), F.lit("_"), g(5), F.when(g(1).startswith("T"), "_V08").otherwise("_V06")))


def parse_idx(lines: DataFrame, file: str = "file") -> DataFrame:
    """Index lines rec:offset:date:var:level:acc (rec may be rec.sub, from 0); a record ends before the next different offset."""
    c = F.split("value", ":")
    rec = F.split(c[0], r"\.")
    out = lines.filter(F.size(c) >= 6).select(file, F.try_element_at(rec, F.lit(1)).cast("int").alias("rec"), F.coalesce(F.try_element_at(rec, F.lit(2)).cast("int") - 1, F.lit(0)).alias("sub"), c[1].cast("long").alias("start"), F.regexp_replace(c[2], "^d=", "").alias("run"), c[3].alias("var"), norm_level(c[4]).alias("level"), c[5].alias("acc"))
    later = F.min("start").over(Window.partitionBy(file).orderBy("start").rangeBetween(1, Window.unboundedFollowing))
    return out.withColumn("end", later - 1)


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """C9 as a source: one file per run and hour."""
    return parse_idx(spark.read.text(path).withColumn("file", F.input_file_name()))


def norm_level(level: Column) -> Column:
    """Without the single-layer note, and the ends of 'a-b unit' in order."""
    bare = F.trim(F.replace(level, F.lit("(considered as a single layer)"), F.lit("")))
    p = r"^(-?\d+(?:\.\d+)?)-(-?\d+(?:\.\d+)?) (.*)$"
    a, b, unit = (F.regexp_extract(bare, p, k) for k in (1, 2, 3))
    first = a.try_cast("double") <= b.try_cast("double")
    return F.when(bare.rlike(p), F.concat(F.when(first, a).otherwise(b), F.lit("-"), F.when(first, b).otherwise(a), F.lit(" "), unit)).otherwise(bare)


def select_field(idx: DataFrame, var: str, level: str, acc: str | None = None, file: str = "file") -> DataFrame:
    """C11: the first record per file of a variable and level, of an accumulation that matches a pattern if one is given."""
    f = idx.filter((F.col("var") == var) & (F.col("level") == level) & (F.col("acc").rlike(acc) if acc else F.lit(True)))
    return f.withColumn("_r", F.row_number().over(Window.partitionBy(file).orderBy("start", "sub"))).filter("_r = 1").drop("_r")


def parse_json_index(lines: DataFrame, param: str, level: str | None = None) -> DataFrame:
    """JSON lines of an index; bad lines and bad offsets dropped, one row per member; without a level, records must have none."""
    j = F.from_json("value", "param string, levelist string, number string, _offset long, _length long", {"mode": "PERMISSIVE"})
    x = lines.select("*", j.alias("j")).filter(F.col("j.param") == param).filter(F.col("j.levelist") == level if level else F.col("j.levelist").isNull())
    return x.filter((F.col("j._offset") >= 0) & (F.col("j._length") > 0)).select(*(c for c in lines.columns if c != "value"), F.coalesce(F.col("j.number").cast("int"), F.lit(0)).alias("member"), F.col("j._offset").alias("start"), F.col("j._length").alias("length"))


# Variables of one vocabulary in another, and the scale of values.
VOCABULARY = (("tp", "APCP", 1000.0), ("sf", "WEASD", 1000.0), ("tcc", "TCDC", 100.0), ("z", "HGT", 1 / 9.80665), ("2t", "TMP", 1.0), ("2d", "DPT", 1.0), ("10u", "UGRD", 1.0), ("10v", "VGRD", 1.0), ("msl", "PRMSL", 1.0))


def translate_fields(df: DataFrame, param: str = "param", value: str = "value") -> DataFrame:
    """Variable names of the other vocabulary, values in its units; unknown ones stay."""
    names = F.create_map(*(F.lit(x) for p, v, _ in VOCABULARY for x in (p, v)))
    scale = F.create_map(*(F.lit(x) for p, _, s in VOCABULARY for x in (p, s)))
    return df.withColumns({"var": F.coalesce(F.try_element_at(names, F.col(param)), F.col(param)), value: F.col(value) * F.coalesce(F.try_element_at(scale, F.col(param)), F.lit(1.0))})


def run_calendar(models: DataFrame, days: DataFrame, now: Column) -> DataFrame:
    """Runs of models (model, step_h, latency_h, hourly_to, max_hour, coarse_h) on days that are out by now, with their forecast hours.

    Every model has runs on every day, so models and days meet without a key: the calendar is as long as both together.
    """
    r = days.join(dimension(models.select("model", "step_h", "latency_h", "hourly_to", "max_hour", "coarse_h")))
    r = r.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(23), F.col("step_h"))))
    r = r.withColumn("run", F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("cycle")))
    out = r.filter(F.col("run") + F.make_dt_interval(F.lit(0), F.col("latency_h")) <= now)
    fine, coarse = F.sequence(F.lit(0), F.col("hourly_to")), F.sequence(F.col("hourly_to") + F.col("coarse_h"), F.greatest("max_hour", F.col("hourly_to") + F.col("coarse_h")), F.col("coarse_h"))
    return out.withColumn("fhours", F.when(F.col("max_hour") > F.col("hourly_to"), F.concat(fine, coarse)).otherwise(fine))


def available_runs(runs: DataFrame, files: DataFrame, by: Sequence[str], file: str) -> DataFrame:
    """Runs all of whose distinct required files exist."""
    need = runs.select(*by, file).distinct()
    have = files.select(file).distinct().withColumn("_there", F.lit(1))
    return need.join(have.hint("merge"), file, "left").groupBy(*by).agg(F.bool_and(F.col("_there").isNotNull()).alias("ok")).filter("ok").drop("ok")


def storms_in_cycle(keys: DataFrame, by: Sequence[str] = ("day", "cycle")) -> DataFrame:
    """C17: storms of a cycle and their posted hours from file names like 05l.yyyymmddhh....f006."""
    k = keys.select(F.regexp_extract("key", r"(\d{2}[a-z])\.(\d{8})(\d{2})\.", 1).alias("storm"), F.regexp_extract("key", r"\.(\d{8})\d{2}\.", 1).alias("day"), F.regexp_extract("key", r"\.\d{8}(\d{2})\.", 1).alias("cycle"), F.regexp_extract("key", r"f(\d{3})", 1).alias("hour")).filter("storm <> '' AND hour <> ''")
    return k.groupBy(*by, "storm").agg(F.array_sort(F.collect_set(F.col("hour").cast("int"))).alias("hours"))


def hourly_frames(now: Column, n: int) -> Column:
    """array<struct<time, label, newest>> of the last n full hours, oldest first."""
    top = F.date_trunc("hour", now)
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda k: F.struct((top - F.make_dt_interval(F.lit(0), k)).alias("time"), F.date_format(top - F.make_dt_interval(F.lit(0), k), "yyMMddHH").alias("label"), (k == 0).alias("newest")))


def parse_geojson(texts: DataFrame) -> DataFrame:
    """Features of GeoJSON texts as (properties map, type, lon, lat of the first vertex, geometry json); those without geometry dropped."""
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    f = texts.select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    return f.filter(F.col("f.geometry").isNotNull()).select("f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return parse_geojson(spark.read.text(path, wholetext=True))


def parse_column_table(texts: DataFrame) -> DataFrame:
    """C20: {"table": {"columnNames", "rows"}} texts as rows of map<column, value>."""
    t = texts.select(F.from_json("value", "struct<table: struct<columnNames: array<string>, rows: array<array<string>>>>")["table"].alias("t"))
    return t.select(F.col("t.columnNames").alias("n"), F.explode("t.rows").alias("r")).select(F.map_from_arrays("n", "r").alias("row"))


def to_geojson(df: DataFrame, lon: str, lat: str, properties: Sequence[str]) -> DataFrame:
    """A point feature per row as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str, **columns) -> None:
    to_geojson(df, **columns).write.text(path)


def write_lake(df: DataFrame, path: str, table: str, by: Sequence[str] = ("source", "day"), sort: Sequence[str] = ()) -> None:
    """A lake table partitioned by source and day, sorted inside so that row groups can be skipped."""
    out = df.repartition(*by)
    (out.sortWithinPartitions(*by, *sort) if sort else out).write.partitionBy(*by).parquet(f"{path.rstrip('/')}/{table}")


# Patterns of a palette's hint and the products they stand for; the first that occurs decides.
PALETTE_TARGETS = (
    (r"\bCC\b|RHOHV|CORRELATION", "RHO"), ("ZDR|DIFFERENTIAL REF", "ZDR"), ("KDP|SPECIFIC DIFFERENTIAL", "KDP"), ("PHI|DIFFERENTIAL PH", "PHI"),
    (r"\bSW\b|SPECTRUM", "SW"), (r"\bBV\b|\bV\b|VEL|M/S|KT|KNOT", "VEL"), (r"\bBR\b|\bZ\b|DBZ|REFLECT", "REF"),
)
NO_COLOURS = "no usable Color entries found"


def palette_lines(lines: DataFrame) -> DataFrame:
    """directives of palette text (palette, pos, value) as (palette, pos, kind, rest, v, c1, c2).

    Colours are arrays of red, green, blue and alpha (255 where there is none): c1 at the value v, c2 at the next entry (the same for
    SolidColor, null without one). Comments (;) are dropped, and colour lines with too few or unreadable numbers.
    """
    text = F.trim(F.regexp_replace("value", ";.*$", ""))
    kind = F.lower(F.regexp_extract(text, r"^(\w+)", 1))
    s = lines.select("palette", "pos", kind.alias("kind"), F.trim(F.regexp_extract(text, r"^\w+\s*:?\s*(.*)$", 1)).alias("rest")).filter("kind <> ''")
    s = s.withColumn("n", F.transform(F.split("rest", r"[\s,]+"), lambda x: F.when(x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), x).cast("double")))
    alpha, is_colour = F.col("kind").endswith("4"), F.col("kind").isin("color", "color4", "solidcolor", "solidcolor4")
    width = F.when(alpha, 4).otherwise(3)
    pick = lambda at: F.concat(F.slice("n", at, F.lit(3)), F.array(F.when(alpha, F.try_element_at("n", at + 3)).otherwise(F.lit(255.0))))
    c1 = pick(F.lit(2))
    c2 = F.when(F.col("kind").startswith("solid"), c1).when(F.size("n") >= 1 + 2 * width, pick((width + 2).cast("int")))
    whole = (F.size("n") > width) & F.forall(F.concat(F.slice("n", 1, 1), c1), lambda x: x.isNotNull())
    return s.filter(~is_colour | F.coalesce(whole, F.lit(False))).select(
        "palette", "pos", "kind", "rest", F.when(is_colour, F.element_at("n", 1)).alias("v"), F.when(is_colour, c1).alias("c1"), F.when(is_colour, c2).alias("c2")
    )


def palettes(lines: DataFrame) -> DataFrame:
    """a row per palette: (palette, segments array<struct<pos, v, c1, c2>>, units, hint, rf, error), the last line of a kind counting.

    rf is the colour of range-folded gates. A palette under two colours has an error and no segments.
    """
    d = palette_lines(lines)
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("rest")), F.when(F.col("kind") == kind, F.col("pos")))
    out = d.groupBy("palette").agg(
        F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("pos", "v", "c1", "c2")))).alias("segments"), last("units").alias("units"), last("product").alias("hint"), last("rf").alias("rf_text")
    )
    n = F.transform(F.split("rf_text", r"[\s,]+"), lambda x: F.when(x.rlike(r"^-?\d+(\.\d+)?$"), x).cast("double"))
    rf = F.when(F.col("rf_text").isNotNull(), F.concat(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.coalesce(F.try_element_at(n, k), F.lit(0.0))), F.array(F.coalesce(F.try_element_at(n, F.lit(4)), F.lit(255.0)))))
    few = F.size("segments") < 2
    return out.select("palette", F.when(~few, F.col("segments")).alias("segments"), "units", "hint", rf.alias("rf"), F.when(few, NO_COLOURS).alias("error"))


def parse_palette(lines: DataFrame) -> DataFrame:
    """colour stops of palette text as (palette, pos, kind, v, c1, c2)."""
    return palette_lines(lines).filter("v IS NOT NULL").drop("rest")


def palette_target(hint: Column, units: Column | None = None) -> Column:
    """the product a palette is for, by the first pattern in its hint and units; null if none is there."""
    said = F.upper(F.concat_ws(" ", F.coalesce(hint, F.lit("")), F.coalesce(units, F.lit("")) if units is not None else F.lit("")))
    out = None
    for pattern, product in PALETTE_TARGETS:
        out = F.when(said.rlike(pattern), product) if out is None else out.when(said.rlike(pattern), product)
    return out
