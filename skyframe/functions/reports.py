"""Text rules of storm reports, alerts, stations and forecasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe.functions.formula import Formula
from skyframe.functions.geo import COMPASS

# Ordered patterns of report categories; the first that occurs decides.
CATEGORY_RULES = (
    ("TORNADO|LANDSPOUT|WATER ?SPOUT", "tornado"), ("FUNNEL|WALL CLOUD|DUST DEVIL", "tornado"), ("HAIL", "hail"),
    ("SNOW|BLIZZARD|SLEET|ICE|FREEZING|WINTER|AVALANCHE|COLD|WIND CHILL|FROST", "winter"),
    ("FLOOD|RAIN|DEBRIS FLOW|MUD ?SLIDE|LANDSLIDE|STORM SURGE|SEICHE|HIGH SURF|RIP CURRENT|HIGH ASTR|TSUNAMI|DAM (BREAK|FAILURE)", "flood"),
    ("WND|WIND", "wind"), ("LIGHTNING", "other"),
)
# What abbreviations of report types stand for.
TYPE_WORDS = {"TSTM": "T-storm", "NON-TSTM": "Non-t-storm", "WND": "Wind", "DMG": "Damage", "GST": "Gust", "EXTR": "Extreme", "SUST": "Sustained"}
# Significance of alerts, most significant first.
PRIORITY = (
    "Tornado Emergency", "PDS Tornado Warning", "Tornado Warning", "Destructive Severe Thunderstorm Warning",
    "Considerable Severe Thunderstorm Warning", "Severe Thunderstorm Warning", "Flash Flood Emergency", "PDS Flash Flood Warning",
    "Flash Flood Warning", "Snow Squall Warning", "Extreme Wind Warning", "Tsunami Warning", "Tornado Watch",
    "Severe Thunderstorm Watch", "Tsunami Watch", "Tsunami Advisory",
)
# Events that a map shows.
MAP_EVENTS = (
    "Tornado Warning", "Tornado Watch", "Severe Thunderstorm Warning", "Severe Thunderstorm Watch", "Flash Flood Warning", "Winter Storm Watch",
    "Winter Storm Warning", "Blizzard Warning", "Snow Squall Warning", "Storm Surge Warning", "Storm Surge Watch", "Tropical Storm Warning",
    "Tropical Storm Watch", "Hurricane Warning", "Hurricane Watch", "Typhoon Warning", "Typhoon Watch", "Extreme Wind Warning",
    "Special Weather Statement", "Tsunami Advisory", "Tsunami Warning", "Tsunami Watch",
)
# Oktas of cloud cover codes.
OKTAS = {"SKC": 0, "CLR": 0, "NSC": 0, "FEW": 2, "SCT": 4, "BKN": 6, "OVC": 8, "OVX": 8, "VV": 8}


def report_category(text: Column) -> Column:
    """F1"""
    t, out = F.upper(F.coalesce(text, F.lit(""))), None
    for pattern, category in CATEGORY_RULES:
        out = F.when(t.rlike(pattern), category) if out is None else out.when(t.rlike(pattern), category)
    return out.otherwise("other")


def report_type_name(text: Column) -> Column:
    """abbreviations spelled out, other words with a capital; blank is Report."""
    words = F.create_map(*(F.lit(x) for kv in TYPE_WORDS.items() for x in kv))
    name = lambda w: F.coalesce(F.try_element_at(words, F.upper(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    return F.array_join(F.transform(F.split(F.trim(F.coalesce(F.when(text != "", text), F.lit("Report"))), r"\s+"), name), " ")


magnitude_text = Formula("F3: magnitude {0}, else {1}, with unit {2}; 0 and blank are null.", "CASE WHEN CAST(coalesce(nullif({0}, ''), nullif({1}, '')) AS DOUBLE) <> 0 THEN concat(coalesce(nullif({0}, ''), nullif({1}, '')), CASE WHEN {2} <> '' THEN concat(' ', lower({2})) ELSE '' END) END")
coord_text = Formula("F6: coordinates as text.", "concat(CAST(CAST(abs({0}) AS DECIMAL(9, 2)) AS VARCHAR(12)), CASE WHEN {0} >= 0 THEN 'N ' ELSE 'S ' END, CAST(CAST(abs({1}) AS DECIMAL(9, 2)) AS VARCHAR(12)), CASE WHEN {1} >= 0 THEN 'E' ELSE 'W' END)")


def report_id(fields: list[Column], supplied: Column | None = None) -> Column:
    """the id given, else 32-bit FNV-1a over the fields' code units with U+001F between them, in base 36."""
    text = F.concat_ws("\u001f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))
    units = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    high = F.transform(units, lambda u: F.when(u > 65535, F.array(F.lit(55296) + F.floor((u - 65536) / 1024), F.lit(56320) + (u - 65536) % 1024)).otherwise(F.array(u)))
    hashed = F.aggregate(F.flatten(high), F.lit(2166136261).cast("long"), lambda h, u: h.bitwiseXOR(u) * F.lit(16777619) % F.lit(4294967296))
    own = F.lower(F.conv(hashed.cast("string"), 10, 36))
    return F.concat(F.lit("lsr:"), F.coalesce(F.when(supplied != "", supplied.cast("string")), own) if supplied is not None else own)


def extra_details(properties: Column, core: tuple[str, ...]) -> Column:
    """properties outside the core set, labels with capitals, blanks dropped."""
    kept = F.map_filter(properties, lambda k, v: ~k.isin(*core) & v.isNotNull() & (F.trim(v) != ""))
    return F.transform_keys(kept, lambda k, v: F.initcap(F.replace(k, F.lit("_"), F.lit(" "))))


def location_text(place: Column, county: Column, state: Column) -> Column:
    """F6"""
    return F.concat_ws(", ", *(F.when(c != "", c) for c in (place, county, state)))


def catalog_name(title: Column, station: Column) -> Column:
    """a title without its station id, (LLNR ...) notes and a leading dash."""
    bare = F.regexp_replace(F.regexp_replace(title, F.concat(F.lit(r"^\s*"), station, F.lit(r"\b")), F.lit("")), r"\(LLNR[^)]*\)", "")
    return F.trim(F.regexp_replace(bare, r"^\s*-\s*", ""))


# Fixed values: (event, parameter, threat, name) of warnings that a damage threat renames.
THREAT_NAMES = (
    ("Tornado Warning", "tornado", "CATASTROPHIC", "Tornado Emergency"), ("Tornado Warning", "tornado", "CONSIDERABLE", "PDS Tornado Warning"),
    ("Severe Thunderstorm Warning", "storm", "DESTRUCTIVE", "Destructive Severe Thunderstorm Warning"), ("Severe Thunderstorm Warning", "storm", "CONSIDERABLE", "Considerable Severe Thunderstorm Warning"),
    ("Flash Flood Warning", "flood", "CATASTROPHIC", "Flash Flood Emergency"),
)


def classify_alert(event: Column, tornado_threat: Column, storm_threat: Column, flood_threat: Column, text: Column) -> Column:
    """the name an alert is shown under: by its damage threat, else EDS or PDS by the situation its text calls it."""
    threat = {k: F.upper(F.coalesce(c, F.lit(""))) for k, c in (("tornado", tornado_threat), ("storm", storm_threat), ("flood", flood_threat))}
    shown, said = F.coalesce(event, F.lit("Alert")), F.upper(F.coalesce(text, F.lit("")))
    out = None
    for of, parameter, value, name in THREAT_NAMES:
        hit = (event == of) & (threat[parameter] == value)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for phrase, mark in (("EXTREMELY DANGEROUS SITUATION", "EDS "), ("PARTICULARLY DANGEROUS SITUATION", "PDS ")):
        out = out.when(said.contains(phrase), F.concat(F.lit(mark), shown))
    return out.otherwise(shown)


def alert_rank(display: Column) -> Column:
    """Place in the order of significance; other alerts come last."""
    found = F.array_position(F.array(*map(F.lit, PRIORITY)), display)
    return F.when(found > 0, found).otherwise(len(PRIORITY) + 1)


def parse_motion(text: Column) -> Column:
    """struct<heading, compass, mph> of 'dddDEG ... kkKT'; storms are reported by where they come from."""
    deg, kt = F.regexp_extract(text, r"(\d{1,3})DEG", 1), F.regexp_extract(text, r"(\d{1,3})KT", 1)
    heading = (deg.cast("int") + 180) % 360
    point = F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(heading / 22.5 + 0.5) % 16 + 1).cast("int"))
    return F.when((deg != "") & (kt != ""), F.struct(F.try_add(heading, F.lit(0)).alias("heading"), point.alias("compass"), F.floor(kt.cast("int") * 1.151 + 0.5).cast("int").alias("mph")))


def max_cover(clouds: Column) -> Column:
    """Greatest cover in oktas of array<struct<cover, base>>."""
    oktas = F.create_map(*(F.lit(x) for kv in OKTAS.items() for x in kv))
    return F.array_max(F.transform(clouds, lambda c: F.try_element_at(oktas, F.upper(c["cover"]))))


def ceiling_ft(clouds: Column) -> Column:
    """Lowest base of a broken or worse layer."""
    return F.array_min(F.transform(F.filter(clouds, lambda c: F.upper(c["cover"]).isin("BKN", "OVC", "OVX", "VV")), lambda c: c["base"]))


age_text = Formula("F15: an age of {0} seconds as text.", "CASE WHEN {0} < 60 THEN 'just now' WHEN {0} < 3600 THEN concat(CAST(CAST(floor({0} / 60) AS INT) AS VARCHAR(9)), ' min ago') WHEN {0} < 86400 THEN concat(CAST(CAST(floor({0} / 3600) AS INT) AS VARCHAR(9)), ' h ago') ELSE concat(CAST(CAST(floor({0} / 86400) AS INT) AS VARCHAR(9)), ' d ago') END")


def parse_mixed_time(text: Column) -> Column:
    """ISO, YYYYMMDDHHMM or epoch milliseconds."""
    ms = F.try_to_number(F.when(text.rlike(r"^\d{13}$"), text), F.lit("9999999999999"))
    compact = F.try_to_timestamp(F.when(text.rlike(r"^\d{12}$"), text), F.lit("yyyyMMddHHmm"))
    return F.coalesce(F.timestamp_millis(ms.cast("long")), compact, F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-"), text)))


def parse_discussion(text: Column) -> Column:
    """struct of a mesoscale discussion's fields; absent ones are null. The body is the prose between the header and the signature,
    the coordinates or the footer."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    one = lambda p: F.nullif(F.regexp_replace(trim(F.regexp_extract(text, p, 1)), r"[ \t]+", " "), F.lit(""))
    concerning = one(r"(?i)Concerning\.\.\.([^\n]+)")
    parts = F.filter(F.transform(F.split(concerning, r"\.\.\.+"), trim), lambda x: x != "")
    header = F.when(text.rlike(r"(?i)Probability of Watch Issuance[^\n]*\n"), F.regexp_replace(text, r"(?is)\A.*?Probability of Watch Issuance[^\n]*\n", "")).otherwise(F.regexp_replace(text, r"(?is)\A.*?Valid\s+[0-9]{6}Z[^\n]*\n", ""))
    body = F.regexp_replace(header, r"(?is)\n\s*(?:\.\.[A-Z][A-Z/. ]*\.\.\s+\d{2}/\d{2}/\d{4}|\.\.\.Please see|ATTN\.\.\.|LAT\.\.\.LON).*\z", "")
    return F.struct(
        one(r"(?i)Mesoscale Discussion\s+(\d+)").cast("int").alias("number"), one(r"(?i)\n\s*(\d{3,4}\s+(?:AM|PM)\s+\w{2,4}\s+\w{3}\s+\w{3}\s+\d{1,2}\s+\d{4})").alias("issued"),
        one(r"(?is)Areas affected\.\.\.(.*?)\n\s*\n").alias("areas"), concerning.alias("concerning"), F.coalesce(F.try_element_at(parts, F.lit(1)), concerning).alias("category"),
        F.nullif(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " · "), F.lit("")).alias("watch_status"), one(r"(?i)Valid\s+([0-9]{6}Z\s*-\s*[0-9]{6}Z)").alias("valid"),
        one(r"(?i)Probability of Watch Issuance\.\.\.\s*(\d+)\s*percent").cast("int").alias("watch_probability"), one(r"(?i)MOST PROBABLE PEAK TORNADO INTENSITY\.\.\.\s*([^\n]+)").alias("peak_tornado"),
        one(r"(?i)MOST PROBABLE PEAK WIND GUST\.\.\.\s*([^\n]+)").alias("peak_wind"), one(r"(?i)MOST PROBABLE PEAK HAIL SIZE\.\.\.\s*([^\n]+)").alias("peak_hail"), F.nullif(trim(body), F.lit("")).alias("body"),
    )


# Impact parameters of alerts and their labels, in order of display.
TAGS = (
    ("tornadoDetection", "TORNADO"), ("tornadoDamageThreat", "TORNADO DAMAGE THREAT"), ("waterspoutDetection", "WATERSPOUT"), ("maxHailSize", "MAX HAIL"), ("hailThreat", "HAIL THREAT"),
    ("maxWindGust", "MAX WIND GUST"), ("windThreat", "WIND THREAT"), ("thunderstormDamageThreat", "THUNDERSTORM DAMAGE THREAT"), ("flashFloodDamageThreat", "FLASH FLOOD DAMAGE THREAT"),
    ("flashFloodDetection", "FLASH FLOOD"), ("snowSquallImpact", "SNOW SQUALL IMPACT"),
)
# Hazards of a convective outlook by day.
OUTLOOK_TYPES = {1: ("cat", "torn", "wind", "hail"), 2: ("cat", "torn", "wind", "hail"), 3: ("cat", "prob")} | {d: ("prob",) for d in range(4, 9)}


def impact_tags(params: Column) -> Column:
    """array<struct<label, value, strong>> of an alert's impact parameters (map of arrays); hail sizes get their unit."""
    value = lambda k: F.upper(F.try_element_at(F.try_element_at(params, F.lit(k)), F.lit(1)))
    with_unit = lambda k: F.when(value(k).contains("IN"), value(k)).otherwise(F.concat(value(k), F.lit(" IN"))) if k == "maxHailSize" else value(k)
    all_ = F.array(*(F.struct(F.lit(label).alias("label"), with_unit(k).alias("value"), value(k).rlike("CONSIDERABLE|CATASTROPHIC|DESTRUCTIVE|OBSERVED").alias("strong")) for k, label in TAGS))
    return F.filter(all_, lambda t: F.coalesce(t["value"], F.lit("")) != "")


def outlook_types(day: Column) -> Column:
    """hazards of the outlook of a day, 1 to 8."""
    return F.try_element_at(F.create_map(*(x for d, names in OUTLOOK_TYPES.items() for x in (F.lit(d), F.array(*map(F.lit, names))))), day.cast("int"))


def alert_window(at: Column) -> Column:
    """struct<start, end> of the history asked for a time: its half hour, 36 hours back and 30 minutes on."""
    half = F.date_trunc("hour", at) + F.make_dt_interval(F.lit(0), F.lit(0), (F.floor(F.minute(at) / 30) * 30).cast("int"))
    return F.struct((half - F.expr("INTERVAL 36 HOURS")).alias("start"), (half + F.expr("INTERVAL 30 MINUTES")).alias("end"))


def valid_time(run: Column, fhour: Column) -> Column:
    """run time plus forecast hour."""
    return run + F.make_dt_interval(F.lit(0), fhour.cast("int"))


def shown_report(category: Column, lon: Column, lat: Column, categories: tuple[str, ...]) -> Column:
    """A report of the chosen categories at a finite place."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf"))
    return category.isin(*categories) & fine(lon) & fine(lat)
