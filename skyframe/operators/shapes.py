"""Polygons, alerts, tracks and catalogues of sites: joins by place and time.

A polygon is array<struct<lon, lat>> (its outer ring); polygons that cross the date line are not unwrapped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions import geo
from skyframe.functions.reports import MAP_EVENTS, alert_rank
from skyframe.operators.joins import dimension
from skyframe.sources.shared import staged


def ring_bounds(ring: Column) -> Column:
    """P10: struct<west, south, east, north> of a ring."""
    part = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(part(F.array_min, "lon").alias("west"), part(F.array_min, "lat").alias("south"), part(F.array_max, "lon").alias("east"), part(F.array_max, "lat").alias("north"))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule: whether an odd number of edges crosses the ray east of the point."""
    edges = F.transform(ring, lambda p, k: F.struct(p.alias("a"), F.get(ring, F.pmod(k + 1, F.size(ring))).alias("b")))
    crosses = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) + e["a"]["lon"])
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e), F.lit(False)))


def points_in_polygons(points: DataFrame, polys: DataFrame, tile: float = 2.0) -> DataFrame:
    """Point rows (lon, lat) with the polygons (poly, ring) that hold them: tiles of both sides meet in an equi-join, then the ray decides."""
    t = lambda c: F.floor(c / tile).cast("int")
    p = points.withColumns({"_tx": t(F.col("lon")), "_ty": t(F.col("lat"))})
    b = polys.withColumn("_b", ring_bounds(F.col("ring")))
    b = b.withColumn("_tx2", F.explode(F.sequence(t(F.col("_b.west")), t(F.col("_b.east"))))).withColumn("_ty2", F.explode(F.sequence(t(F.col("_b.south")), t(F.col("_b.north")))))
    met = p.join(b.hint("merge"), (F.col("_tx") == F.col("_tx2")) & (F.col("_ty") == F.col("_ty2")))
    return met.filter(in_ring(F.col("lon").cast("double"), F.col("lat").cast("double"), F.col("ring"))).drop("_tx", "_ty", "_tx2", "_ty2", "_b")


def alerts_at(points: DataFrame, alerts: DataFrame, point: str) -> DataFrame:
    """Ids of the alerts over each point, the most significant first."""
    hit = points_in_polygons(points, alerts.withColumn("_rank", alert_rank(F.col("event"))))
    return hit.groupBy(point).agg(F.transform(F.array_sort(F.collect_set(F.struct("_rank", "event", "poly"))), lambda s: s["poly"]).alias("alerts"))


def resolve_geometry(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """An alert (id, zones, rings) without rings takes those of its zones (zone, rings), put together."""
    need = alerts.filter(F.col("rings").isNull()).select("id", F.explode("zones").alias("zone"))
    found = need.join(zones.withColumnRenamed("rings", "_z").hint("merge"), "zone").groupBy("id").agg(combine_polygons("_z").alias("_z"))
    return alerts.join(found.hint("merge"), "id", "left").withColumn("rings", F.coalesce("rings", "_z")).drop("_z")


def combine_polygons(rings: str) -> Column:
    """U4: all polygons of a group as one array of rings."""
    return F.flatten(F.collect_list(rings))


def drop_superseded(alerts: DataFrame, at: Column) -> DataFrame:
    """Alerts that no alert sent by then refers to."""
    gone = alerts.filter(F.col("sent") <= at).select(F.explode("refs").alias("_id")).distinct()
    return alerts.join(gone.hint("merge"), F.col("id") == F.col("_id"), "left_anti")


def keep_events(alerts: DataFrame, events: Sequence[str] = MAP_EVENTS) -> DataFrame:
    """Alerts of the events shown."""
    return alerts.filter(F.col("event").isin(*events))


def active(at: Column) -> Column:
    """J10 for one time: not cancelled, sent and begun by then, not ended (an end may be missing)."""
    begun = F.greatest("sent", F.coalesce("onset", "sent")) <= at
    return ~F.col("cancel") & begun & (F.col("ends").isNull() | (at < F.col("ends")))


def active_at(alerts: DataFrame, times: DataFrame, bucket_days: int = 1, per_task: int = 100_000_000, per_slice: int = 512) -> DataFrame:
    """Pairs (time, alert) of the alerts active at each time. Both sides meet by day; an alert without an end lasts to the last day of times.

    Pairs outgrow both tables, so days are dealt to tasks by the pairs that meet in them, a task for each quarter of `per_task`. The times
    of a day that has more than `per_task` are dealt by their hash first; then all are cut into slices of `per_slice` in order. An alert
    is told with all times of a slice before the next alert: it stays for a slice's length and the same times come round
    at even steps, which Parquet stores in a fraction of the room of rows whose alerts come round.
    """
    day = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / bucket_days)
    begin = F.greatest(F.col("sent"), F.coalesce("onset", "sent"))
    last = times.agg(F.max(day(F.col("time"))).alias("_last"))
    a = alerts.filter(~F.col("cancel")).withColumns({"_b": begin, "_e": F.col("ends")}).filter("_e IS NULL OR _e > _b").crossJoin(F.broadcast(last))
    a = a.withColumn("_to", F.least(day(F.col("_e")), F.col("_last"))).filter(day(F.col("_b")) <= F.col("_to")).withColumn("_d", F.explode(F.sequence(day(F.col("_b")), F.col("_to"))))
    t = times.withColumn("_d2", day(F.col("time")))
    same = F.col("_d2") == F.col("_d")

    met = t.groupBy("_d2").agg(F.count("*").alias("_n")).join(a.groupBy("_d").agg(F.count("*").alias("_m")).hint("merge"), same)
    met = met.select(F.col("_d").alias("_day"), F.ceil(F.col("_n") * F.col("_m") / per_task).alias("_cut"), (F.col("_n") * F.col("_m") / per_task).alias("_share"))
    n = int(met.agg(F.ceil(4 * F.sum("_share"))).first()[0] or 0)
    if n > 4:  # fewer are left to Spark
        cut = dimension(staged(met.filter("_cut > 1").select("_day", "_cut"), "cut-days"))
        held = [f.name for f in times.schema.fields if "map<" not in f.dataType.simpleString()]
        t = t.join(cut, F.col("_d2") == F.col("_day"), "left").withColumn("_part", F.pmod(F.xxhash64(*held), F.coalesce("_cut", F.lit(1)))).drop("_day", "_cut").repartition(n, "_d2", "_part")
        nth = F.row_number().over(Window.partitionBy("_d2", "_part").orderBy("time"))
        t = staged(t.withColumn("_s2", F.floor((nth - 1) / per_slice)), "times")
        slices = dimension(staged(t.select(F.col("_d2").alias("_day"), F.col("_part").alias("_p"), F.col("_s2").alias("_s")).distinct(), "slices"))
        t, a = t.repartition(n, "_d2", "_part", "_s2"), a.join(slices, F.col("_d") == F.col("_day")).repartition(n, "_d", "_p", "_s")
        same = same & (F.col("_part") == F.col("_p")) & (F.col("_s2") == F.col("_s"))
    met = a.join(t.hint("merge"), same & (F.col("_b") <= F.col("time")) & (F.col("_e").isNull() | (F.col("time") < F.col("_e"))))
    return met.select(*times.columns, *alerts.columns)


def nearest_site(points: DataFrame, sites: DataFrame, key: str, terminal: str | None = None) -> DataFrame:
    """Each point's nearest site by great circle (ties: least id); null where a point or all sites lack a place.

    Sites whose column `terminal` is true take no part. Equal places are one. Tiles of points and tiles of sites are cut into
    16 together, level by level; a pair of tiles is dropped once it is proven that another site tile holds a nearer site for
    every point of the point tile. Points then meet the sites of the tiles left, wherever these are: no point meets all sites.
    """
    at = lambda c: F.col(c).cast("double")
    rad = lambda c: c * 0.017453292519943295

    def distance(a: Column, o: Column, b: Column, q: Column) -> Column:
        h = F.pow(F.sin(rad(b - a) / 2), 2) + F.cos(rad(a)) * F.cos(rad(b)) * F.pow(F.sin(rad(q - o) / 2), 2)
        return 2 * geo.R_EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

    used = sites if terminal is None else sites.filter(~F.coalesce(F.col(terminal), F.lit(False)))
    s = used.select(at("lat").alias("_sa"), at("lon").alias("_so"), "site").dropna(subset=["_sa", "_so"]).groupBy("_sa", "_so").agg(F.min("site").alias("site"))
    p = points.select(at("lat").alias("_a"), at("lon").alias("_o")).dropna().distinct()
    finest = min(14, max(1, math.ceil(math.log2(s.count() + 1) / 2) + 1))

    def tiled(df: DataFrame, lat: str, lon: str, x: str, y: str) -> DataFrame:
        size, n = 360 / 2**finest, 2**finest
        across = F.least(F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / size), F.lit(n - 1)).cast("int")
        return df.withColumns({x: across, y: F.greatest(F.lit(0), F.least(F.floor((F.col(lat) + 90) / size), F.lit(n // 2 - 1))).cast("int")})

    s, p = staged(tiled(s, "_sa", "_so", "_sx", "_sy"), "sites"), staged(tiled(p, "_a", "_o", "_px", "_py"), "places")
    s_tiles, p_tiles = staged(s.select("_sx", "_sy").distinct(), "site-tiles"), staged(p.select("_px", "_py").distinct(), "place-tiles")
    pairs = p.sparkSession.range(1).select(*(F.lit(0).alias(c) for c in ("_px", "_py", "_sx", "_sy")))
    done = 0
    for level in sorted(range(finest, 0, -2)):
        size, up, step, done = 360 / 2**level, finest - level, level - done, level
        children = lambda df, x, y, n, k=step: df.select(F.shiftright(x, n).alias(x), F.shiftright(y, n).alias(y)).distinct().select("*", F.shiftright(x, k).alias(f"{x}0"), F.shiftright(y, k).alias(f"{y}0"))
        parents = pairs.withColumnsRenamed({c: f"{c}0" for c in ("_px", "_py", "_sx", "_sy")})
        met = parents.join(children(p_tiles, "_px", "_py", up).hint("merge"), ["_px0", "_py0"]).join(children(s_tiles, "_sx", "_sy", up).hint("merge"), ["_sx0", "_sy0"])
        lat, lon = (lambda y, z=size: (F.col(y) + 0.5) * z - 90), (lambda x, z=size: (F.col(x) + 0.5) * z - 180)
        # a place is at most half a tile's height and then half its width along a parallel away from the centre
        reach = lambda y, z=size, la=lat: geo.R_EARTH * math.radians(z / 2) * (1 + F.cos(rad(F.greatest(F.lit(0.0), F.abs(la(y)) - z / 2))))
        apart, spread = distance(lat("_py"), lon("_px"), lat("_sy"), lon("_sx")), reach("_py") + reach("_sy")
        met = met.select("_px", "_py", "_sx", "_sy", (apart - spread).alias("_low"), (apart + spread).alias("_high"))
        best = met.groupBy("_px", "_py").agg((F.min("_high") * (1 + 1e-9) + 1e-3).alias("_best"))
        pairs = staged(met.join(best.hint("merge"), ["_px", "_py"]).filter(F.col("_low") <= F.col("_best")).select("_px", "_py", "_sx", "_sy"), "tile-pairs")
    near = p.join(pairs.hint("merge"), ["_px", "_py"]).join(s.hint("merge"), ["_sx", "_sy"])
    found = near.groupBy("_a", "_o").agg(F.min(F.struct(distance(F.col("_a"), F.col("_o"), F.col("_sa"), F.col("_so")).alias("d"), "site")).alias("_best"))
    out = points.withColumns({"_a": at("lat"), "_o": at("lon")}).join(found.hint("merge"), ["_a", "_o"], "left")
    return out.withColumns({"site": F.col("_best.site"), "dist_m": F.col("_best.d")}).drop("_a", "_o", "_best")


def networks_in_view(views: DataFrame, networks: DataFrame, most: int = 12, tile: float = 8.0) -> DataFrame:
    """Networks (name, west..north) whose box overlaps a view's, nearest centres first, at most 12 to a view."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.col(b) / tile).cast("int"))
    v = views.withColumn("_t", F.explode(span("west", "east")))
    n = networks.select("name", *(F.col(c).alias(f"n_{c}") for c in ("west", "south", "east", "north"))).withColumn("_t2", F.explode(span("n_west", "n_east")))
    met = v.join(n.hint("merge"), F.col("_t") == F.col("_t2")).filter(geo.boxes_overlap("west", "south", "east", "north", "n_west", "n_south", "n_east", "n_north")).dropDuplicates(["view", "name"])
    dx, dy = F.col("west") + F.col("east") - F.col("n_west") - F.col("n_east"), F.col("south") + F.col("north") - F.col("n_south") - F.col("n_north")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("view").orderBy(dx * dx + dy * dy, "name")))
    return ranked.filter(F.col("rank") <= most).select("view", "name", "rank")


def simplify_path(path: Column, n: int) -> Column:
    """At most n evenly indexed vertices."""
    last = F.size(path) - 1
    return F.when(F.size(path) <= n, path).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(path, F.floor(i * last / (n - 1) + 0.5).cast("int"))))


def _move(lat: Column, lon: Column, brg: Column, dist: Column) -> Column:
    d, la, br = dist / geo.R_EARTH, F.radians(lat), F.radians(brg)
    s = F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(br)
    return F.struct((lon + F.degrees(F.atan2(F.sin(br) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * s))).alias("lon"), F.degrees(F.asin(s)).alias("lat"))


def storm_cone(lat: Column, lon: Column, brg: Column, total_m: Column, samples: int = 24) -> Column:
    """Ring of the forecast cone, left side out and right side back."""
    at = lambda k: _move(lat, lon, brg, total_m * k / samples)
    half = lambda k: 4000 + 0.28 * total_m * k / samples
    side = lambda turn: F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda k: _move(at(k)["lat"], at(k)["lon"], brg + turn, half(k)))
    left = side(-90)
    return F.concat(left, F.reverse(side(90)), F.slice(left, 1, 1))


def corridor_ring(path: Column, half_width_m: Column | float) -> Column:
    """Ring of constant half-width around a path, array<struct<lat, lon>>: left side out, right side back; a vertex looks from the one before to the one after."""
    last = F.size(path) - 1
    rad = lambda c: F.radians(c)

    def heading(k: Column) -> Column:
        a, b = F.get(path, F.greatest(k - 1, F.lit(0))), F.get(path, F.least(k + 1, last))
        d = rad(b["lon"] - a["lon"])
        return F.degrees(F.atan2(F.sin(d) * F.cos(rad(b["lat"])), F.cos(rad(a["lat"])) * F.sin(rad(b["lat"])) - F.sin(rad(a["lat"])) * F.cos(rad(b["lat"])) * F.cos(d)))

    width = F.lit(half_width_m) if isinstance(half_width_m, float | int) else half_width_m
    side = lambda turn: F.transform(path, lambda p, k: _move(p["lat"], p["lon"], heading(k) + turn, width))
    left = side(-90)
    return F.concat(left, F.reverse(side(90)), F.slice(left, 1, 1))


def swept_footprint(path: Column, brg: Column, dist: Column) -> Column:
    """A path joined to its copy moved along the bearing."""
    moved = F.transform(path, lambda p: _move(p["lat"], p["lon"], brg, dist))
    own = F.transform(path, lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat")))
    return F.concat(own, F.reverse(moved), F.slice(own, 1, 1))


def storm_track(storms: DataFrame, places: DataFrame, n: int = 20) -> DataFrame:
    """Towns (place, name, lat, lon) inside each storm's cone (storm, lat, lon, bearing, mps, minutes) with their time of arrival, the first n of them."""
    total = F.col("mps") * F.col("minutes") * 60
    cones = storms.select("storm", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "bearing", "mps", total.alias("total_m"), storm_cone(F.col("lat"), F.col("lon"), F.col("bearing"), total).alias("ring")).withColumn("poly", F.col("storm"))
    hit = points_in_polygons(places, cones)
    along = hit.withColumn("along_m", geo.along_track("s_lat", "s_lon", "bearing", "lat", "lon")).filter((F.col("along_m") >= -2000) & (F.col("along_m") <= F.col("total_m")))
    ranked = along.withColumn("eta_min", F.greatest(F.lit(0.0), F.col("along_m")) / F.col("mps") / 60)
    w = Window.partitionBy("storm")
    return ranked.withColumn("position", F.row_number().over(w.orderBy("eta_min", "place"))).withColumn("n_towns", F.count("*").over(w)).filter(F.col("position") <= n).select("storm", "place", "eta_min", "position", "n_towns")


def outlook_legend(areas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per label from the area of the highest sort, ascending, with the level of a CIGn code."""
    top = areas.groupBy(*by, "label").agg(F.max(F.struct("sort", "code", "fill")).alias("x")).select(*by, "label", "x.*")
    level = F.regexp_extract("code", r"^CIG(\d)$", 1)
    return top.withColumn("intensity", F.when(level != "", level).cast("int")).orderBy(*by, "sort")


# Fire weather and rainfall outlooks: (code, label, fill).
FIRE_CATEGORIES = ((5, "Elevated", "rgb(230,152,0)"), (8, "Critical", "rgb(255,0,0)"), (10, "Extremely Critical", "rgb(230,0,169)"))
DRY_STORMS = ((4, "Isolated Dry T-storm", "rgb(115,38,0)"), (5, "Isolated Dry T-storm", "rgb(115,38,0)"), (8, "Scattered Dry T-storm", "rgb(255,0,0)"))
RAIN_RISKS = ((1, "Marginal", "rgb(56,168,0)"), (2, "Slight", "rgb(255,254,0)"), (3, "Moderate", "rgb(245,0,0)"), (4, "High", "rgb(255,105,197)"))
UNKNOWN_FILL = "rgb(150,150,150)"


def code_style(code: Column, table: Sequence[tuple[int, str, str]], otherwise: Column) -> Column:
    """struct<label, fill, sort> of an outlook area by its code; codes that the table lacks are grey and named by `otherwise`."""
    n, out = code.cast("int"), None
    for value, label, fill in table:
        style = F.struct(F.lit(label).alias("label"), F.lit(fill).alias("fill"), F.lit(value).alias("sort"))
        out = F.when(n == value, style) if out is None else out.when(n == value, style)
    return out.otherwise(F.struct(otherwise.alias("label"), F.lit(UNKNOWN_FILL).alias("fill"), F.coalesce(n, F.lit(0)).alias("sort")))


def fire_style(code: Column, dry: bool = False) -> Column:
    """fire weather by `dn`: categories, or dry thunderstorms."""
    return code_style(code, DRY_STORMS if dry else FIRE_CATEGORIES, F.concat(F.lit("dn "), code.cast("string")))


def rain_style(code: Column, outlook: Column) -> Column:
    """excessive rainfall by risk level; another level goes by the outlook's own name, else Level n."""
    return code_style(code, RAIN_RISKS, F.coalesce(F.nullif(outlook, F.lit("")), F.concat(F.lit("Level "), code.cast("string"))))


def chance_label(category: Column, prob: Column) -> Column:
    """struct<label, sort> of temperature and precipitation outlooks: above or below by probability, all else near normal."""
    side = F.when(category == "Above", 1).when(category == "Below", -1).otherwise(0)
    return F.struct(F.when(side != 0, F.concat(category, F.lit(" "), prob.cast("string"), F.lit("%"))).otherwise("Near Normal").alias("label"), F.when(side != 0, side * prob).otherwise(0).alias("sort"))


def step_style(df: DataFrame, style: DataFrame, key: str, value: Column) -> DataFrame:
    """the deepest class (category, floor, style) whose floor a value reaches; the style table is a dimension."""
    classes = style.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("floor", "style"))).alias("_c"))
    out = df.join(dimension(classes), key, "left")
    return out.withColumn("style", F.try_element_at(F.filter("_c", lambda c: c["floor"] <= value), F.lit(-1))["style"]).drop("_c")


def union_storms(first: DataFrame, second: DataFrame, own_basins: Sequence[str]) -> DataFrame:
    """Two agencies' storms in one schema; basins the first one owns are left out of the second."""
    return first.unionByName(second.filter(~F.col("basin").isin(*own_basins)), allowMissingColumns=True)
