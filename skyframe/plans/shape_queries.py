"""Queries of skyframe.operators.shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import geo as G
from skyframe.functions.reports import MAP_EVENTS, PRIORITY
from skyframe.operators import series as S
from skyframe.operators import shapes as P
from skyframe.plans.base import query

AT = "2024-01-01 00:00:00"


def _polys(x, size=3.0):
    p = lambda dx, dy: F.struct((F.col("cx") + dx).cast("double").alias("lon"), (F.col("cy") + dy).cast("double").alias("lat"))
    return x.d("polygon").withColumn("ring", F.array(p(-size, -size), p(size, -size), p(0.0, size)))


INSIDE = "lat >= cy - 3 AND lat < cy + 3 AND abs(lon - cx) <= (cy + 3 - lat) / 2"


def _alerts(x):
    a = x.d("alert")
    return a.select("id", "event", "sent", F.lit(None).cast("timestamp_ntz").alias("onset"), F.expr("sent + make_dt_interval(CAST(days AS INT))").alias("ends"), "cancel", F.when(F.col("ref").isNotNull(), F.array("ref")).alias("refs"))


MID = "(SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 FROM orders)"


def _mid(x):
    lo, hi = x.t("orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    return F.lit(lo + (hi - lo) / 2).cast("timestamp_ntz")


@query("j11_p10_points_in_polygons", f"SELECT place, poly FROM (SELECT place, lon + 0.25 AS lon, lat + 0.3 AS lat FROM [place]) p JOIN [polygon] q ON {INSIDE}")
def _(x):
    pts = x.d("place").select("place", (F.col("lon") + 0.25).alias("lon"), (F.col("lat") + 0.3).alias("lat"))
    return P.points_in_polygons(pts, _polys(x)).select("place", "poly")


_RANK = "CASE event " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(PRIORITY, 1)) + f" ELSE {len(PRIORITY) + 1} END"
_EVENT = "CASE poly % 3 WHEN 0 THEN 'Tornado Warning' WHEN 1 THEN 'Tornado Watch' ELSE 'Flash Flood Warning' END"


@query("t8_alerts_at_points", f"SELECT place, string_agg(poly::VARCHAR, ',' ORDER BY r, event, poly) AS alerts FROM (SELECT *, {_RANK} AS r FROM (SELECT place, poly, {_EVENT} AS event FROM (SELECT place, lon + 0.25 AS lon, lat + 0.3 AS lat FROM [place]) p JOIN [polygon] q ON {INSIDE})) GROUP BY 1")
def _(x):
    pts = x.d("place").select("place", (F.col("lon") + 0.25).alias("lon"), (F.col("lat") + 0.3).alias("lat"))
    return P.alerts_at(pts, _polys(x).withColumn("event", F.expr(_EVENT)), "place").select("place", F.array_join(F.transform("alerts", lambda a: a.cast("string")), ",").alias("alerts"))


@query("j7_u4_zone_geometry", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE (CASE WHEN o_orderkey % 25 = (o_orderkey + 7) % 25 THEN 1 ELSE 2 END) END AS n_rings FROM orders")
def _(x):
    zones = _polys(x).select(F.col("poly").cast("long").alias("zone"), F.array("ring").alias("rings"))
    one = F.array(F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))))
    a = x.t("orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_orderkey") % 25, (F.col("o_orderkey") + 7) % 25).alias("zones"), F.when(F.col("o_orderkey") % 3 == 0, one).alias("rings"))
    return P.resolve_geometry(a, zones).select("id", F.size("rings").alias("n_rings"))


@query("j8_drop_superseded", f"SELECT id FROM [alert] WHERE id NOT IN (SELECT ref FROM [alert] WHERE ref IS NOT NULL AND sent <= {MID})")
def _(x):
    return P.drop_superseded(_alerts(x), _mid(x)).select("id")


@query("j9_keep_events", "SELECT id FROM [alert] WHERE event IN (" + ", ".join(f"'{e}'" for e in MAP_EVENTS) + ")")
def _(x):
    return P.keep_events(_alerts(x)).select("id")


@query("j10_active_alerts", f"SELECT id FROM [alert] WHERE NOT cancel AND sent <= {MID} AND {MID} < sent + to_days(days::INT)")
def _(x):
    return _alerts(x).filter(P.active(_mid(x))).select("id")


@query("j10_active_at_times", "SELECT e.event_id, a.id FROM (SELECT event_id, (SELECT min(o_orderdate) FROM orders) + to_days((event_id % 900)::INT) AS time FROM events) e JOIN [alert] a ON NOT a.cancel AND a.sent <= e.time AND e.time < a.sent + to_days(a.days::INT)")
def _(x):
    lo = x.t("orders").agg(F.min("o_orderdate")).first()[0]
    t = x.t("events").select("event_id", (F.lit(lo).cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 900).cast("int"))).alias("time"))
    return P.active_at(_alerts(x), t).select("event_id", "id")


@query("j10_active_at_every_time", "SELECT e.event_id, a.id FROM (SELECT event_id, (SELECT min(o_orderdate) FROM orders) + to_days((event_id % 900)::INT) AS time FROM events) e JOIN [alert] a ON NOT a.cancel AND a.sent <= e.time AND (a.id % 997 = 0 OR e.time < a.sent + to_days(a.days::INT))")
def _(x):
    lo = x.t("orders").agg(F.min("o_orderdate")).first()[0]
    t = x.t("events").select("event_id", (F.lit(lo).cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 900).cast("int"))).alias("time"))
    return P.active_at(_alerts(x).withColumn("ends", F.when(F.col("id") % 997 != 0, F.col("ends"))), t).select("event_id", "id")


@query("j12_nearest_site", f"SELECT place, arg_min(site, (d, site)) AS site, round(min(d), 3) AS dist_m FROM (SELECT p.place, s.site, {G.haversine.sql('p.lat', 'p.lon', 's.lat', 's.lon')} AS d FROM [place] p, [site] s) GROUP BY 1")
def _(x):
    out = P.nearest_site(x.d("place"), x.d("site"), "place")
    return out.select("place", "site", F.round("dist_m", 3).alias("dist_m"))


@query("j13_networks_in_view", """WITH v AS (SELECT place AS view, lon - 6 AS west, lat - 4 AS south, lon + 6 AS east, lat + 4 AS north FROM [place]), n AS (SELECT 'n' || poly AS name, cx - 3 AS west, cy - 3 AS south, cx + 3 AS east, cy + 3 AS north FROM [polygon])
SELECT view, name, rank::INT AS rank FROM (SELECT v.view, n.name, row_number() OVER (PARTITION BY v.view ORDER BY pow(v.west + v.east - n.west - n.east, 2) + pow(v.south + v.north - n.south - n.north, 2), n.name) AS rank
FROM v JOIN n ON v.west <= n.east AND n.west <= v.east AND v.south <= n.north AND n.south <= v.north) WHERE rank <= 12""")
def _(x):
    v = x.d("place").select(F.col("place").alias("view"), (F.col("lon") - 6).alias("west"), (F.col("lat") - 4).alias("south"), (F.col("lon") + 6).alias("east"), (F.col("lat") + 4).alias("north"))
    n = x.d("polygon").select(F.concat(F.lit("n"), F.col("poly").cast("string")).alias("name"), (F.col("cx") - 3).alias("west"), (F.col("cy") - 3).alias("south"), (F.col("cx") + 3).alias("east"), (F.col("cy") + 3).alias("north"))
    return P.networks_in_view(v, n)


@query("t9_simplify_path", "SELECT place, (place % 40 + 2 <= 12) AS whole, CASE WHEN place % 40 + 2 <= 12 THEN place % 40 + 2 ELSE 12 END AS n, CASE WHEN place % 40 + 2 <= 12 THEN 1 ELSE floor((place % 40 + 1) / 11.0 + 0.5)::BIGINT END AS second FROM [place]")
def _(x):
    path = F.sequence(F.lit(0).cast("long"), F.col("place") % 40 + 1)
    s = P.simplify_path(path, 12)
    return x.d("place").select("place", (F.size(path) <= 12).alias("whole"), F.size(s).cast("long").alias("n"), F.get(s, 1).alias("second"))


def _moved(lat: str, lon: str, bearing: str, metres: str) -> tuple[str, str]:
    """SQL of the latitude and longitude at a bearing (degrees) and distance from a place."""
    d = f"({metres} / 6371008.8)"
    s = f"(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos(radians({bearing})))"
    return f"degrees(asin({s}))", f"{lon} + degrees(atan2(sin(radians({bearing})) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * {s}))"


_AXIS, _SIDE = _moved("cy", "cx", "brg", "288000 * k / 24.0::DOUBLE"), _moved("la", "lo", "(brg + turn)", "(4000 + 0.28 * 288000 * k / 24.0::DOUBLE)")


@query("g4_g5_g7_storm_track_towns", f"""
WITH s AS (SELECT poly AS storm, cy::DOUBLE AS cy, cx::DOUBLE AS cx, poly * 14.0::DOUBLE AS brg FROM [polygon]),
axis AS (SELECT *, {_AXIS[0]} AS la, {_AXIS[1]} AS lo FROM s, (SELECT unnest(range(25)) AS k)),
ring AS (SELECT storm, CASE WHEN turn < 0 THEN k ELSE 49 - k END AS n, {_SIDE[0]} AS la, {_SIDE[1]} AS lo FROM axis, (VALUES (-90), (90)) AS t(turn)),
edge AS (SELECT a.storm, a.la AS la, a.lo AS lo, b.la AS lb, b.lo AS lp FROM ring a JOIN ring b ON a.storm = b.storm AND b.n = (a.n + 1) % 50),
hit AS (
  SELECT storm, place, any_value(p.lat) AS lat, any_value(p.lon) AS lon FROM [place] p JOIN edge e ON (la > p.lat) <> (lb > p.lat)
  WHERE p.lon < (lp - lo) * (p.lat - la) / (lb - la) + lo GROUP BY storm, place HAVING count(*) % 2 = 1
), along AS (
  SELECT storm, place, 111320 * ((lon - cx) * cos(radians(cy)) * sin(radians(brg)) + (lat - cy) * cos(radians(brg))) AS m FROM hit JOIN s USING (storm)
), eta AS (
  SELECT storm, place, greatest(0, m) / 20 / 60 AS eta_min FROM along WHERE m >= -2000 AND m <= 288000
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY storm ORDER BY eta_min, place))::INT AS position, count(*) OVER (PARTITION BY storm) AS n_towns FROM eta
) SELECT storm, place, round(eta_min, 4) AS eta_min, position, n_towns FROM r WHERE position <= 20""")
def _(x):
    s = x.d("polygon").select(F.col("poly").alias("storm"), F.col("cy").cast("double").alias("lat"), F.col("cx").cast("double").alias("lon"), (F.col("poly") * 14.0).alias("bearing"), F.lit(20.0).alias("mps"), F.lit(240.0).alias("minutes"))
    return P.storm_track(s, x.d("place")).withColumn("eta_min", F.round("eta_min", 4))


@query("a23_outlook_legend", "SELECT label, max(sort) AS sort, CASE WHEN arg_max(code, (sort, code)) LIKE 'CIG_' THEN right(arg_max(code, (sort, code)), 1)::INT END AS intensity FROM (SELECT p_brand AS label, p_size AS sort, CASE WHEN p_partkey % 2 = 0 THEN 'CIG' || p_partkey % 5 ELSE 'TSTM' END AS code FROM part) GROUP BY 1")
def _(x):
    a = x.t("part").select(F.col("p_brand").alias("label"), F.col("p_size").alias("sort"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("CIG"), (F.col("p_partkey") % 5).cast("string"))).otherwise("TSTM").alias("code"), F.lit("#fff").alias("fill"))
    return P.outlook_legend(a).select("label", "sort", "intensity")


@query("f13_outlook_style_by_step", "SELECT place, CASE WHEN place % 100 >= 70 THEN 'deep' WHEN place % 100 >= 40 THEN 'mid' WHEN place % 100 >= 33 THEN 'light' END AS style FROM [place]")
def _(x):
    style = x.spark.createDataFrame([("temp", 33, "light"), ("temp", 40, "mid"), ("temp", 70, "deep")], "category string, floor long, style string")
    return P.step_style(x.d("place").withColumn("category", F.lit("temp")), style, "category", F.col("place") % 100).select("place", "style")


@query("f13_outlook_styles", """SELECT place, CASE place % 12 WHEN 5 THEN 'Elevated' WHEN 8 THEN 'Critical' WHEN 10 THEN 'Extremely Critical' ELSE 'dn ' || (place % 12) END AS fire, CASE place % 12 WHEN 5 THEN 'rgb(230,152,0)' WHEN 8 THEN 'rgb(255,0,0)' WHEN 10 THEN 'rgb(230,0,169)' ELSE 'rgb(150,150,150)' END AS fill,
CASE WHEN place % 12 IN (4, 5) THEN 'Isolated Dry T-storm' WHEN place % 12 = 8 THEN 'Scattered Dry T-storm' ELSE 'dn ' || (place % 12) END AS dry, CASE place % 6 WHEN 1 THEN 'Marginal' WHEN 2 THEN 'Slight' WHEN 3 THEN 'Moderate' WHEN 4 THEN 'High' WHEN 5 THEN 'Own name' ELSE 'Level 0' END AS rain,
CASE place % 3 WHEN 0 THEN 'Above 40%' WHEN 1 THEN 'Below 40%' ELSE 'Near Normal' END AS chance, (CASE place % 3 WHEN 0 THEN 40 WHEN 1 THEN -40 ELSE 0 END)::INT AS chance_sort FROM [place]""")
def _(x):
    n = F.col("place")
    fire, dry = P.fire_style(n % 12), P.fire_style(n % 12, dry=True)
    rain = P.rain_style(n % 6, F.when(n % 6 == 5, "Own name"))
    chance = P.chance_label(F.when(n % 3 == 0, "Above").when(n % 3 == 1, "Below").otherwise("Normal"), F.lit(40))
    return x.d("place").select("place", fire["label"].alias("fire"), fire["fill"].alias("fill"), dry["label"].alias("dry"), rain["label"].alias("rain"), chance["label"].alias("chance"), chance["sort"].alias("chance_sort"))


_TO = lambda lat, lon, brg, d: (  # noqa: E731  latitude and longitude after d metres along a bearing
    f"degrees(asin(sin(radians({lat})) * cos({d} / 6371008.8) + cos(radians({lat})) * sin({d} / 6371008.8) * cos(radians({brg}))))",
    f"{lon} + degrees(atan2(sin(radians({brg})) * sin({d} / 6371008.8) * cos(radians({lat})), cos({d} / 6371008.8) - sin(radians({lat})) * (sin(radians({lat})) * cos({d} / 6371008.8) + cos(radians({lat})) * sin({d} / 6371008.8) * cos(radians({brg})))))",
)
_HEAD = "degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))))"
_SIDE = lambda turn: ", ".join(f"{e} AS {c}" for c, e in zip(("lat", "lon"), _TO("lat", "lon", f"(head + {turn})", "20000.0"), strict=True))


@query("g4_g5_rings", f"""WITH p AS (SELECT poly, k, cy + k * 0.5 + (k % 2) * 0.2 AS lat, cx + k * 0.7 AS lon FROM [polygon], (SELECT unnest(range(5)) AS k)),
h AS (SELECT poly, k, lat, lon, coalesce(lag(lat) OVER w, lat) AS lat1, coalesce(lag(lon) OVER w, lon) AS lon1, coalesce(lead(lat) OVER w, lat) AS lat2, coalesce(lead(lon) OVER w, lon) AS lon2 FROM p WINDOW w AS (PARTITION BY poly ORDER BY k)), c AS (SELECT *, {_HEAD} AS head FROM h),
corridor AS (SELECT poly, k AS pos, {_SIDE(-90)} FROM c UNION ALL SELECT poly, 9 - k, {_SIDE(90)} FROM c UNION ALL SELECT poly, 10, {_SIDE(-90)} FROM c WHERE k = 0),
swept AS (SELECT poly, k AS pos, lat, lon FROM p UNION ALL SELECT poly, 9 - k, {', '.join(f'{e} AS {c}' for c, e in zip(('lat', 'lon'), _TO('lat', 'lon', '(poly * 14.0)', '90000.0'), strict=True))} FROM p UNION ALL SELECT poly, 10, lat, lon FROM p WHERE k = 0),
axis AS (SELECT poly, k, 3000.0 * k AS d, {', '.join(f'{e} AS {c}' for c, e in zip(('lat', 'lon'), _TO('cy', 'cx', '(poly * 14.0)', '(3000.0 * k)'), strict=True))} FROM [polygon], (SELECT unnest(range(25)) AS k)),
cone AS (SELECT poly, k AS pos, {', '.join(f'{e} AS {c}' for c, e in zip(('lat', 'lon'), _TO('lat', 'lon', '(poly * 14.0 - 90)', '(4000 + 0.28 * d)'), strict=True))} FROM axis UNION ALL SELECT poly, 49 - k, {', '.join(f'{e} AS {c}' for c, e in zip(('lat', 'lon'), _TO('lat', 'lon', '(poly * 14.0 + 90)', '(4000 + 0.28 * d)'), strict=True))} FROM axis
UNION ALL SELECT poly, 50, {', '.join(f'{e} AS {c}' for c, e in zip(('lat', 'lon'), _TO('lat', 'lon', '(poly * 14.0 - 90)', '(4000 + 0.28 * d)'), strict=True))} FROM axis WHERE k = 0)
SELECT 'corridor' AS ring, poly, pos::INT AS pos, round(lat, 6) AS lat, round(lon, 6) AS lon FROM corridor UNION ALL SELECT 'swept', poly, pos::INT, round(lat, 6), round(lon, 6) FROM swept UNION ALL SELECT 'cone', poly, pos::INT, round(lat, 6), round(lon, 6) FROM cone""")
def _(x):
    poly = x.d("polygon").withColumns({"cx": F.col("cx").cast("double"), "cy": F.col("cy").cast("double")})
    path = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct((F.col("cy") + k * 0.5 + (k % 2) * 0.2).alias("lat"), (F.col("cx") + k * 0.7).alias("lon")))
    brg = F.col("poly") * 14.0
    rings = {"corridor": P.corridor_ring(path, 20_000.0), "swept": P.swept_footprint(path, brg, F.lit(90_000.0)), "cone": P.storm_cone(F.col("cy"), F.col("cx"), brg, F.lit(72_000.0))}
    out = None
    for name, ring in rings.items():
        one = poly.select(F.lit(name).alias("ring"), "poly", F.posexplode(F.transform(ring, lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon")))).alias("pos", "v"))
        one = one.select("ring", "poly", "pos", F.round("v.lat", 6).alias("lat"), F.round("v.lon", 6).alias("lon"))
        out = one if out is None else out.unionAll(one)
    return out


@query("w19_motion_between", """WITH l AS (SELECT user_id, event_id, value, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
SELECT user_id, event_id, round(CASE WHEN us > before THEN least(250, greatest(1, value * 500 / 1609.344 / ((us - before) / 3600000000))) END, 5) AS mph FROM l WHERE us > before""")
def _(x):
    e = x.t("events").select("user_id", "event_id", F.col("ts").alias("time"), "value")
    return S.motion_between(e, "user_id", "time", F.col("value") * 500).filter(F.col("mph").isNotNull()).select("user_id", "event_id", F.round("mph", 5).alias("mph"))


@query("u1_union_of_agencies", "SELECT place AS id, 'A' AS agency FROM [place] WHERE place % 2 = 0 UNION ALL SELECT place, 'B' FROM [place] WHERE place % 2 = 1 AND place % 3 <> 0")
def _(x):
    p = x.d("place").select(F.col("place").alias("id"), F.when(F.col("place") % 3 == 0, "AL").otherwise("WP").alias("basin"))
    return P.union_storms(p.filter("id % 2 = 0").withColumn("agency", F.lit("A")), p.filter("id % 2 = 1").withColumn("agency", F.lit("B")), ["AL"]).select("id", "agency")
