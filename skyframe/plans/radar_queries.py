"""Queries of skyframe.operators.radar."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import geo as G
from skyframe.functions.weather import encode_gate
from skyframe.operators import radar as R
from skyframe.plans.base import query

SWEEPS = "SELECT o_custkey % 20 AS site, o_orderkey AS volume, (o_orderkey % 97) * 0.05 + 0.5 AS elevation, o_orderdate AS time FROM orders"


def _radials(x):
    """A volume per order: radials by line with a REF and, for some, a VEL moment."""
    l = x.t("lineitem")  # noqa: E741
    raw = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.col("l_partkey") + k * 7) % 60).cast("int"))
    m = lambda first: F.struct(F.lit(8).alias("gate_count"), F.lit(first).alias("first_gate"), F.lit(250).alias("gate_spacing"), F.lit(2.0).alias("scale"), F.lit(66.0).alias("offset"), raw.alias("raw"))
    both = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("REF"), m(500), F.lit("VEL"), m(-375))).otherwise(F.create_map(F.lit("REF"), m(500)))
    return l.select(F.col("l_orderkey").alias("volume"), (F.col("l_linenumber") % 3).alias("elevation_number"), (0.5 + F.col("l_linenumber") % 3).alias("elevation"), F.col("l_linenumber").alias("azimuth_number"), (F.col("l_partkey") % 360 + F.col("l_linenumber") / 10).alias("azimuth"), F.lit(0.5).alias("azimuth_spacing"), F.col("l_shipdate").alias("time"), both.alias("moments"))


@query("p3_p4_explode_gates", """SELECT l_orderkey AS volume, l_linenumber AS azimuth_number, k::INT AS gate, (-375 + k * 250)::INT AS range_m, CASE WHEN code >= 2 THEN (code - 66) / 2.0::DOUBLE END AS value
FROM (SELECT l_orderkey, l_linenumber, k, (l_partkey + k * 7) % 60 AS code FROM lineitem, (SELECT unnest(range(8)) AS k) WHERE l_linenumber % 2 = 0)""")
def _(x):
    return R.explode_gates(_radials(x), "VEL").select("volume", "azimuth_number", "gate", "range_m", "value")


@query("a1_build_sweeps", """SELECT l_orderkey AS volume, l_linenumber % 3 AS elevation_number, min(0.5 + l_linenumber % 3)::DOUBLE AS elevation, CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 'REF,VEL' ELSE 'REF' END AS moments, true AS super_res, count(*) AS n_radials
FROM lineitem GROUP BY 1, 2""")
def _(x):
    return R.build_sweeps(_radials(x)).select("volume", "elevation_number", F.col("elevation").cast("double").alias("elevation"), F.array_join("moments", ",").alias("moments"), "super_res", "n_radials")


@query("p5_site_backfill", """WITH f AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 150 END AS icao, event_id % 120 AS key_id FROM events), s AS (SELECT * FROM [site])
SELECT event_id, coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon FROM f LEFT JOIN s a ON f.icao = a.site LEFT JOIN s b ON f.key_id = b.site""")
def _(x):
    f = x.t("events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 150).alias("icao"), (F.col("event_id") % 120).alias("key_id"), F.lit(None).cast("long").alias("lat"), F.lit(None).cast("long").alias("lon"))
    return R.with_site(f, x.d("site")).select("event_id", "lat", "lon")


@query("a2_sweep_max_range", "SELECT sweep, max(range_m) AS max_range_m FROM [gate] GROUP BY 1")
def _(x):
    return R.sweep_max_range(x.d("gate"), ["sweep"])


@query("a3_azimuth_spacing", """WITH a AS (SELECT DISTINCT sweep, azimuth FROM [gate]), g AS (SELECT sweep, azimuth - lag(azimuth) OVER (PARTITION BY sweep ORDER BY azimuth) AS gap FROM a UNION ALL SELECT sweep, min(azimuth) + 360 - max(azimuth) FROM a GROUP BY 1)
SELECT sweep, round(quantile_cont(gap, 0.5) FILTER (WHERE gap > 0.01 AND gap <= 5), 6) AS spacing FROM g GROUP BY 1""")
def _(x):
    return R.azimuth_spacing(x.d("gate"), ["sweep"]).withColumn("spacing", F.round("spacing", 6))


@query("a4_describe_resolution", """WITH s AS (SELECT sweep, azimuth, gate, range_m, (range_m - lag(range_m) OVER w)::DOUBLE / (gate - lag(gate) OVER w) AS step FROM [gate] WINDOW w AS (PARTITION BY sweep, azimuth ORDER BY gate))
SELECT sweep, count(*) AS n_gates, count(DISTINCT azimuth) AS n_radials, quantile_cont(step, 0.5) AS gate_spacing, max(range_m) AS max_range_m FROM s GROUP BY 1""")
def _(x):
    return R.describe_resolution(x.d("gate"), ["sweep"]).select("sweep", "n_gates", "n_radials", "gate_spacing", "max_range_m")


@query("a5_legacy_pooling", f"SELECT *, {encode_gate.sql('value', 2, 66, 255)} AS code FROM (SELECT sweep, floor(azimuth + 1e-6) % 360 + 0.5 AS azimuth, floor((range_m - 2000) / 1000 + 1e-6)::BIGINT AS gate, round(avg(value), 6) AS value FROM [gate] WHERE value IS NOT NULL GROUP BY 1, 2, 3)")
def _(x):
    return R.pool_legacy(x.d("gate"), ["sweep"], 1000.0, 2000.0).withColumn("value", F.round("value", 6)).withColumn("azimuth", F.col("azimuth").cast("double"))


VAD = """SELECT sweep, (vs * cc - vc * sc) / (ss * cc - sc * sc) AS u, (vc * ss - vs * sc) / (ss * cc - sc * sc) AS v FROM (SELECT sweep, sum(pow(sin(radians(azimuth)), 2)) AS ss, sum(pow(cos(radians(azimuth)), 2)) AS cc, sum(sin(radians(azimuth)) * cos(radians(azimuth))) AS sc,
sum(value * sin(radians(azimuth))) AS vs, sum(value * cos(radians(azimuth))) AS vc FROM [gate] WHERE gate % 4 = 0 AND value IS NOT NULL GROUP BY 1)"""


@query("a6_vad_fit", f"SELECT sweep, round(u, 6) AS u, round(v, 6) AS v FROM ({VAD})")
def _(x):
    return R.vad_fit(x.d("gate"), ["sweep"]).select("sweep", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("w6_storm_relative_velocity", f"SELECT sweep, g.azimuth, gate, round(value - f.u * sin(radians(g.azimuth)) - f.v * cos(radians(g.azimuth)), 5) AS value FROM [gate] g JOIN ({VAD}) f USING (sweep)")
def _(x):
    return R.storm_relative(x.d("gate"), ["sweep"]).select("sweep", "azimuth", "gate", F.round("value", 5).alias("value"))


@query("w1_kdp", """SELECT sweep, azimuth, gate, floor((((lead(value, 4) OVER w - lag(value, 4) OVER w + 180) % 360 + 360) % 360 - 180) / 4 * 100 + 0.5) / 100 AS kdp FROM [gate] WINDOW w AS (PARTITION BY sweep, azimuth ORDER BY gate)""")
def _(x):
    return R.kdp(x.d("gate"), ["sweep"]).select("sweep", "azimuth", "gate", "kdp")


@query("w2_w5_dealias")
def _(x):
    return R.dealias(x.d("gate"), ["sweep"], F.lit(6.0)).select("sweep", "azimuth", "gate", "unfolded")


@query("w5_find_runs", "SELECT sweep, azimuth, min(gate) AS first, max(gate) AS last, count(*) AS n FROM (SELECT *, gate - row_number() OVER (PARTITION BY sweep, azimuth ORDER BY gate) AS k FROM [gate] WHERE abs(value) >= 5) GROUP BY sweep, azimuth, k")
def _(x):
    return R.find_runs(x.d("gate"), ["sweep"], F.abs(F.col("value")) >= 5)


def _sweeps(x):
    return x.t("orders").select((F.col("o_custkey") % 20).alias("site"), F.col("o_orderkey").alias("volume"), ((F.col("o_orderkey") % 97) * 0.05 + 0.5).cast("double").alias("elevation"), F.col("o_orderdate").alias("time"))


@query("w14_pick_sweep", f"""WITH s AS ({SWEEPS}), d AS (SELECT *, abs(elevation - 2.4) AS d, min(abs(elevation - 2.4)) OVER (PARTITION BY site) AS best FROM s)
SELECT site, round(elevation::DOUBLE, 4) AS elevation, strftime(time, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY time DESC, d, elevation) r FROM d WHERE d <= best + 0.1001) WHERE r = 1""")
def _(x):
    return R.pick_sweep(_sweeps(x), ["site"], 2.4, 0.1001).select("site", F.round("elevation", 4).alias("elevation"), F.date_format("time", "yyyy-MM-dd").alias("day"))


@query("w13_w15_a17_tilt_sets", """WITH RECURSIVE s AS (SELECT o_custkey % 20 AS site, o_orderkey AS volume, (o_orderkey % 97) * 0.05::DOUBLE + 0.5::DOUBLE AS e, o_orderdate AS time FROM orders),
f AS (SELECT site, e, time, row_number() OVER (PARTITION BY site ORDER BY e) AS k FROM (SELECT site, e, max(time) AS time FROM s GROUP BY 1, 2)),
t AS (SELECT site, k, e, time, 1 AS n, e AS head FROM f WHERE k = 1 UNION ALL SELECT f.site, f.k, CASE WHEN f.e - t.e <= 0.1::DOUBLE AND f.time <= t.time THEN t.e ELSE f.e END, CASE WHEN f.e - t.e <= 0.1::DOUBLE THEN greatest(f.time, t.time) ELSE f.time END,
 CASE WHEN f.e - t.e <= 0.1::DOUBLE THEN t.n ELSE t.n + 1 END, CASE WHEN f.e - t.head > 0.15::DOUBLE THEN f.e ELSE t.head END FROM t JOIN f ON f.site = t.site AND f.k = t.k + 1),
c AS (SELECT s.site, t.head, s.time FROM s JOIN f USING (site, e) JOIN t ON t.site = f.site AND t.k = f.k), ct AS (SELECT site, min(newest) AS cut FROM (SELECT site, head, max(time) AS newest FROM c GROUP BY 1, 2) GROUP BY 1),
co AS (SELECT c.site, count(DISTINCT head) AS n_coherent, max(time) AS cut FROM c JOIN ct ON c.site = ct.site AND c.time <= ct.cut GROUP BY 1),
vf AS (SELECT site, v, e, row_number() OVER (PARTITION BY site, v ORDER BY e) AS k FROM (SELECT DISTINCT site, volume % 9 AS v, e FROM s)),
vt AS (SELECT site, v, k, e AS last, 1 AS n FROM vf WHERE k = 1 UNION ALL SELECT vf.site, vf.v, vf.k, CASE WHEN vf.e - vt.last > 0.1::DOUBLE THEN vf.e ELSE vt.last END, CASE WHEN vf.e - vt.last > 0.1::DOUBLE THEN vt.n + 1 ELSE vt.n END FROM vt JOIN vf ON vf.site = vt.site AND vf.v = vt.v AND vf.k = vt.k + 1),
sc AS (SELECT site, v, max(n) * 100 + (SELECT max(e) FROM vf WHERE vf.site = vt.site AND vf.v = vt.v) AS score, row_number() OVER (PARTITION BY site ORDER BY v DESC) AS r FROM vt GROUP BY site, v),
full_ AS (SELECT site, arg_max(v, (score, v)) AS volume, max(score) AS score FROM sc WHERE r <= 6 GROUP BY 1)
SELECT site, max(n)::BIGINT AS n_tilts, any_value(n_coherent) AS n_coherent, strftime(any_value(co.cut), '%Y-%m-%d') AS cut, any_value(volume) AS volume, round(any_value(score), 4) AS score FROM t JOIN co USING (site) JOIN full_ USING (site) GROUP BY 1""")
def _(x):
    s = _sweeps(x)
    kept = R.dedupe_tilts(s, ["site"]).groupBy("site").agg(F.count("*").alias("n_tilts"))
    coherent = R.coherent_tilts(s, ["site"]).groupBy("site").agg(F.count("*").alias("n_coherent"), F.max("time").alias("cut"))
    full = R.fullest_volume(s.withColumn("volume", F.col("volume") % 9), "site", "volume")
    both = kept.join(coherent.hint("merge"), "site").join(full.hint("merge"), "site")
    return both.select("site", "n_tilts", "n_coherent", F.date_format("cut", "yyyy-MM-dd").alias("cut"), "volume", F.round("score", 4).alias("score"))


@query("w16_regrid_azimuth", """WITH b AS (SELECT DISTINCT sweep, floor(azimuth / 3) * 3 + azimuth % 3 / 3 AS azimuth FROM [gate]), r AS (SELECT sweep, azimuth, azimuth + o AS at FROM b, (VALUES (-360), (0), (360)) t(o)), k AS (SELECT s.sweep, n AS bin, (n + 0.5) * 0.25 AS c FROM (SELECT DISTINCT sweep FROM b) s, (SELECT unnest(range(1440)) AS n) t),
lo AS (SELECT k.sweep, bin, c, r.at, r.azimuth FROM k ASOF LEFT JOIN r ON k.sweep = r.sweep AND k.c >= r.at), hi AS (SELECT k.sweep, bin, r.at, r.azimuth FROM k ASOF LEFT JOIN r ON k.sweep = r.sweep AND k.c <= r.at)
SELECT lo.sweep, lo.bin::INT AS bin, CASE WHEN c - lo.at <= hi.at - c AND c - lo.at <= 1.5 THEN lo.azimuth WHEN hi.at - c < c - lo.at AND hi.at - c <= 1.5 THEN hi.azimuth END AS azimuth FROM lo JOIN hi USING (sweep, bin)""")
def _(x):
    """All beams, drawn together to a third of the circle, so that bins between them are nearer and farther than the limit."""
    a = F.col("azimuth")
    return R.regrid_azimuth(x.d("gate").withColumn("azimuth", F.floor(a / 3) * 3 + a % 3 / 3), ["sweep"])


# Beams of half-degree azimuth bins, and points by bin, distance and gate from a site.
_BEAMS = """b AS (SELECT DISTINCT sweep, azimuth FROM [gate]), r AS (SELECT sweep, azimuth, azimuth + o AS at FROM b, (VALUES (-360), (0), (360)) t(o)), k AS (SELECT s.sweep, n AS bin, (n + 0.5::DOUBLE) * 0.5::DOUBLE AS c FROM (SELECT DISTINCT sweep FROM b) s, (SELECT unnest(range(720)) AS n) t),
lo AS (SELECT k.sweep, bin, c, r.at, r.azimuth FROM k ASOF LEFT JOIN r ON k.sweep = r.sweep AND k.c >= r.at), hi AS (SELECT k.sweep, bin, r.at, r.azimuth FROM k ASOF LEFT JOIN r ON k.sweep = r.sweep AND k.c <= r.at),
beams AS (SELECT lo.sweep, lo.bin, CASE WHEN c - lo.at <= hi.at - c AND c - lo.at <= GAP THEN lo.azimuth WHEN hi.at - c < c - lo.at AND hi.at - c <= GAP THEN hi.azimuth END AS azimuth FROM lo JOIN hi USING (sweep, bin)),
p0 AS (SELECT place, (lon / 500.0::DOUBLE - 97 + 97.15) * 111320 * cos(radians(38.05)) AS east, (lat / 500.0::DOUBLE + 38 - 38.05) * 111320 AS north FROM [place]),
p AS (SELECT place, sqrt(east * east + north * north) AS dist, floor(CASE WHEN degrees(atan2(east, north)) < 0 THEN degrees(atan2(east, north)) + 360 ELSE degrees(atan2(east, north)) END * 2) AS bin FROM p0)"""


@query("j5_sample_radar", f"""WITH {_BEAMS.replace('GAP', '360')} SELECT place, g.sweep, g.azimuth, g.value FROM p JOIN beams USING (bin) JOIN [gate] g ON g.sweep = beams.sweep AND g.azimuth = beams.azimuth AND g.gate = floor((dist - 2000) / 250 + 0.5)""")
def _(x):
    p = x.d("place").select("place", (F.col("lon") / 500 - 97).alias("lon"), (F.col("lat") / 500 + 38).alias("lat"))
    return R.sample_radar(p, x.d("gate"), ["sweep"], 38.05, -97.15, 2000.0, 250.0).select("place", "sweep", "azimuth", "value")


@query("j14_m22_gate_exceedance", """WITH g AS (SELECT sweep, azimuth, gate, value, floor((-97.0 + range_m * sin(radians(azimuth)) / (111320 * cos(radians(38.0))) + 97.3) / 0.01 + 0.5)::BIGINT AS i, floor((38.3 - (38.0 + range_m * cos(radians(azimuth)) / 111320)) / 0.01 + 0.5)::BIGINT AS j FROM [gate])
SELECT sweep, azimuth, gate, g.i, g.j, floor((g.value - c.value / 100) * 10 + 0.5) / 10 AS exceed FROM g JOIN [cell] c ON g.i = c.i AND g.j = c.j WHERE g.value - c.value / 100 >= 0.25""")
def _(x):
    at = R.gates_to_cells(x.d("gate"), 38.0, -97.0, -97.3, 38.3, 0.01)
    return R.gate_exceedance(at, x.d("cell").withColumn("value", F.col("value") / 100)).select("sweep", "azimuth", "gate", "i", "j", "exceed")


@query("r11_cross_section", f"""WITH {_BEAMS.replace('GAP', '1.6')}, q AS (SELECT place AS col, beams.sweep, beams.azimuth, greatest(dist, 2) AS dist_m, {G.slant_range.sql('greatest(dist, 2)', '0.5 + beams.sweep')} AS slant FROM p JOIN beams USING (bin) WHERE azimuth IS NOT NULL)
SELECT col, q.sweep, round(dist_m, 3) AS dist_m, round({G.beam_height.sql('slant', '0.5 + q.sweep')}, 3) AS height_m, g.value FROM q LEFT JOIN [gate] g ON g.sweep = q.sweep AND g.azimuth = q.azimuth AND g.gate = floor((slant - 2000) / 250 + 0.5)""")
def _(x):
    cols = x.d("place").select(F.col("place").alias("col"), (F.col("lon") / 500 - 97).alias("lon"), (F.col("lat") / 500 + 38).alias("lat"))
    out = R.cross_section(x.d("gate"), cols, ["sweep"], 38.05, -97.15, 2000.0, 250.0, (0.5 + F.col("sweep")).cast("double"))
    return out.select("col", "sweep", F.round("dist_m", 3).alias("dist_m"), F.round("height_m", 3).alias("height_m"), "value")


@query("u5_available_products", "SELECT l_orderkey AS volume, CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 'REF,VEL' ELSE 'REF' END AS products FROM lineitem GROUP BY 1")
def _(x):
    s = R.build_sweeps(_radials(x), ["volume"]).withColumn("terminal", F.col("volume") % 2 == 0)
    return R.available_products(s, {"REF": "REF", "VEL": "VEL", "ZDR": "ZDR"}).select("volume", F.array_join("products", ",").alias("products"))


@query("g9_range_rings", "SELECT site, ring_m::DOUBLE AS ring_m, 73 AS vertices, round(lat + degrees(ring_m / 6371008.8), 4) AS north FROM [site], (VALUES (100000), (200000), (300000), (400000)) t(ring_m)")
def _(x):
    out = R.range_rings(x.d("site"), 460_000.0)
    return out.select("site", "ring_m", F.size("ring").alias("vertices"), F.round(F.array_max(F.transform("ring", lambda p: p["lat"])), 4).alias("north"))
