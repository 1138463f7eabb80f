"""Queries of grid operators over many fields at once: a run of 12 x 12 cells for each supplier, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyframe.operators import colours, playback, products, shapes
from skyframe.operators import grid as A
from skyframe.operators import radar as R
from skyframe.operators import satellite as S
from skyframe.plans.base import query
from skyframe.sources import catalog as C
from skyframe.sources.shared import shared_dir

N = 12
DENSE = """(SELECT r.run, i, j, value FROM (SELECT DISTINCT run FROM [run_cell]) r CROSS JOIN (SELECT unnest(range(12)) AS i) a
  CROSS JOIN (SELECT unnest(range(12)) AS j) b LEFT JOIN [run_cell] c USING (run, i, j))"""


@query("w7_w8_w11_boxes_of_runs", f"""
WITH d AS {DENSE}, b AS (
  SELECT a.run, a.i, a.j, a.value, avg(b.value) FILTER (WHERE b.value < 60) AS mean, coalesce(sum(b.value), 0) AS sum, count(b.value) AS n,
         max(b.value) AS mx, min(b.value) AS mn,
         max(b.value) FILTER (WHERE greatest(abs(a.i - b.i), abs(a.j - b.j)) = 1) AS emx,
         min(b.value) FILTER (WHERE greatest(abs(a.i - b.i), abs(a.j - b.j)) = 1) AS emn
  FROM d a JOIN d b ON a.run = b.run AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL
)
SELECT run, i, j, round(mean, 6) AS mean, sum::DOUBLE AS sum,
       CASE WHEN n = 9 AND value >= mx AND value - emx >= 2 AND value >= 60 THEN 'H' WHEN n = 9 AND value <= mn AND emn - value >= 2 AND value < 60 THEN 'L' END AS kind
FROM b""")
def _(x):
    c = x.d("run_cell")
    mean = A.box_mean(c, N, N, 1, 60, ["run"]).select("run", "i", "j", F.round("mean", 6).alias("mean"))
    total = A.box_sum(c, N, N, 1, ["run"]).select("run", "i", "j", F.col("sum").cast("double").alias("sum"))
    centers = A.pressure_centers(c, N, N, 1, 2, 60, ["run"]).select("run", "i", "j", "kind")
    on = ["run", "i", "j"]
    return mean.join(total.hint("merge"), on).join(centers.hint("merge"), on, "left")


@query("w26_smooth_of_runs", f"""
WITH d AS {DENSE}, w AS (
  SELECT a.run, a.i, a.j, exp(-((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) / 2.88) AS g, coalesce(b.value / 1000, -0.6) AS x
  FROM d a JOIN d b ON a.run = b.run AND abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3
) SELECT run, i, j, round(sum(g * x) / sum(g), 6) AS smooth FROM w GROUP BY ALL""")
def _(x):
    out = A.gaussian_smooth(x.d("run_cell"), N, N, 1.2, 0, 1000, by=["run"])
    return out.select("run", "i", "j", F.round("smooth", 6).alias("smooth"))


@query("w12_centers_of_runs", f"""
WITH RECURSIVE d AS {DENSE}, b AS (
  SELECT a.run, a.i, a.j, a.value, count(b.value) AS n, max(b.value) AS mx, min(b.value) AS mn,
         max(b.value) FILTER (WHERE greatest(abs(a.i - b.i), abs(a.j - b.j)) = 1) AS emx,
         min(b.value) FILTER (WHERE greatest(abs(a.i - b.i), abs(a.j - b.j)) = 1) AS emn
  FROM d a JOIN d b ON a.run = b.run AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL
), c AS (
  SELECT run, CASE WHEN value >= 60 THEN 'H' ELSE 'L' END AS kind, i, j, CASE WHEN value >= 60 THEN value - emx ELSE emn - value END AS score
  FROM b WHERE n = 9 AND (value >= mx AND value - emx >= 2 AND value >= 60 OR value <= mn AND emn - value >= 2 AND value < 60)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY score DESC, j, i) AS k FROM c
), g AS (
  SELECT run, kind, 0::BIGINT AS k, []::STRUCT(i BIGINT, j BIGINT)[] AS kept FROM (SELECT DISTINCT run, kind FROM o)
  UNION ALL
  SELECT o.run, o.kind, o.k, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda p: (p.i - o.i) * (p.i - o.i) + (p.j - o.j) * (p.j - o.j) < 25)) = 0
                             THEN list_append(kept, struct_pack(i := o.i::BIGINT, j := o.j::BIGINT)) ELSE kept END
  FROM g JOIN o ON o.run = g.run AND o.kind = g.kind AND o.k = g.k + 1
)
SELECT run, kind, p.i AS i, p.j AS j FROM (SELECT run, kind, unnest(kept) AS p FROM (SELECT run, kind, arg_max(kept, k) AS kept FROM g GROUP BY ALL))""")
def _(x):
    centers = A.pressure_centers(x.d("run_cell"), N, N, 1, 2, 60, ["run"])
    return A.suppress_nearby(centers, ["run", "kind"], "score", "i", "j", 5, 3).select("run", "kind", "i", "j")


_CORNERS = f"""d AS {DENSE}, w AS (
  SELECT *, lead(value) OVER (PARTITION BY run, j ORDER BY i) AS b, lead(value) OVER (PARTITION BY run, i ORDER BY j) AS d FROM d
), q AS (
  SELECT run, i, j, value AS a, b, d, lead(b) OVER (PARTITION BY run, i ORDER BY j) AS c FROM w
), l AS (
  SELECT *, unnest(range(greatest(ceil(least(a, b, c, d) / 25)::BIGINT, 1), floor(greatest(a, b, c, d) / 25)::BIGINT + 1)) * 25.0::DOUBLE AS level
  FROM q WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL
), k AS (
  SELECT *, (a >= level)::INT * 8 + (b >= level)::INT * 4 + (c >= level)::INT * 2 + (d >= level)::INT AS code,
         struct_pack(x := i + (level - a) / nullif(b - a, 0), y := j::DOUBLE) AS t, struct_pack(x := i + 1.0::DOUBLE, y := j + (level - b) / nullif(c - b, 0)) AS r,
         struct_pack(x := i + (level - d) / nullif(c - d, 0), y := j + 1.0::DOUBLE) AS o, struct_pack(x := i::DOUBLE, y := j + (level - a) / nullif(d - a, 0)) AS f
  FROM l
), sides(code, p, q) AS (
  VALUES (1, 'f', 'o'), (14, 'f', 'o'), (2, 'o', 'r'), (13, 'o', 'r'), (3, 'f', 'r'), (12, 'f', 'r'), (4, 't', 'r'), (11, 't', 'r'), (6, 't', 'o'), (9, 't', 'o'),
         (7, 'f', 't'), (8, 'f', 't'), (5, 'f', 't'), (5, 'o', 'r'), (10, 'f', 'o'), (10, 't', 'r')
), seg AS (
  SELECT run, level, CASE p WHEN 't' THEN t WHEN 'r' THEN r WHEN 'o' THEN o ELSE f END AS p, CASE q WHEN 't' THEN t WHEN 'r' THEN r WHEN 'o' THEN o ELSE f END AS q
  FROM k JOIN sides USING (code)
)"""


@query("m33_segments_of_runs", f"WITH {_CORNERS} SELECT run, level, round(p.x, 6) AS x1, round(p.y, 6) AS y1, round(q.x, 6) AS x2, round(q.y, 6) AS y2 FROM seg")
def _(x):
    """Every segment of every level of every run."""
    s = A.contour_segments(x.d("run_cell"), N, N, 25.0, 25.0, ["run"])
    return s.select("run", "level", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


#: Values off the levels: no line forks then, so the points of a line are all that are connected with its least one.
@query("m34_lines_of_runs", f"""
WITH RECURSIVE {_CORNERS.replace(" j, value FROM", " j, value + 0.37 AS value FROM")}, e AS (
  SELECT run, level, round(p.x, 4) * 10000000 + round(p.y, 4) AS a, round(q.x, 4) * 10000000 + round(q.y, 4) AS b FROM seg
), both_ AS (SELECT run, level, a, b FROM e UNION SELECT run, level, b, a FROM e
), reach AS (SELECT run, level, a AS home, a AS here FROM both_ UNION SELECT r.run, r.level, home, b FROM reach r JOIN both_ USING (run, level) WHERE both_.a = r.here
), line AS (SELECT run, level, home, min(here) AS least FROM reach GROUP BY ALL
), sizes AS (SELECT run, level, least, count(*) AS n FROM line GROUP BY ALL)
SELECT run, level, sum(n)::BIGINT AS points, count(*) AS lines FROM sizes WHERE n >= 4 GROUP BY ALL""")
def _(x):
    """Contour lines of some thousands of fields (run, level). Points of a closed line count once."""
    lines = A.contour_lines(A.contour_segments(x.d("run_cell").withColumn("value", F.col("value") + 0.37), N, N, 25.0, 25.0, ["run"]), ["run", "level"])
    points = F.size(F.array_distinct("points"))
    return lines.filter(points >= 4).groupBy("run", "level").agg(F.sum(points).cast("long").alias("points"), F.count("*").alias("lines"))


@query("j3_unlike_grids_of_runs", """
WITH g AS (SELECT DISTINCT run, -110.0::DOUBLE + run % 3 AS lon1, 45.0::DOUBLE AS lat1, 1.0::DOUBLE AS d, -110.0::DOUBLE + CASE WHEN run % 4 = 0 THEN run % 3 + 0.00005 ELSE 0.7 END AS lon2,
       CASE WHEN run % 4 = 0 THEN 45.0::DOUBLE ELSE 44.2::DOUBLE END AS lat2, CASE WHEN run % 4 = 0 THEN 1.0::DOUBLE ELSE 1.3::DOUBLE END AS d2 FROM [run_cell]),
b AS (SELECT run, i, j, value * 2 AS value FROM [run_cell]),
m AS (SELECT c.*, CASE WHEN run % 4 = 0 THEN i ELSE floor((lon1 + i * d - lon2) / d2 + 0.5) END AS bi, CASE WHEN run % 4 = 0 THEN j ELSE floor((lat2 - (lat1 - j * d)) / d2 + 0.5) END AS bj
      FROM [run_cell] c JOIN g USING (run))
SELECT m.run, m.i, m.j, m.value AS a, b.value AS b FROM m LEFT JOIN b ON b.run = m.run AND b.i = bi AND b.j = bj AND bi BETWEEN 0 AND 11 AND bj BETWEEN 0 AND 11""")
def _(x):
    """A quarter of the runs has grids that agree within the tolerance, the others have other origins and steps."""
    c = x.d("run_cell")
    like = F.col("run") % 4 == 0
    runs = c.select("run").distinct()
    shape = lambda lon, lat, step: runs.select("run", lon.alias("lon1"), lat.alias("lat1"), step.alias("di"), step.alias("dj"), F.lit(N).alias("ni"), F.lit(N).alias("nj"))
    west = F.lit(-110.0) + F.col("run") % 3
    a = shape(west, F.lit(45.0), F.lit(1.0))
    b = shape(F.when(like, west + 0.00005).otherwise(-109.3), F.when(like, 45.0).otherwise(44.2), F.when(like, 1.0).otherwise(1.3))
    return A.align_unlike(c, c.withColumn("value", F.col("value") * 2), a, b, ["run"])


@query("g11_lambert_grids_of_runs", """
WITH g AS (SELECT DISTINCT run, -110.0::DOUBLE + run % 5 AS lo1, 30.0::DOUBLE AS la1, radians(38.5) AS p1, radians(CASE WHEN run % 2 = 0 THEN 38.5 ELSE 45 END) AS p2,
                  -97.5::DOUBLE AS lov, radians(38.5) AS p0 FROM [run_cell]),
n AS (SELECT *, CASE WHEN abs(p1 - p2) < 1e-9 THEN sin(p1) ELSE ln(cos(p1) / cos(p2)) / ln(tan(pi() / 4 + p2 / 2) / tan(pi() / 4 + p1 / 2)) END AS n FROM g),
f AS (SELECT *, 6371229 * cos(p1) * pow(tan(pi() / 4 + p1 / 2), n) / n AS rf FROM n),
r AS (SELECT *, rf / pow(tan(pi() / 4 + p0 / 2), n) AS r0 FROM f),
o AS (SELECT *, rf / pow(tan(pi() / 4 + radians(la1) / 2), n) * sin(n * radians(lo1 - lov)) AS x0, r0 - rf / pow(tan(pi() / 4 + radians(la1) / 2), n) * cos(n * radians(lo1 - lov)) AS y0 FROM r),
b AS (SELECT o.*, x0 + i * 100000 AS x, r0 - (y0 + j * 100000) AS y FROM o, (VALUES (0, 0), (8, 0), (0, 11), (8, 11), (11, 0), (0, 8), (11, 8)) AS t(i, j)),
ll AS (SELECT *, lov + degrees(atan2(x, y) / n) AS lon, degrees(2 * atan(pow(rf / (sign(n) * sqrt(x * x + y * y)), 1 / n))) - 90 AS lat FROM b),
box AS (SELECT run, any_value(n) AS n, any_value(rf) AS rf, any_value(r0) AS r0, any_value(x0) AS x0, any_value(y0) AS y0, any_value(lov) AS lov,
        min(lon) - 0.05 AS w, max(lat) + 0.05 AS t, ceil((max(lon) - min(lon) + 0.1) / 0.5)::INT AS ni, ceil((max(lat) - min(lat) + 0.1) / 0.5)::INT AS nj FROM ll GROUP BY run),
tj AS (SELECT *, unnest(range(nj)) AS tj FROM box), c AS (SELECT *, unnest(range(ni)) AS ti FROM tj),
geo AS (SELECT *, w + ti * 0.5 AS lon, t - tj * 0.5 AS lat FROM c),
xy AS (SELECT *, rf / pow(tan(pi() / 4 + radians(lat) / 2), n) AS rr, n * radians(lon - lov) AS th FROM geo)
SELECT xy.run, ti::INT AS ti, tj::INT AS tj, round(lon, 6) AS lon, round(lat, 6) AS lat, s.value FROM xy LEFT JOIN [run_cell] s
  ON s.run = xy.run AND s.i = floor((rr * sin(th) - x0) / 100000 + 0.5)::BIGINT AND s.j = floor((r0 - rr * cos(th) - y0) / 100000 + 0.5)::BIGINT""")
def _(x):
    """Each run's box comes from its own border cells; half of the runs have a cone of two parallels."""
    c = x.d("run_cell")
    lit = {"ni": F.lit(N), "nj": F.lit(N), "dx": F.lit(100000.0), "dy": F.lit(100000.0), "la1": F.lit(30.0), "latin1": F.lit(38.5), "lov": F.lit(-97.5), "lad": F.lit(38.5)}
    grids = c.select("run").distinct().withColumns({**lit, "lo1": F.lit(-110.0) + F.col("run") % 5, "latin2": F.when(F.col("run") % 2 == 0, 38.5).otherwise(45.0)})
    out = A.resample_lambert(c, grids, 0.5, ["run"])
    return out.select("run", "ti", "tj", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "value")


@query("j14_m22_exceedance_of_runs", """
WITH g AS (SELECT l_suppkey AS run, l_orderkey % 72 * 5.0::DOUBLE AS azimuth, l_partkey % 40 AS gate, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT *, floor((-97.0 + (2000 + gate * 250) * sin(radians(azimuth)) / (111320 * cos(radians(38.0))) + 97.12) / 0.02 + 0.5)::BIGINT AS i,
             floor((38.12 - (38.0 + (2000 + gate * 250) * cos(radians(azimuth)) / 111320)) / 0.02 + 0.5)::BIGINT AS j FROM g)
SELECT p.run, azimuth, gate, p.i, p.j, floor((p.value - c.value / 10) * 10 + 0.5) / 10 AS exceed FROM p JOIN [run_cell] c USING (run, i, j) WHERE p.value - c.value / 10 >= 0.25""")
def _(x):
    g = x.t("lineitem").groupBy(F.col("l_suppkey").alias("run"), (F.col("l_orderkey") % 72 * 5.0).alias("azimuth"), (F.col("l_partkey") % 40).alias("gate")).agg(F.max("l_quantity").alias("value"))
    at = R.gates_to_cells(g.withColumn("range_m", 2000 + F.col("gate") * 250), 38.0, -97.0, -97.12, 38.12, 0.02)
    out = R.gate_exceedance(at, x.d("run_cell").withColumn("value", F.col("value") / 10), by=["run"])
    return out.select("run", "azimuth", "gate", "i", "j", "exceed")


@query("r13_product_series", f"""
WITH d AS {DENSE} SELECT a.run, a.i, a.j, round(avg(b.value) FILTER (WHERE b.value < 60), 6) AS mean
FROM d a JOIN d b ON a.run = b.run AND abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 GROUP BY ALL""")
def _(x):
    """Every frame of a period; half of them have come, and been worked out, before."""
    frames, path = x.d("run_cell"), f"{shared_dir(x.spark)}/series-{uuid.uuid4().hex}"
    smooth = lambda df, by: A.box_mean(df, N, N, 2, 60, by).select(*by, "i", "j", F.round("mean", 6).alias("mean"))
    playback.product_series(frames.filter("run % 2 = 0"), "run", smooth, path)
    return playback.product_series(frames, "run", smooth, path)


@query("m31_palette_tables", """
WITH p AS (
  SELECT n_nationkey AS palette, n_nationkey AS k, unnest([
    struct_pack(v := k % 7::DOUBLE, w := (10 + k)::DOUBLE, c := [k, 20, 30, 100], e := [200, 210, 220, 250], first := true, last := false),
    struct_pack(v := (10 + k)::DOUBLE, w := (25 + k)::DOUBLE, c := [255, k, 0, 255], e := [9, 2 * k, 99, 255], first := false, last := false),
    struct_pack(v := (25 + k)::DOUBLE, w := (40 + k)::DOUBLE, c := [9, 2 * k, 99, 255], e := [9, 2 * k, 99, 255], first := false, last := true)]) AS s FROM nation
), x AS (
  SELECT c_custkey AS place, c_nationkey AS palette, k % 7::DOUBLE AS lo, (40 + k)::DOUBLE AS hi,
         least(1023, greatest(0, floor((c_acctbal / 200 - lo) / (hi - lo) * 1023 + 0.5))) AS step, lo + (hi - lo) * step / 1023 AS v
  FROM customer JOIN (SELECT n_nationkey AS c_nationkey, n_nationkey AS k FROM nation) USING (c_nationkey)
), y AS (
  SELECT x.place, s.c AS c, s.e AS e, (x.v - s.v) / (s.w - s.v) AS t FROM x JOIN p ON p.palette = x.palette AND (s.first OR x.v > s.v) AND (s.last OR x.v <= s.w)
)
SELECT place, floor(list_extract(c, 1) + (list_extract(e, 1) - list_extract(c, 1)) * t + 0.5)::INT AS red, floor(list_extract(c, 2) + (list_extract(e, 2) - list_extract(c, 2)) * t + 0.5)::INT AS green,
       floor(list_extract(c, 3) + (list_extract(e, 3) - list_extract(c, 3)) * t + 0.5)::INT AS blue, floor(list_extract(c, 4) + (list_extract(e, 4) - list_extract(c, 4)) * t + 0.5)::INT AS alpha FROM y""")
def _(x):
    """Palettes read from their text, one for each nation, colour the balances of its customers."""
    k = F.col("n_nationkey")
    text = F.array(
        F.format_string("Color4: %d %d 20 30 100 200 210 220 250", k % 7, k), F.format_string("SolidColor: %d 9 %d 99", k + 25, k * 2),
        F.format_string("Color: %d 255 %d 0 ; in between", k + 10, k), F.format_string("Color: %d 1 2 3", k + 40),
    )
    tables = colours.color_tables(C.palettes(x.t("nation").select(k.alias("palette"), F.posexplode(text).alias("pos", "value"))))
    values = x.t("customer").select(F.col("c_custkey").alias("place"), F.col("c_nationkey").alias("product"), (F.col("c_acctbal") / 200).alias("value"))
    return colours.colour_by_table(values, "value", "product", tables).select("place", *colours.CHANNELS)


@query("k1_sources_by_hour", """
SELECT run, hour, i, j, round(CASE WHEN hour <= 18 THEN q WHEN hour <= 36 THEN d ELSE n END + x, 6) AS value FROM [grid]
UNION ALL
SELECT run + 1000000, hour, i, j, round(CASE WHEN hour <= 12 THEN t ELSE greatest(t - b, 0) END, 6) FROM (
  SELECT a.*, CASE WHEN a.hour <= 24 THEN a.q ELSE a.d END AS t, CASE WHEN a.hour <= 24 THEN p.q ELSE p.d END AS b
  FROM [grid] a LEFT JOIN [grid] p ON p.run = a.run AND p.i = a.i AND p.j = a.j AND p.hour = a.hour - 12) WHERE hour <= 12 OR b IS NOT NULL""")
def _(x):
    """A field that comes from three sources by forecast hour, and a window over a total whose source changes after a day."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v.upper()).alias("var"), F.col(v).cast("double").alias("value")) for v in "qdnx"))).alias("f")
    cells = x.d("grid").select("run", "hour", "i", "j", pairs).select("run", "hour", "i", "j", "f.var", F.lit("surface").alias("level"), "f.value")
    first = products.by_hour((0, 18, ("Q", "surface")), (19, 36, ("D", "surface")), (37, None, ("N", "surface")))
    mine = products.with_product({}, "SUM", [first, ("X", "surface")], lambda a, b: F.col(a) + F.col(b))
    total = products.by_hour((0, 24, ("Q", "surface")), (25, None, ("D", "surface")))
    mine = products.with_product(mine, "FELL", [total], window=12)
    out = products.products(cells, ["SUM", "FELL"], mine)
    return out.select((F.col("run") + F.when(F.col("id") == "FELL", 1_000_000).otherwise(0)).alias("run"), "hour", "i", "j", F.round("value", 6).alias("value"))


@query("j12_nearest_main_site", """
WITH d AS (SELECT p.place, s.site, acos(least(1, greatest(-1, sin(radians(p.lat)) * sin(radians(s.lat)) + cos(radians(p.lat)) * cos(radians(s.lat)) * cos(radians(p.lon - s.lon))))) AS a
  FROM (SELECT place, lon * 1.37 AS lon, lat * 0.83 + 3 AS lat FROM [place]) p, [site] s WHERE s.site % 7 <> 0)
SELECT place, round(6371.0088 * min(a), 1) AS km FROM d GROUP BY 1""")
def _(x):
    """Terminal radars are left out; distances by another formula."""
    p = x.d("place").select("place", (F.col("lon") * 1.37).alias("lon"), (F.col("lat") * 0.83 + 3).alias("lat"))
    out = shapes.nearest_site(p, x.d("site").withColumn("terminal", F.col("site") % 7 == 0), "place", "terminal")
    return out.select("place", F.round(F.col("dist_m") / 1000, 1).alias("km"))


@query("u2_offered_products", """
WITH m AS (SELECT DISTINCT l_suppkey AS run, l_suppkey % 4 AS k FROM lineitem),
o AS (SELECT run, (CASE k WHEN 0 THEN ['W200', 'W300', 'W500', 'W700', 'W850', 'W925', 'TMP925', 'TMP850', 'TMP700', 'TMP500']
  WHEN 1 THEN ['TMP', 'FEELS', 'WIND', 'DPT', 'TCDC', 'QPF6', 'QPF24', 'QPF', 'W200', 'W300', 'W500', 'W700', 'W850', 'W925', 'TMP925', 'TMP850', 'TMP700', 'TMP500',
               'SNOW6', 'SNOW12', 'SNOW24', 'SNOWT', 'KUCH6', 'KUCH12', 'KUCH24', 'KUCHT']
  WHEN 2 THEN ['REFC', 'TMP', 'FEELS', 'WIND', 'GUST', 'RH', 'DPT', 'TCDC', 'W200', 'W300', 'W500', 'W700', 'W850', 'W925', 'TMP925', 'TMP850', 'TMP700', 'TMP500',
               'SBCAPE', 'SBCIN', 'LAPSE', 'SRH1', 'SRH3', 'STORM'] END) AS l, k FROM m),
n AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM o)
SELECT run, list_extract(l, i) AS product, i::INT AS position, CASE WHEN k = 0 THEN 'W200' WHEN k = 1 THEN 'TMP' ELSE 'REFC' END AS first FROM n""")
def _(x):
    """The products of the model behind each run, in display order, and the one shown first."""
    models = {0: "aigfs", 1: "aifs", 2: "hrrrcast"}
    runs = x.t("lineitem").select(F.col("l_suppkey").alias("run")).distinct().withColumn("model", F.element_at(F.create_map(*(F.lit(v) for kv in models.items() for v in kv)), F.col("run") % 4))
    return products.offered(runs.filter("model IS NOT NULL"), "model").select("run", "product", "position", "first")


@query("g9_ring_vertices", """
WITH s AS (SELECT site, lat, lon, unnest(range(1, 5)) AS k FROM [site]), v AS (SELECT *, unnest(range(73)) AS n FROM s),
u AS (SELECT *, k * 100000 / 6371008.8 AS d, radians(n * 5.0::DOUBLE) AS b, radians(lat) AS la FROM v),
w AS (SELECT *, sin(la) * cos(d) + cos(la) * sin(d) * cos(b) AS z FROM u)
SELECT site, k * 100000.0::DOUBLE AS ring_m, n::INT AS vertex, round(degrees(asin(z)), 5) AS lat, round(lon + degrees(atan2(sin(b) * sin(d) * cos(la), cos(d) - sin(la) * z)), 5) AS lon FROM w""")
def _(x):
    """Every vertex of every ring."""
    out = R.range_rings(x.d("site"), 460_000.0).select("site", "ring_m", F.posexplode("ring").alias("vertex", "p"))
    return out.select("site", "ring_m", "vertex", F.round("p.lat", 5).alias("lat"), F.round("p.lon", 5).alias("lon"))


@query("j7_u4_zone_vertices", """
WITH z AS (SELECT poly AS zone, unnest([0, 1, 2, 3]) AS n, cx, cy FROM [polygon]),
v AS (SELECT zone, n, cx + CASE WHEN n IN (1, 2) THEN 1 ELSE 0 END + zone / 8.0::DOUBLE AS lon, cy + CASE WHEN n >= 2 THEN 1.5::DOUBLE ELSE 0 END AS lat FROM z),
a AS (SELECT o_orderkey AS id, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE list_distinct([o_orderkey % 25, (o_orderkey + 7) % 25]) END) AS zone FROM orders)
SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM a JOIN v USING (zone)
UNION ALL SELECT o_orderkey, 0.5::DOUBLE, o_orderkey % 90 FROM orders WHERE o_orderkey % 3 = 0""")
def _(x):
    """Every vertex of the rings that an alert has of its own, or takes from its zones."""
    p = F.col("poly")
    at = lambda dx, dy: F.struct((F.col("cx") + dx + p / 8.0).cast("double").alias("lon"), (F.col("cy") + dy).cast("double").alias("lat"))
    zones = x.d("polygon").select(p.cast("long").alias("zone"), F.array(F.array(at(0, 0), at(1, 0), at(1, 1.5), at(0, 1.5))).alias("rings"))
    key = F.col("o_orderkey")
    own = F.array(F.array(F.struct(F.lit(0.5).alias("lon"), (key % 90).cast("double").alias("lat"))))
    alerts = x.t("orders").select(key.alias("id"), F.array_distinct(F.array(key % 25, (key + 7) % 25)).alias("zones"), F.when(key % 3 == 0, own).alias("rings"))
    out = shapes.resolve_geometry(alerts, zones).select("id", F.explode("rings").alias("ring")).select("id", F.explode("ring").alias("v"))
    return out.select("id", F.round("v.lon", 6).alias("lon"), F.round("v.lat", 6).alias("lat"))


# Unfolding walks beams in order, so each step is a recursion over the beams of all runs; `held` are the beams, lists of 12 gates.
_AT = "list_extract(list_extract({h}, {r}::BIGINT), g)"
_V, _PREV, _NEXT = (_AT.format(h="held", r=r) for r in ("(r + 1)", "((r + n - 1) % n + 1)", "((r + 1) % n + 1)"))
_PUT = "list_transform(range(1, n + 1), lambda q: CASE WHEN q = r + 1 THEN list_transform(range(1, 13), lambda g: {new}) ELSE list_extract(held, q) END)"
_REF = "CASE WHEN len(acc.last) >= 3 THEN list_aggregate(acc.last, 'median') ELSE x.p END"
_UNFOLDED = f"CASE WHEN ({_REF}) IS NULL THEN x.v ELSE x.v + floor((({_REF}) - x.v) / two + 0.5) * two END"
_NEAR = f"""list_filter(list_transform(list_filter([-4, -3, -2, -1, 1, 2, 3, 4], lambda k: (r + k + 4 * n) % n <> r),
              lambda k: {_AT.format(h="held", r="((r + k + 4 * n) % n + 1)")}), lambda y: y IS NOT NULL)"""
_MEDIAN = f"list_aggregate({_NEAR}, 'median')"
_FOLD = f"(floor(({_MEDIAN} - {_V}) / two + 0.5) * two)"


def _passes(name: str, source: str, new: str, passes: int, least: int) -> str:
    return f"""{name}_steps AS (
  SELECT run, n, two, raw, held, 0::BIGINT AS s, 0::BIGINT AS r FROM {source}
  UNION ALL
  SELECT run, n, two, raw, {_PUT.format(new=new)}, s + 1, (s + 1) % n FROM {name}_steps WHERE n >= {least} AND s < {passes} * n
), {name} AS (SELECT run, any_value(n) AS n, any_value(two) AS two, any_value(raw) AS raw, arg_max(held, s) AS held FROM {name}_steps GROUP BY run)"""


@query("w2_w3_w4_w5_dealias_of_runs", f"""
WITH RECURSIVE g AS (
  SELECT run, i, j, ((value * 7) % 61 - 30)::DOUBLE AS v FROM [run_cell]
), beams AS (
  SELECT run, i, row_number() OVER (PARTITION BY run ORDER BY i) AS r FROM (SELECT DISTINCT run, i FROM g)
), rows_ AS (
  SELECT b.run, b.r, list(g.v ORDER BY t.j) AS beam FROM beams b CROSS JOIN (SELECT unnest(range(12)) AS j) t LEFT JOIN g ON g.run = b.run AND g.i = b.i AND g.j = t.j GROUP BY ALL
), w1 AS (
  SELECT run, count(*) AS n, (2 * (15 + run % 3))::DOUBLE AS two, list(beam ORDER BY r) AS raw FROM rows_ GROUP BY run
), w2_steps AS (
  SELECT run, n, two, raw, []::DOUBLE[][] AS held, 0::BIGINT AS s FROM w1
  UNION ALL
  SELECT run, n, two, raw, list_append(held, list_reduce(list_prepend(struct_pack(o := []::DOUBLE[], last := []::DOUBLE[], v := NULL::DOUBLE, p := NULL::DOUBLE),
      list_transform(range(1, 13), lambda g: struct_pack(o := []::DOUBLE[], last := []::DOUBLE[], v := list_extract(list_extract(raw, s + 1), g),
        p := CASE WHEN s > 0 THEN list_extract(list_extract(held, s), g) END))),
      lambda acc, x: struct_pack(o := list_append(acc.o, {_UNFOLDED}),
        last := CASE WHEN x.v IS NULL THEN []::DOUBLE[] ELSE list_append(list_slice(acc.last, greatest(1, len(acc.last) - 3), len(acc.last)), {_UNFOLDED}) END,
        v := NULL::DOUBLE, p := NULL::DOUBLE)).o), s + 1
  FROM w2_steps WHERE s < n
), w2 AS (SELECT run, any_value(n) AS n, any_value(two) AS two, any_value(raw) AS raw, arg_max(held, s) AS held FROM w2_steps GROUP BY run),
{_passes("w3", "w2", f"CASE WHEN floor(({_PREV} - {_V}) / two + 0.5) = floor(({_NEXT} - {_V}) / two + 0.5) THEN {_V} + floor(({_PREV} - {_V}) / two + 0.5) * two ELSE {_V} END", 3, 3)},
{_passes("w4", "w3", f"CASE WHEN len({_NEAR}) >= 4 AND abs({_V} - {_MEDIAN}) - abs({_V} + {_FOLD} - {_MEDIAN}) >= 0.35 * two THEN {_V} + {_FOLD} ELSE {_V} END", 2, 5)},
w5_steps AS (
  SELECT run, n, two, raw, held, 0::BIGINT AS s FROM w4
  UNION ALL
  SELECT run, n, two, raw, list_transform(range(1, n + 1), lambda q: CASE WHEN q = s + 1 THEN list_transform(range(1, 13), lambda g:
      CASE WHEN list_extract(odd, g) AND list_extract(ends, g) - list_extract(begins, g) >= 1 AND list_avg(list_transform(range(list_extract(begins, g), list_extract(ends, g) + 1),
             lambda y: CASE WHEN coalesce(sign(list_extract(up, y)) = sign(list_extract(own, y)) AND abs(list_extract(up, y)) >= 25, false)
               OR coalesce(sign(list_extract(down, y)) = sign(list_extract(own, y)) AND abs(list_extract(down, y)) >= 25, false) THEN 1 ELSE 0 END)) < 0.35
           THEN list_extract(list_extract(raw, q), g) ELSE list_extract(own, g) END) ELSE list_extract(held, q) END), s + 1
  FROM (SELECT *, list_transform(range(1, 13), lambda g: coalesce(list_max(list_filter(range(1, g), lambda y: NOT list_extract(odd, y))), 0) + 1) AS begins,
               list_transform(range(1, 13), lambda g: coalesce(list_min(list_filter(range(g + 1, 13), lambda y: NOT list_extract(odd, y))), 13) - 1) AS ends
        FROM (SELECT *, list_extract(held, s + 1) AS own,
                     CASE WHEN n >= 3 THEN list_extract(held, (s + n - 1) % n + 1) ELSE list_extract(held, s + 1) END AS up,
                     CASE WHEN n >= 3 THEN list_extract(held, (s + 1) % n + 1) ELSE list_extract(held, s + 1) END AS down,
                     list_transform(range(1, 13), lambda g: coalesce(abs(list_extract(list_extract(held, s + 1), g)) >= 12
                       AND abs(list_extract(list_extract(held, s + 1), g) - list_extract(list_extract(raw, s + 1), g)) > 1e-6, false)) AS odd
              FROM w5_steps WHERE s < n))
), w5 AS (SELECT run, arg_max(held, s) AS held FROM w5_steps GROUP BY run)
SELECT g.run, g.i * 30.0::DOUBLE AS azimuth, g.j AS gate, list_extract(list_extract(w2.held, b.r), g.j + 1) AS w2, list_extract(list_extract(w3.held, b.r), g.j + 1) AS w3,
       list_extract(list_extract(w4.held, b.r), g.j + 1) AS w4, list_extract(list_extract(w5.held, b.r), g.j + 1) AS unfolded
FROM g JOIN beams b ON b.run = g.run AND b.i = g.i JOIN w2 ON w2.run = g.run JOIN w3 ON w3.run = g.run JOIN w4 ON w4.run = g.run JOIN w5 ON w5.run = g.run""")
def _(x):
    """What each step of unfolding gives for a sweep of 12 beams per run, with limits of reverting that fit short beams."""
    v = x.d("run_cell").select("run", (F.col("i") * 30.0).alias("azimuth"), F.col("j").alias("gate"), ((F.col("value") * 7) % 61 - 30).alias("value"), (15 + F.col("run") % 3).alias("limit"))
    out = R.dealias(v, ["run"], F.col("limit"), steps=True, runs={"least": 2, "fast": 12.0, "support": 25.0})
    return out.select("run", "azimuth", "gate", "w2", "w3", "w4", "unfolded")


_T13 = "190 + value * 3 % 90"


@query("r8_w9_precip_of_runs", f"""
WITH p AS (SELECT run, i AS row, j AS col, {_T13} AS t13, {_T13} - value % 5 AS t15, {_T13} - 10 + value % 13 AS t8 FROM [run_cell]),
m AS (SELECT a.run, a.row, a.col, avg(b.t13) FILTER (WHERE b.t13 < 265) AS mean FROM p a JOIN p b ON a.run = b.run AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL),
f AS (SELECT user_id % 10 + 1 AS run, user_id % 12 AS row, event_id % 12 AS col, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL),
c AS (SELECT run, row, col FROM (SELECT DISTINCT run FROM f), (SELECT unnest(range(12)) AS row), (SELECT unnest(range(12)) AS col)),
d AS (SELECT c.run, c.row, c.col, coalesce(sum(n), 0) / 5.0::DOUBLE AS density FROM c LEFT JOIN f ON f.run = c.run AND abs(f.row - c.row) <= 1 AND abs(f.col - c.col) <= 1 GROUP BY ALL)
SELECT p.run, p.row, p.col, round(density, 6) AS density, round({S.rate_formula().sql('t13', 't15', 't8', 'mean', 'density')}, 5) AS rate
FROM p JOIN m USING (run, row, col) LEFT JOIN d USING (run, row, col)""")
def _(x):
    """Rain of a scene for each run, some of them with lightning."""
    t13, v = F.expr(_T13), F.col("value")
    pixels = x.d("run_cell").select("run", F.col("i").alias("row"), F.col("j").alias("col"), t13.alias("t13"), (t13 - v % 5).alias("t15"), (t13 - 10 + v % 13).alias("t8"))
    e = x.t("events").filter("event_type = 'error'")
    flashes = e.select((F.col("user_id") % 10 + 1).alias("run"), (F.col("user_id") % N).cast("int").alias("row"), (F.col("event_id") % N).cast("int").alias("col"))
    density = S.flash_density(flashes, N, N, 1, by=["run"])
    out = S.satellite_precip(pixels, N, N, 2, density, ["run"])
    return out.select("run", "row", "col", F.round("density", 6).alias("density"), F.round("rate", 5).alias("rate"))
