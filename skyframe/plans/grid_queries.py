"""Queries of skyframe.operators.grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import geo as G
from skyframe.functions import weather as M
from skyframe.operators import grid as A
from skyframe.plans.base import query

N = 64
DENSE = "(SELECT i, j, value FROM (SELECT unnest(range(64)) AS i) a CROSS JOIN (SELECT unnest(range(64)) AS j) b LEFT JOIN [cell] c USING (i, j))"


def _r(df, *cols, digits=6):
    return df.select(*(c for c in df.columns if c not in cols), *(F.round(c, digits).alias(c) for c in cols))


@query("a7_ensemble_mean", "SELECT i, j, CASE WHEN count(DISTINCT member) >= 8 THEN round(avg(value), 6) END AS value, count(DISTINCT member) AS n_members FROM [member] GROUP BY 1, 2")
def _(x):
    return _r(A.ensemble_mean(x.d("member"), ["i", "j"], 16), "value")


@query("a8_grand_ensemble_blend", "WITH a AS (SELECT * FROM [cell] WHERE value > 50), b AS (SELECT * FROM [cell] WHERE value < 700) SELECT a.i, a.j, round((a.value + b.value * 2) / 2, 6) AS value FROM a LEFT JOIN b USING (i, j)")
def _(x):
    c = x.d("cell")
    return _r(A.blend(c.filter("value > 50"), [c.filter("value < 700").withColumn("value", F.col("value") * 2)], ["i", "j"]), "value")


@query("a9_block_pool", "SELECT i // 4 AS i, j // 4 AS j, max(value) AS value, round(avg(value), 6) AS mean FROM [cell] GROUP BY i // 4, j // 4")
def _(x):
    c = x.d("cell")
    return A.pool_grid(c, 4).join(A.pool_grid(c, 4, "mean").withColumnRenamed("value", "mean").hint("merge"), ["i", "j"]).withColumn("mean", F.round("mean", 6))


@query("a11_block_mean_downsample", "SELECT i // 5 AS i, j // 5 AS j, round(avg(value), 6) AS value, (i // 5) * 5 + 2.0::DOUBLE AS ci, (j // 5) * 5 + 2.0::DOUBLE AS cj FROM [cell] WHERE i < 60 AND j < 60 GROUP BY i // 5, j // 5")
def _(x):
    return _r(A.downsample(x.d("cell"), N, N, 5), "value")


@query("a12_grid_extrema", "SELECT min(value) AS min_value, arg_min(i, (value, j, i)) AS min_i, arg_min(j, (value, j, i)) AS min_j, max(value) AS max_value, arg_min(i, (-value, j, i)) AS max_i, arg_min(j, (-value, j, i)) AS max_j FROM [cell] WHERE value >= 100")
def _(x):
    return A.grid_extrema(x.d("cell"), 100)


@query("a15_grid_bbox", "SELECT min(i) AS min_i, max(i) AS max_i, min(j) AS min_j, max(j) AS max_j FROM [cell] WHERE value > 300")
def _(x):
    return A.grid_bbox(x.d("cell").withColumn("value", F.when(F.col("value") > 300, F.col("value"))))


@query("j3_align_grids", "WITH b AS (SELECT i // 2 AS i, j // 2 AS j, max(value) AS value FROM [cell] GROUP BY i // 2, j // 2) SELECT a.i, a.j, a.value AS a, b.value AS b FROM [cell] a JOIN b ON a.i // 2 = b.i AND a.j // 2 = b.j")
def _(x):
    c = x.d("cell")
    return A.align_grids(c, A.pool_grid(c, 2), 2)


@query("j4_sample_grid", "SELECT p.place, c.value FROM [place] p LEFT JOIN [cell] c ON c.i = floor((p.lon + 126) / 1.0 + 0.5)::BIGINT AND c.j = floor((60 - p.lat) / 1.5 + 0.5)::BIGINT AND floor((p.lon + 126) + 0.5) BETWEEN 0 AND 63 AND floor((60 - p.lat) / 1.5 + 0.5) BETWEEN 0 AND 63")
def _(x):
    return A.sample_grid(x.d("place"), x.d("cell"), lon1=-126.0, lat1=60.0, di=1.0, dj=1.5, ni=N, nj=N).select("place", "value")


@query("m36_place_values", "SELECT p.place, p.name, round(c.value * 0.0393701, 4) AS shown FROM [place] p JOIN [cell] c ON c.i = (p.lon + 126) AND c.j = floor((60 - p.lat) / 1.5 + 0.5)::BIGINT")
def _(x):
    out = A.sample_grid(x.d("place"), x.d("cell"), lon1=-126.0, lat1=60.0, di=1.0, dj=1.5, ni=N, nj=N).filter("value IS NOT NULL")
    return out.select("place", "name", F.round(M.to_display("value", "0.0393701", "0"), 4).alias("shown"))


@query("w7_masked_box_mean", f"SELECT a.i, a.j, round(avg(b.value) FILTER (WHERE b.value < 265), 6) AS mean FROM {DENSE} a LEFT JOIN [cell] b ON b.i BETWEEN a.i - 3 AND a.i + 3 AND b.j BETWEEN a.j - 3 AND a.j + 3 GROUP BY 1, 2")
def _(x):
    return _r(A.box_mean(x.d("cell"), N, N, 3, 265).select("i", "j", "mean"), "mean")


@query("w8_box_sum", f"SELECT a.i, a.j, coalesce(sum(b.value), 0) AS sum FROM {DENSE} a LEFT JOIN [cell] b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY 1, 2")
def _(x):
    return A.box_sum(x.d("cell"), N, N, 2).select("i", "j", "sum")


@query("w10_m3_accumulation_window", "SELECT a.run, a.hour, CASE WHEN a.hour <= 6 THEN a.value WHEN b.value IS NOT NULL THEN greatest(0, a.value - b.value) ELSE NULL END AS total FROM [accumulation] a LEFT JOIN [accumulation] b ON a.run = b.run AND a.hour - 6 = b.hour")
def _(x):
    out = A.accumulation(x.d("accumulation"), ["run"], 6)
    return out.withColumn("total", F.when((F.col("hour") <= 6) | F.col("total").isNotNull(), F.col("total")))


@query("m15_m16_snow_depth", f"SELECT a.run, a.hour, round(CASE WHEN a.hour <= 6 THEN a.value ELSE greatest(0, a.value - b.value) END * 10, 4) AS snow, round(CASE WHEN a.hour <= 6 THEN a.value ELSE greatest(0, a.value - b.value) END * {M.kuchera_ratio.sql('260 + a.run % 20')}, 4) AS kuchera FROM [accumulation] a LEFT JOIN [accumulation] b ON a.run = b.run AND a.hour - 6 = b.hour")
def _(x):
    a = x.d("accumulation")
    k = A.snow(a, ["run"], 6, M.kuchera_ratio("260 + run % 20")).select("run", "hour", F.round("snow", 4).alias("kuchera"))
    return A.snow(a, ["run"], 6).select("run", "hour", F.round("snow", 4).alias("snow")).join(k.hint("merge"), ["run", "hour"])


@query("w26_gaussian_smooth", f"""SELECT a.i, a.j, round(sum(exp(-((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) / 2.88) * coalesce(b.value / 1000, -0.6)) / sum(exp(-((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) / 2.88)), 6) AS smooth
FROM {DENSE} a JOIN {DENSE} b ON abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3 GROUP BY 1, 2""")
def _(x):
    return _r(A.gaussian_smooth(x.d("cell"), N, N, 1.2, 0, 1000), "smooth")


@query("w11_pressure_centers", f"""WITH d AS {DENSE}, b AS (SELECT a.i, a.j, a.value, count(b.value) AS n, max(b.value) AS mx, min(b.value) AS mn, max(b.value) FILTER (WHERE greatest(abs(a.i - b.i), abs(a.j - b.j)) = 2) AS emx, min(b.value) FILTER (WHERE greatest(abs(a.i - b.i), abs(a.j - b.j)) = 2) AS emn
FROM d a JOIN d b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 GROUP BY 1, 2, 3)
SELECT i, j, value, CASE WHEN value >= 380 THEN 'H' ELSE 'L' END AS kind, CASE WHEN value >= 380 THEN value - emx ELSE emn - value END AS score FROM b
WHERE n = 25 AND ((value >= mx AND value - emx >= 20 AND value >= 380) OR (value <= mn AND emn - value >= 20 AND value < 380))""")
def _(x):
    return A.pressure_centers(x.d("cell"), N, N, 2, 20, 380)


@query("j3_j4_grids_of_runs", """WITH c AS (SELECT run, i, j, value FROM [run_cell]), b AS (SELECT run, i // 2 AS i, j // 2 AS j, max(value) AS value FROM c GROUP BY 1, 2, 3), p AS (SELECT place, place % 20 + 1 AS run, lon, lat FROM [place])
SELECT 'J3' AS op, a.run, NULL AS place, a.i, a.j, a.value AS a, b.value AS b FROM c a JOIN b ON a.run = b.run AND a.i // 2 = b.i AND a.j // 2 = b.j
UNION ALL SELECT 'J4', p.run, place, NULL, NULL, c.value, NULL FROM p LEFT JOIN c ON c.run = p.run AND c.i = floor((p.lon + 126) / 5 + 0.5) AND c.j = floor((60 - p.lat) / 3 + 0.5) AND floor((p.lon + 126) / 5 + 0.5) BETWEEN 0 AND 11 AND floor((60 - p.lat) / 3 + 0.5) BETWEEN 0 AND 11""")
def _(x):
    """Cells meet cells, and points their cells, run by run."""
    c = x.d("run_cell")
    both = A.align_grids(c, A.pool_grid(c, 2, by=["run"]), 2, by=["run"]).select(F.lit("J3").alias("op"), "run", F.lit(None).cast("long").alias("place"), "i", "j", "a", "b")
    points = A.sample_grid(x.d("place").withColumn("run", F.col("place") % 20 + 1), c, by=["run"], lon1=-126.0, lat1=60.0, di=5.0, dj=3.0, ni=12, nj=12)
    none = F.lit(None).cast("long")
    return both.unionAll(points.select(F.lit("J4"), "run", "place", none, none, "value", F.lit(None).cast("double")))


@query("p11_p12_crop_and_turn", """SELECT 'crop' AS op, run, i, j, NULL AS lat1, value FROM [run_cell] WHERE -126 + i * 5 BETWEEN -110 AND -85 AND 60 - j * 3 BETWEEN 35 AND 50
UNION ALL SELECT 'turn', run, i, CASE WHEN run % 2 = 0 THEN 11 - j ELSE j END, CASE WHEN run % 2 = 0 THEN 27 + 33 ELSE 27 END, value FROM [run_cell]""")
def _(x):
    c = x.d("run_cell")
    crop = A.crop_grid(c, -110, 35, -85, 50, -126.0, 60.0, 5.0, 3.0).select(F.lit("crop").alias("op"), "run", "i", "j", F.lit(None).cast("int").alias("lat1"), "value")
    grids = c.select("run").distinct().select("run", F.lit(12).alias("nj"), F.lit(27).alias("lat1"), F.lit(3).alias("dj"), F.when(F.col("run") % 2 == 0, 64 + 3).otherwise(3).alias("scan_mode"))
    turned = A.normalize_rows(c, grids, ["run"]).select(F.lit("turn"), "run", "i", "j", "lat1", "value")
    return crop.unionAll(turned)


@query("w12_suppress_nearby_centers")
def _(x):
    c = A.pressure_centers(x.d("cell"), N, N, 2, 20, 380)
    return A.suppress_nearby(c, "kind", "score", "i", "j", 6, 18)


_SEG = "(level - {0}) / nullif({1} - {0}, 0)"


@query("m33_contour_segments", f"""WITH d AS {DENSE}, w AS (SELECT i, j, value AS a, lead(value) OVER (PARTITION BY j ORDER BY i) AS b, lead(value) OVER (PARTITION BY i ORDER BY j) AS d FROM d),
q AS (SELECT w.*, lead(b) OVER (PARTITION BY i ORDER BY j) AS c FROM w), v AS (SELECT * FROM q WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL),
l AS (SELECT *, unnest(range(greatest(ceil(least(a, b, c, d) / 100)::BIGINT, 1), floor(greatest(a, b, c, d) / 100)::BIGINT + 1)) * 100.0::DOUBLE AS level FROM v),
k AS (SELECT *, (a >= level)::INT * 8 + (b >= level)::INT * 4 + (c >= level)::INT * 2 + (d >= level)::INT AS code FROM l)
SELECT level, count(*) FILTER (WHERE code NOT IN (0, 15)) + count(*) FILTER (WHERE code IN (5, 10)) AS segments FROM k GROUP BY 1 HAVING segments > 0""")
def _(x):
    return A.contour_segments(x.d("cell"), N, N, 100.0, 100.0).groupBy("level").agg(F.count("*").alias("segments"))


@query("m34_m35_contour_lines")
def _(x):
    lines = A.contour_lines(A.contour_segments(x.d("cell"), N, N, 100.0, 100.0))
    return lines.select("level", "line", F.size("points").alias("n_points"))


@query("p9_view_box_split", "SELECT place, west, east FROM (SELECT place, w AS west, CASE WHEN w <= e THEN e ELSE 180 END AS east FROM (SELECT place, ((lon * 3 - 10 - 1 + 180) % 360 + 360) % 360 - 180 AS w, ((lon * 3 + 10 + 1 + 180) % 360 + 360) % 360 - 180 AS e FROM [place]) UNION ALL SELECT place, -180, e FROM (SELECT place, ((lon * 3 - 10 - 1 + 180) % 360 + 360) % 360 - 180 AS w, ((lon * 3 + 10 + 1 + 180) % 360 + 360) % 360 - 180 AS e FROM [place]) WHERE w > e)")
def _(x):
    b = x.d("place").select("place", (F.col("lon") * 3 - 10).alias("west"), (F.col("lon") * 3 + 10).alias("east"), (F.col("lat") - 5).alias("south"), (F.col("lat") + 5).alias("north"))
    return A.view_boxes(b, 1.0).select("place", F.col("west").cast("long").alias("west"), F.col("east").cast("long").alias("east"))


_L = G.lambert(38.5, 38.5, -97.5, 38.5)
_XY = [_L[c].sql("(46.0 - (tj + 0.5) * 0.25)", "(-110.0 + (ti + 0.5) * 0.25)") for c in "xy"]


@query("g11_regrid_lambert", f"""WITH t AS (SELECT a.ti, b.tj FROM (SELECT unnest(range(96)) AS ti) a CROSS JOIN (SELECT unnest(range(64)) AS tj) b)
SELECT ti, tj, value FROM t LEFT JOIN [cell] c ON c.i = floor(({_XY[0]} + 1000000) / 32000 + 0.5)::BIGINT AND c.j = floor(({_XY[1]} + 900000) / 32000 + 0.5)::BIGINT""")
def _(x):
    return A.regrid_lambert(x.d("cell"), (-110.0, 30.0, -86.0, 46.0), 0.25, _L["x"]("lat", "lon"), _L["y"]("lat", "lon"), -1000000.0, -900000.0, 32000.0, 32000.0)
