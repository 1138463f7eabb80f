"""Queries of skyframe.operators.series."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.operators import series as S
from skyframe.plans.base import Inputs, query

NOW, DAY = "2024-01-20 12:00:00", "2024-01-20"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _day():
    return F.lit(DAY).cast("date")


def _pairs(x: Inputs):
    """Purchases beside the value of the last view of the same user."""
    obs = x.d("obs")
    views = obs.filter("kind = 'view'").select("station", "time", F.struct("value", "event_id").alias("k"))
    return S.asof_join(obs.filter("kind = 'purchase'"), views, "station", "time", "k").filter("right_key IS NOT NULL").select(
        (F.col("station") % 10).alias("grp"), (F.col("value") / 20).alias("sat"), (F.col("right_key.value") / 20).alias("radar")
    )


PAIRS = """SELECT p.station % 10 AS grp, p.value / 20 AS sat, v.value / 20 AS radar FROM (SELECT * FROM [obs] WHERE kind = 'purchase') p
ASOF JOIN (SELECT * FROM [obs] WHERE kind = 'view') v ON p.station = v.station AND p.time >= v.time"""


@query("c4_latest_frames", "SELECT series, key FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time DESC, key DESC) r FROM [frame]) WHERE r <= 12")
def _(x):
    return S.latest_frames(x.d("frame"), "series", "time", 12, "key").select("series", "key")


@query("c5_fill_from_previous_day", f"SELECT series, key FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time DESC, key DESC) r FROM [frame] WHERE time::DATE IN (DATE '{DAY}', DATE '{DAY}' - 1)) WHERE r <= 8")
def _(x):
    return S.fill_from_previous_day(x.d("frame"), "series", "time", _day(), 8, "key").select("series", "key")


@query("c6_latest_nonempty_day", f"SELECT series, strftime(max(time::DATE), '%Y-%m-%d') AS day FROM [frame] WHERE time::DATE BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}' GROUP BY 1")
def _(x):
    return S.latest_nonempty_day(x.d("frame"), "series", "time", _day()).select("series", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("c7_site_status", f"SELECT s.site, s.name, epoch_us(max(f.time)) AS last_us, (max(f.time) IS NULL OR max(f.time) < TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE) AS down FROM [site] s LEFT JOIN (SELECT * FROM [frame] WHERE time <= TIMESTAMP '{NOW}' AND time::DATE >= DATE '{DAY}' - 1) f ON f.series = s.site GROUP BY 1, 2")
def _(x):
    out = S.site_status(x.d("frame").withColumnRenamed("series", "site"), x.d("site"), "site", "time", _now())
    return out.select("site", "name", S.micros("last_scan").alias("last_us"), "down")


@query("j1_asof_join", "SELECT p.event_id, v.event_id AS frame FROM (SELECT * FROM [obs] WHERE kind = 'purchase') p ASOF LEFT JOIN (SELECT * FROM [obs] WHERE kind = 'view') v ON p.station = v.station AND p.time >= v.time")
def _(x):
    obs = x.d("obs")
    return S.asof_join(obs.filter("kind = 'purchase'"), obs.filter("kind = 'view'"), "station", "time", "event_id").select("event_id", F.col("right_key").alias("frame"))


@query("j1_asof_join_with_day_fallback", """WITH p AS (SELECT * FROM [obs] WHERE kind = 'purchase'), v AS (SELECT * FROM [obs] WHERE kind = 'view'),
n AS (SELECT p.event_id, p.station, p.time, CASE WHEN v.time::DATE >= p.time::DATE - 1 THEN v.event_id END AS near FROM p ASOF LEFT JOIN v ON p.station = v.station AND p.time >= v.time),
f AS (SELECT station, time::DATE AS day, arg_min(event_id, (time, event_id)) AS first FROM v GROUP BY 1, 2)
SELECT n.event_id, coalesce(near, first) AS frame FROM n LEFT JOIN f ON n.station = f.station AND n.time::DATE = f.day""")
def _(x):
    obs = x.d("obs")
    return S.asof_join(obs.filter("kind = 'purchase'"), obs.filter("kind = 'view'"), "station", "time", "event_id", "day").select("event_id", F.col("right_key").alias("frame"))


@query("j2_nearest_join", """SELECT event_id AS left_key, frame AS right_key, gap AS gap_us FROM (SELECT p.event_id, v.event_id AS frame, abs(epoch_us(p.time) - epoch_us(v.time)) AS gap,
row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.time) - epoch_us(v.time)), v.time, v.event_id) r FROM [obs] p JOIN [obs] v ON p.station = v.station AND p.kind = 'purchase' AND v.kind = 'view' AND abs(epoch_us(p.time) - epoch_us(v.time)) < 7200000000) WHERE r = 1""")
def _(x):
    obs = x.d("obs")
    return S.nearest_join(obs.filter("kind = 'purchase'"), obs.filter("kind = 'view'"), "station", "time", "event_id", "event_id", 7200).select("left_key", "right_key", "gap_us")


@query("w18_latest_fields", """SELECT station, round(arg_max(value, (time, event_id)) FILTER (WHERE kind = 'click'), 6) AS click, round(arg_max(value, (time, event_id)) FILTER (WHERE kind = 'view'), 6) AS view,
epoch_us(max(time) FILTER (WHERE kind IN ('click', 'view'))) AS last_us FROM [obs] GROUP BY 1""")
def _(x):
    o = x.d("obs").select("station", "time", "event_id", F.when(F.col("kind") == "click", F.col("value")).alias("click"), F.when(F.col("kind") == "view", F.col("value")).alias("view"))
    return S.latest_fields(o, "station", "time", ["click", "view"], "event_id").select("station", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"), S.micros("last_time").alias("last_us"))


@query("p14_fresh_observations", f"SELECT event_id FROM [obs] WHERE time >= TIMESTAMP '{NOW}' - INTERVAL 180 MINUTE AND time <= TIMESTAMP '{NOW}' + INTERVAL 30 MINUTE")
def _(x):
    return x.d("obs").filter(S.fresh("time", _now(), "180 minutes")).select("event_id")


@query("t2_thin_by_cell", "SELECT place, floor(lon / 4)::BIGINT AS cx, floor(lat / 4)::BIGINT AS cy FROM (SELECT *, row_number() OVER (PARTITION BY floor(lon / 4), floor(lat / 4) ORDER BY (lon - floor(lon / 4) * 4 - 2) * (lon - floor(lon / 4) * 4 - 2) + (lat - floor(lat / 4) * 4 - 2) * (lat - floor(lat / 4) * 4 - 2) + 0.04 * (place % 90), place) r FROM [place]) WHERE r = 1")
def _(x):
    p = x.d("place").withColumns({"cx": F.floor(F.col("lon") / 4), "cy": F.floor(F.col("lat") / 4)})
    dx, dy = F.col("lon") - F.col("cx") * 4 - 2, F.col("lat") - F.col("cy") * 4 - 2
    return S.thin_by_cell(p, ["cx", "cy"], dx * dx + dy * dy + 0.04 * (F.col("place") % 90), "place").select("place", "cx", "cy")


@query("t3_thin_with_penalty", "SELECT place FROM (SELECT *, row_number() OVER (PARTITION BY floor(lon / 4), floor(lat / 4) ORDER BY place % 100 + CASE WHEN acctbal < 0 THEN 4000 ELSE 0 END, place) r FROM [place]) WHERE r = 1 OR place % 97 = 0")
def _(x):
    p = x.d("place").withColumns({"cx": F.floor(F.col("lon") / 4), "cy": F.floor(F.col("lat") / 4)})
    return S.thin_by_cell(p, ["cx", "cy"], F.col("place") % 100, "place", F.when(F.col("acctbal") < 0, 4000), F.col("place") % 97 == 0).select("place")


@query("t4_cap_by_center", "SELECT place, (lat - 38) * (lat - 38) + (lon + 97) * (lon + 97) + place % 7 AS distance2 FROM [place] ORDER BY distance2, place LIMIT 50")
def _(x):
    return S.cap_by_center(x.d("place"), 38, -97, 50, "place", F.col("place") % 7).select("place", F.col("distance2").cast("long").alias("distance2"))


@query("t5_newest_first", "SELECT event_id FROM [obs] ORDER BY time DESC, event_id DESC LIMIT 400")
def _(x):
    return S.newest(x.d("obs"), "time", 400, "event_id").select("event_id")


@query("t6_towns_by_arrival", "SELECT place, lat, position, n_towns FROM (SELECT *, (row_number() OVER (PARTITION BY lat ORDER BY lon, place))::INT AS position, count(*) OVER (PARTITION BY lat) AS n_towns FROM [place]) WHERE position <= 10")
def _(x):
    return S.rank_towns(x.d("place"), "lat", "lon", "place", 10).select("place", "lat", "position", "n_towns")


@query("a18_count_by_category", "SELECT kind AS category, count(*) AS n FROM [obs] GROUP BY 1")
def _(x):
    return S.count_by_category(x.d("obs"), F.col("kind"))


_SCORES = "count(*) AS n, round(avg(sat), 6) AS mean_a, round(avg(radar), 6) AS mean_b, round(avg(sat) / avg(radar), 6) AS bias, round(avg(abs(sat - radar)), 6) AS mae, round(sqrt(avg((sat - radar) * (sat - radar))), 6) AS rmse, round(corr(sat, radar), 6) AS corr, round(avg((sat >= 0.2)::DOUBLE), 6) AS area_a, round(avg((radar >= 0.2)::DOUBLE), 6) AS area_b"


@query("a20_continuous_scores", f"SELECT grp, {_SCORES} FROM ({PAIRS}) GROUP BY 1")
def _(x):
    out = S.continuous_scores(_pairs(x), ["grp"])
    return out.select("grp", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query("a21_categorical_scores", f"""WITH s AS (SELECT grp, threshold, count(*) FILTER (WHERE sat >= threshold AND radar >= threshold) AS hits, count(*) FILTER (WHERE sat < threshold AND radar >= threshold) AS misses,
count(*) FILTER (WHERE sat >= threshold AND radar < threshold) AS false_alarms FROM ({PAIRS}), (VALUES (0.5::DOUBLE), (2.5), (10)) t(threshold) GROUP BY 1, 2)
SELECT *, round(hits / nullif(hits + misses, 0), 6) AS pod, round(false_alarms / nullif(hits + false_alarms, 0), 6) AS far, round(hits / nullif(hits + misses + false_alarms, 0), 6) AS csi FROM s""")
def _(x):
    out = S.categorical_scores(_pairs(x), [0.5, 2.5, 10], ["grp"])
    return out.select("grp", "threshold", "hits", "misses", "false_alarms", *(F.round(c, 6).alias(c) for c in ("pod", "far", "csi")))


@query("a22_dedupe_places", "SELECT min(place) AS place, lat, lon FROM [place] GROUP BY lat, lon, substr(name, 1, 8)")
def _(x):
    return S.first_of(x.d("place"), [F.round("lat", 3), F.round("lon", 3), F.substring("name", 1, 8)], ["place"]).select("place", "lat", "lon")


@query("c14_merge_intervals", """WITH r AS (SELECT l_suppkey AS file, l_orderkey AS s, l_orderkey + l_linenumber * 3 AS e FROM lineitem),
m AS (SELECT *, CASE WHEN s > max(e) OVER w + 20 OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT file, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY file, run""")
def _(x):
    r = x.t("lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("s"), (F.col("l_orderkey") + F.col("l_linenumber") * 3).alias("e"))
    return S.merge_intervals(r, "file", "s", "e", 20)


@query("u3_retire_missing", "SELECT place FROM [place] WHERE place IN (SELECT o_custkey FROM orders)")
def _(x):
    return S.retire_missing(x.d("place"), x.t("orders").select(F.col("o_custkey").alias("place")), "place").select("place")


@query("j16_j17_merge_reports", """WITH c AS (SELECT place AS id, lat, lon FROM [place] WHERE place % 2 = 0), b AS (SELECT o_custkey AS id, max(o_orderdate) AS time, min(o_totalprice) AS wave, 10.0::DOUBLE AS lat, 20.0::DOUBLE AS lon FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
d AS (SELECT o_custkey AS id, max(o_orderdate) AS time, max(o_totalprice) AS wave FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT id, coalesce(c.lat, b.lat) AS lat, coalesce(c.lon, b.lon) AS lon, round(CASE WHEN b.time > d.time THEN coalesce(b.wave, d.wave) ELSE coalesce(d.wave, b.wave) END, 4) AS wave
FROM c FULL JOIN b USING (id) FULL JOIN d USING (id) WHERE c.lat IS NOT NULL OR regexp_matches(id::VARCHAR, '^[0-9]{5}$|^[A-Z]{4}[0-9]$')""")
def _(x):
    o = x.t("orders").withColumnRenamed("o_custkey", "id")
    c = x.d("place").filter("place % 2 = 0").select(F.col("place").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    b = o.filter("o_orderkey % 3 <> 0").groupBy("id").agg(F.max("o_orderdate").alias("time"), F.min("o_totalprice").alias("wave"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"))
    d = o.filter("o_orderkey % 5 = 0").groupBy("id").agg(F.max("o_orderdate").alias("time"), F.max("o_totalprice").alias("wave"))
    return S.merge_reports(c, b, d, "id", ["wave"]).withColumn("wave", F.round("wave", 4))


@query("w17_unwrap_longitude", """WITH p AS (SELECT user_id AS track, event_id, (event_id * 97) % 360 - 180 AS lon FROM events), s AS (SELECT *, lon - lag(lon) OVER (PARTITION BY track ORDER BY event_id) AS step FROM p)
SELECT event_id, lon + sum(CASE WHEN step > 180 THEN -360 WHEN step < -180 THEN 360 ELSE 0 END) OVER (PARTITION BY track ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS lon_unwrapped FROM s""")
def _(x):
    p = x.t("events").select(F.col("user_id").alias("track"), "event_id", ((F.col("event_id") * 97) % 360 - 180).alias("lon"))
    return S.unwrap_lon(p, "track", "event_id", "lon").select("event_id", "lon_unwrapped")
