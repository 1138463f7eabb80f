"""Queries of skyframe.streaming: each drains a table's stream and equals a batch over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.operators.series import micros
from skyframe.plans.base import query
from skyframe.streaming import state as X


def _events(x):
    e = X.read_stream(x.spark, x.dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("x1_latest_state", "SELECT user_id, epoch_us(max(ts)) AS time_us, round(arg_max(value, (ts, value)), 6) AS value FROM events GROUP BY 1")
def _(x):
    out = X.drain(X.latest_state(_events(x).withWatermark("ts", "30 days"), "user_id", "ts", "value", 100_000), "update")
    last = out.groupBy("user_id").agg(F.max(F.struct("_batch", "time_us", "value")).alias("s"))
    return last.select("user_id", "s.time_us", F.round("s.value", 6).alias("value"))


@query("x2_admit", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 09:00:00' AND ts <= TIMESTAMP '2024-01-20 12:30:00'")
def _(x):
    return X.drain(X.admit(_events(x), "ts", F.lit("2024-01-20 12:00:00").cast("timestamp"), "180 minutes"), "append").select("event_id")


@query("x3_dedupe_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(x):
    return X.drain(X.dedupe_stream(_events(x), ["user_id", "event_type"], "ts", "60 days"), "append").select("user_id", "event_type")


@query("x4_flash_window", "SELECT strftime(date_trunc('minute', ts) + to_minutes(k::INT), '%Y%m%d%H%M') AS scene, user_id % 12 AS row, count(*) AS n FROM events, (SELECT unnest(range(1, 6)) AS k) WHERE event_type = 'error' GROUP BY 1, 2")
def _(x):
    f = _events(x).filter("event_type = 'error'").withColumn("row", F.col("user_id") % 12)
    return X.drain(X.flash_window(f, "ts", ["row"]), "complete").select(F.date_format("scene_time", "yyyyMMddHHmm").alias("scene"), "row", "n")


@query("x5_alert_state", "SELECT user_id, epoch_us(max(ts)) AS time_us, CASE WHEN arg_max(event_type = 'error', ts) THEN 'cancelled' WHEN count(*) > 1 THEN 'updated' ELSE 'issued' END AS state, count(*) AS n FROM events GROUP BY 1")
def _(x):
    a = _events(x).withColumns({"until": F.col("ts") + F.expr("INTERVAL 400 DAYS"), "cancel": F.col("event_type") == "error"}).withWatermark("ts", "30 days")
    out = X.drain(X.alert_state(a, "user_id", "ts", "until"), "update")
    return out.groupBy("user_id").agg(F.max(F.struct("_batch", "time_us", "state", "n")).alias("s")).select("user_id", "s.time_us", "s.state", "s.n")


@query("x6_report_counts", "SELECT strftime(date_trunc('hour', ts) + to_hours(k::INT), '%Y%m%d%H') AS until, event_type, count(*) AS n FROM events, (SELECT unnest(range(1, 7)) AS k) GROUP BY 1, 2")
def _(x):
    return X.drain(X.report_counts(_events(x), "ts", "event_type", 6), "complete").select(F.date_format("until", "yyyyMMddHH").alias("until"), "event_type", "n")


@query("x7_silent_sites", "SELECT user_id, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def _(x):
    out = X.drain(X.silent_sites(_events(x).withWatermark("ts", "1 hour"), "user_id", "ts"), "update")
    return out.groupBy("user_id").agg(F.max("last_us").alias("last_us"))


@query("x7_silence", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, epoch_us(last) AS last_us, last + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS silent FROM l")
def _(x):
    """Sites that the watermark, an hour behind the newest scan of all, has left behind by an hour are told silent after the last batch."""
    out = X.drain(X.silent_sites(_events(x).withWatermark("ts", "1 hour"), "user_id", "ts"), "update")
    return out.groupBy("user_id").agg(F.max("last_us").alias("last_us"), F.max("silent").alias("silent"))


@query("x8_latest_frame", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS frame FROM events WHERE event_type = 'view' GROUP BY 1")
def _(x):
    return X.drain(X.latest_frame(_events(x).filter("event_type = 'view'"), "user_id", "ts", "event_id"), "complete")


_LIFE = """WITH m AS (SELECT id, sent, sent + to_days(days::INT) AS ends, cancel, ref FROM [alert]), t AS (SELECT max(sent) - INTERVAL 2 DAY AS now FROM m),
r AS (SELECT ref AS id, arg_min(m.id::VARCHAR, (m.sent, m.id::VARCHAR)) AS newer FROM m, t WHERE ref IS NOT NULL AND m.sent <= now GROUP BY 1)
SELECT m.id, CASE WHEN newer IS NOT NULL THEN 'superseded' WHEN cancel THEN 'cancelled' WHEN now < sent THEN 'pending' WHEN now >= ends THEN 'expired' ELSE 'active' END AS state,
newer AS superseded_by FROM m CROSS JOIN t LEFT JOIN r USING (id)"""


@query("x5_alert_life", _LIFE)
def _(x):
    """Alerts that name the ones they replace, as of the watermark after all have arrived, two days behind the newest."""
    o = X.read_stream(x.spark, x.dir, "orders")
    ref = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.col("o_orderkey") - 1))
    a = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("sent"), (F.col("o_orderkey") % 5 + 1).alias("days"), ref.alias("refs"), (F.col("o_orderstatus") == "P").alias("cancel")
    ).withColumns({"ends": F.col("sent") + F.make_dt_interval(F.col("days").cast("int")), "onset": F.col("sent"), "arrived": F.col("sent")})
    out = X.drain(X.alert_life(a, "id", "sent", "onset", "ends", "cancel", "refs", "arrived", "2 days"), "update")
    last = out.groupBy("id").agg(F.max(F.struct("_batch", "state", "superseded_by")).alias("s"))
    return last.select("id", "s.state", "s.superseded_by")


@query("x9_catalog_versions", """WITH v AS (SELECT s_suppkey AS user_id, s_name || '/' || k AS name, TIMESTAMP '2024-01-01' + to_days((k * 6)::INT) AS version, k FROM supplier, (SELECT unnest(range(0, 6)) AS k) WHERE (s_suppkey + k) % 5 <> 0),
e AS (SELECT event_id, user_id, ts, (SELECT max(version) FROM v WHERE version <= ts) AS version FROM events)
SELECT event_id, name, name IS NOT NULL AS listed FROM e LEFT JOIN v USING (user_id, version)""")
def _(x):
    """A catalogue refreshed every six days, each time without a fifth of the stations."""
    s = x.t("supplier").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).filter((F.col("s_suppkey") + F.col("k")) % 5 != 0)
    version = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("k") * 6)
    catalog = s.select(F.col("s_suppkey").alias("user_id"), F.concat("s_name", F.lit("/"), F.col("k")).alias("name"), version.alias("version"))
    return X.enrich_stream(_events(x), lambda: catalog, "user_id", "ts", "version").select("event_id", "name", "listed")


@query("x9_enrich", "SELECT event_id, s_name AS name FROM events LEFT JOIN supplier ON user_id = s_suppkey")
def _(x):
    catalog = x.t("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))
    return X.drain(X.enrich(_events(x), catalog, "user_id"), "append").select("event_id", "name")


__all__ = ["micros"]
