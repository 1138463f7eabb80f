"""Time series of frames, observations and reports: latest, paired, merged, thinned and scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators.joins import dealt
from skyframe.sources.shared import staged


def micros(time: str | Column) -> Column:
    """Microseconds since 1970 of a time as it reads, whatever the session's zone."""
    t = F.col(time) if isinstance(time, str) else time
    day = F.datediff(t, F.lit("1970-01-01")).cast("long")
    return ((day * 24 + F.hour(t)) * 60 + F.minute(t)) * 60_000_000 + (F.extract(F.lit("SECONDS"), t) * 1_000_000).cast("long")


def latest_frames(df: DataFrame, by: str, time: str, n: int, tie: str | None = None) -> DataFrame:
    """C4: the newest n rows of each series; equal times by the larger `tie`."""
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def fill_from_previous_day(df: DataFrame, by: str, time: str, day: Column, n: int, tie: str) -> DataFrame:
    """The last n frames of the day, filled up with the newest ones of the day before."""
    both = df.filter(F.to_date(time).isin([]) | (F.to_date(time) == day) | (F.to_date(time) == F.date_sub(day, 1)))
    return latest_frames(both, by, time, n, tie)


def latest_nonempty_day(df: DataFrame, by: str, time: str, day: Column, max_back: int = 7) -> DataFrame:
    """(by, day) of the last day with frames within `max_back` days up to the day."""
    d = F.to_date(time)
    return df.filter((d <= day) & (d >= F.date_sub(day, max_back))).groupBy(by).agg(F.max(d).alias("day"))


def site_status(frames: DataFrame, sites: DataFrame, by: str, time: str, now: Column, stale: str = "60 minutes") -> DataFrame:
    """Each site's newest scan of today or yesterday (null: none) and whether it is down."""
    recent = frames.filter((F.col(time) <= now) & (F.to_date(time) >= F.date_sub(F.to_date(now), 1))).groupBy(by).agg(F.max(time).alias("last_scan"))
    down = F.col("last_scan").isNull() | (F.col("last_scan") < now - F.expr(f"INTERVAL {stale}"))
    return sites.join(recent.hint("merge"), by, "left").withColumn("down", down)


def stretch_of(df: DataFrame, order: str, width: float) -> Column:
    """The stretch of a series that a row falls in: `width` seconds of a time or date, else `width` units of a number.

    Operators that walk along a series in order walk along its stretches one by one, and take what the stretches before
    have left from a table with a row per series and stretch. So a series that holds most rows is spread over tasks.
    """
    if df.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return F.floor(micros(order) / (width * 1_000_000))
    return F.floor(F.col(order) / width)


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, key: str, fallback: str | None = None, stretch_s: float = 86_400) -> DataFrame:
    """To each left row the newest right row of its series at or before it, as right_time and right_key.

    With fallback='day' only the left row's UTC day and the one before count; if neither has such a frame, the first
    frame of the left row's day is taken. No join: both sides pass one ordered window per series and stretch of
    `stretch_s` seconds, whose first row is the newest right row of the stretches before.
    """
    entry = F.struct(F.col(time).alias("t"), F.col("_key").alias("k"))
    rows = left.withColumns({"_side": F.lit(1), "_stretch": stretch_of(left, time, stretch_s)})
    frames = right.select(by, time, F.col(key).alias("_key"), F.lit(0).alias("_side"), stretch_of(right, time, stretch_s).alias("_stretch"))
    newest = F.max(F.struct(F.col(time).alias("t"), F.col("_key").isNull().alias("no"), F.col("_key").alias("k")))
    ends = frames.groupBy(by, "_stretch").agg(newest.alias("_end")).unionByName(rows.select(by, "_stretch").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(by, "_stretch").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(by, "_stretch", before.alias("_end")).filter("_end IS NOT NULL")
    carried = carried.select(by, F.col("_end.t").alias(time), F.col("_end.k").alias("_key"), F.lit(0).alias("_side"), "_stretch")
    both = rows.unionByName(frames, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(by, "_stretch").orderBy(time, "_side", F.col("_key").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_near", F.last(F.when(F.col("_side") == 0, entry), ignorenulls=True).over(w))
    if fallback == "day":
        first = F.min(F.when(F.col("_side") == 0, entry)).over(Window.partitionBy(by, F.to_date(time)))
        held = F.when(F.to_date(F.col("_near.t")) >= F.date_sub(F.to_date(time), 1), F.col("_near"))
        out = out.withColumn("_first", first).withColumn("_near", F.coalesce(held, "_first")).drop("_first")
    return out.filter("_side = 1").withColumns({"right_time": F.col("_near.t"), "right_key": F.col("_near.k")}).drop("_side", "_key", "_near", "_stretch")


def nearest_join(left: DataFrame, right: DataFrame, by: str, time: str, left_key: str, right_key: str, tolerance_s: int = 720) -> DataFrame:
    """To each left row the right row of its series nearest in time, strictly within the tolerance; ties to the
    earlier one, then the smaller key. No join: both sides pass an ordered window forwards and one backwards per series and
    bucket of ten tolerances; a right row less than a tolerance from another bucket passes there too. So times that lie close cost no pairs.
    """
    us = micros(time)
    width = tolerance_s * 1_000_000
    bucket = lambda t: F.floor(t / (10 * width))
    a = left.select(by, F.col(left_key).alias("left_key"), us.alias("_t"), bucket(us).alias("_b"), F.lit(1).alias("_side"))
    b = right.select(by, F.col(right_key).alias("right_key"), us.alias("_t"), F.explode(F.sequence(bucket(us - width), bucket(us + width))).alias("_b"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).filter(F.col(by).isNotNull() & F.col("_t").isNotNull())
    passed = Window.partitionBy(by, "_b").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("rt"), "right_key"))
    seen = lambda order: F.last(entry, ignorenulls=True).over(passed.orderBy(order, "_side", F.desc("right_key")))
    met = both.withColumns({"_before": seen(F.asc("_t")), "_after": seen(F.desc("_t"))}).filter("_side = 1")
    gap = lambda c: F.abs(F.col("_t") - F.col(f"{c}.rt"))
    near = F.least(*(F.when(gap(c) < width, F.struct(gap(c).alias("gap"), F.col(f"{c}.rt").alias("rt"), F.col(f"{c}.right_key").alias("right_key"))) for c in ("_before", "_after")))
    best = met.select(by, "left_key", near.alias("x")).filter("x IS NOT NULL").groupBy(by, "left_key").agg(F.min("x").alias("x"))
    return best.select(by, "left_key", F.col("x.right_key").alias("right_key"), F.col("x.gap").alias("gap_us"))


def latest_fields(df: DataFrame, by: str, time: str, cols: Sequence[str], tie: str) -> DataFrame:
    """Per station the newest value of each field that is not null, and the newest time that gave one."""
    order = F.struct(time, tie)
    some = F.greatest(*(F.when(F.col(c).isNotNull(), F.col(time)) for c in cols)) if len(cols) > 1 else F.when(F.col(cols[0]).isNotNull(), F.col(time))
    return df.groupBy(by).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols), F.max(some).alias("last_time"))


def fresh(time: str, now: Column, max_age: str, max_future: str = "30 minutes") -> Column:
    """Not older than max_age, not further ahead than max_future; an unknown time is kept."""
    t = F.col(time)
    return t.isNull() | ((t >= now - F.expr(f"INTERVAL {max_age}")) & (t <= now + F.expr(f"INTERVAL {max_future}")))


def thin_by_cell(df: DataFrame, cell: Sequence[str], score: Column, key: str, penalty: Column | None = None, pin: Column | None = None) -> DataFrame:
    """One row per cell, of the least score; `penalty` is added to it; pinned rows always stay."""
    total = score + F.coalesce(penalty, F.lit(0)) if penalty is not None else score
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy(total, key)))
    return ranked.filter((F.col("_rank") == 1) | (pin if pin is not None else F.lit(False))).drop("_rank")


def cap_by_center(df: DataFrame, lat: float, lon: float, n: int, key: str, score: Column | None = None) -> DataFrame:
    """T4: at most n rows by squared distance to the centre plus score."""
    d = (F.col("lat") - lat) * (F.col("lat") - lat) + (F.col("lon") - lon) * (F.col("lon") - lon)
    return df.withColumn("distance2", d + (score if score is not None else F.lit(0))).orderBy("distance2", key).limit(n)


def newest(df: DataFrame, time: str, n: int, key: str) -> DataFrame:
    """T5: the newest n rows."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def rank_towns(towns: DataFrame, by: str, eta: str, name: str, n: int) -> DataFrame:
    """Per track the first n towns by time of arrival, with the number of all of them."""
    w = Window.partitionBy(by)
    return towns.withColumn("position", F.row_number().over(w.orderBy(eta, name))).withColumn("n_towns", F.count("*").over(w)).filter(F.col("position") <= n)


def count_by_category(df: DataFrame, category: Column) -> DataFrame:
    """A18"""
    return df.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def continuous_scores(pairs: DataFrame, by: Sequence[str], a: str = "sat", b: str = "radar", rain: float = 0.2) -> DataFrame:
    """Number, means, bias ratio, MAE, RMSE, correlation and rain-area fractions of paired values."""
    return pairs.groupBy(*by).agg(*continuous_columns(a, b, rain))


def continuous_columns(a: str = "sat", b: str = "radar", rain: float = 0.2) -> list[Column]:
    """A20 as columns of a group."""
    d = F.col(a) - F.col(b)
    return [
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.try_divide(F.avg(a), F.avg(b)).alias("bias"),
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr(a, b).alias("corr"),
        F.avg((F.col(a) >= rain).cast("double")).alias("area_a"), F.avg((F.col(b) >= rain).cast("double")).alias("area_b"),
    ]


def categorical_scores(pairs: DataFrame, thresholds: Sequence[float], by: Sequence[str], a: str = "sat", b: str = "radar") -> DataFrame:
    """Hits, misses, false alarms and POD, FAR, CSI per threshold."""
    s = pairs.groupBy(*by).agg(contingency(thresholds, a, b).alias("_k"))
    return with_skill(s.select(*by, F.inline("_k")))


def contingency(thresholds: Sequence[float], a: str = "sat", b: str = "radar") -> Column:
    """array<struct<threshold, hits, misses, false_alarms>> of a group."""
    hit = lambda x, y: F.count_if(x & y)
    over = lambda c, t: F.col(c) >= float(t)
    counts = lambda t: (hit(over(a, t), over(b, t)).alias("hits"), hit(~over(a, t), over(b, t)).alias("misses"), hit(over(a, t), ~over(b, t)).alias("false_alarms"))
    return F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *counts(t)) for t in thresholds))


def with_skill(counts: DataFrame) -> DataFrame:
    """POD, FAR and CSI beside hits, misses and false alarms."""
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return counts.withColumns({"pod": F.try_divide(h, h + m), "far": F.try_divide(f, h + f), "csi": F.try_divide(h, h + m + f)})


def first_of(df: DataFrame, by: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """De-duplication by a stable key, or by name and rounded position; the first in order stays."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def merge_intervals(df: DataFrame, by: str, start: str, end: str, gap: int, span: int = 1 << 20) -> DataFrame:
    """C14: runs of intervals at most `gap` apart, as (by, start, end, n).

    A series is walked in stretches of `span` positions: how far the stretches before reach comes as the first row of each;
    the rows of a stretch before its first new run belong to the last run begun before it.
    """
    rows = df.select(by, F.col(start).alias("_s"), F.col(end).alias("_e"), stretch_of(df, start, span).alias("_stretch"))
    along = Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(by, "_stretch").agg(F.max("_e").alias("_e")).withColumn("_e", F.max("_e").over(along)).filter("_e IS NOT NULL")
    both = rows.withColumn("_own", F.lit(1)).unionByName(reach.withColumns({"_s": F.lit(None).cast(rows.schema["_s"].dataType), "_own": F.lit(0)}))
    count = df.count()
    both = dealt(both, count, by, "_stretch")
    w = Window.partitionBy(by, "_stretch").orderBy("_own", "_s", "_e")
    reached = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.withColumn("_new", F.when(F.col("_own") == 0, 0).when(reached.isNull() | (F.col("_s") > reached + gap), 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_own = 1")
    parts = staged(marked.groupBy(by, "_stretch", "_run").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count("*").alias("_n")), "runs")
    begun = F.max(F.when(F.col("_run") > 0, F.struct("_stretch", "_run")))
    per = parts.groupBy(by, "_stretch").agg(begun.alias("_last"), F.max(F.when(F.col("_run") == 0, F.struct("_s", "_e", "_n"))).alias("_more"))
    carried = per.withColumn("_last", F.last("_last", ignorenulls=True).over(along)).filter("_more IS NOT NULL").select(by, "_last.*", "_more.*")
    whole = dealt(parts.filter("_run > 0").unionByName(carried), count, by, "_stretch").groupBy(by, "_stretch", "_run")
    return whole.agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.sum("_n").alias("n")).drop("_stretch", "_run")


def retire_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the old catalogue whose station the new one still lists."""
    return old.join(new.select(key).distinct().hint("merge"), key, "left_semi")


def merge_reports(catalog: DataFrame, bulk: DataFrame, detail: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Catalogue position wins, a detailed report wins field by field unless the bulk row is newer; a station
    that is not in the catalogue stays only with an id of five digits or of four letters and a digit."""
    c, b, d = (x.select(F.col(key), *(F.col(n).alias(f"{p}_{n}") for n in x.columns if n != key)) for x, p in ((catalog, "c"), (bulk, "b"), (detail, "d")))
    all_ = c.join(b.hint("merge"), key, "full_outer").join(d.hint("merge"), key, "full_outer")
    listed = F.col("c_lat").isNotNull() | F.col(key).cast("string").rlike(r"^\d{5}$|^[A-Z]{4}\d$")
    newer = F.col("b_time") > F.col("d_time")
    pick = {f: F.when(F.coalesce(newer, F.lit(False)), F.coalesce(f"b_{f}", f"d_{f}")).otherwise(F.coalesce(f"d_{f}", f"b_{f}")) for f in fields}
    return all_.filter(listed).select(key, F.coalesce("c_lat", "b_lat").alias("lat"), F.coalesce("c_lon", "b_lon").alias("lon"), *(v.alias(k) for k, v in pick.items()))


def motion_between(fixes: DataFrame, by: str, time: str, meters: Column) -> DataFrame:
    """Speed from the fix before in miles an hour, 1 to 250; `meters` is the distance to it."""
    w = Window.partitionBy(by).orderBy(time)
    hours = (micros(time) - F.lag(micros(time)).over(w)) / 3.6e9
    speed = F.try_divide(meters / 1609.344, F.abs(hours))
    return fixes.withColumn("mph", F.when(speed.isNotNull(), F.least(F.lit(250.0), F.greatest(F.lit(1.0), speed))))


def unwrap_lon(points: DataFrame, by: str, order: str, lon: str, width: float = 86_400) -> DataFrame:
    """Longitudes of a track moved by whole turns so that no step is over 180 degrees.

    A track is walked in stretches of `width` seconds (or units of `order`); each is moved by the turns of those before.
    """
    turn = lambda step: F.when(step > 180, -360).when(step < -180, 360).otherwise(0)
    rows = points.withColumn("_stretch", stretch_of(points, order, width))
    w = Window.partitionBy(by, "_stretch").orderBy(order)
    rows = rows.withColumn("_turn", turn(F.col(lon) - F.lag(lon).over(w)))
    rows = rows.withColumn("_turned", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(by, "_stretch").agg(F.min_by(lon, order).alias("_first"), F.max_by(lon, order).alias("_last"), F.sum("_turn").alias("_turns"))
    along = Window.partitionBy(by).orderBy("_stretch")
    ends = ends.withColumn("_moved", turn(F.col("_first") - F.lag("_last").over(along)) + F.coalesce(F.lag("_turns").over(along), F.lit(0)))
    ends = ends.select(F.col(by).alias("_by"), F.col("_stretch").alias("_at"), F.sum("_moved").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_moved"))
    out = rows.join(ends.hint("merge"), F.col(by).eqNullSafe(F.col("_by")) & F.col("_stretch").eqNullSafe(F.col("_at")))
    return out.withColumn("lon_unwrapped", F.col(lon) + F.col("_turned") + F.col("_moved")).drop("_stretch", "_turn", "_turned", "_by", "_at", "_moved")
