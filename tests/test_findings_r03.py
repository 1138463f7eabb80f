"""Cases of the third review that went wrong or took too long."""

from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from skyframe.functions.geo import fixed_grid
from skyframe.operators import grid, products, satellite, series, shapes
from skyframe.plans.base import Inputs
from skyframe.plans.registry import ORACLES, QUERIES
from skyframe.sources.shared import shared_dir


def test_an_extent_of_many_scenes_is_navigated_once(spark):
    scan, held = fixed_grid(), lambda: set(Path(shared_dir(spark)).glob("skyframe-scene-extents-*"))
    k, before = F.col("id") % 3, held()
    scenes = spark.range(900).select(F.col("id").alias("scene"), *(F.when(F.col("id") % 9 != 8, (a + k * 0.01)).alias(c) for c, a in (("x0", -0.05), ("y0", -0.04), ("x1", -0.03), ("y1", -0.01))))
    got = satellite.scene_bbox(scenes, scan["lon"], scan["lat"]).collect()
    assert len(got) == 900 and len({(r["west"], r["south"], r["east"], r["north"]) for r in got}) == 4
    assert {r["scene"] for r in got if r["west"] is None} == set(range(8, 900, 9))
    (table,) = held() - before
    assert spark.read.parquet(str(table)).count() == 4


def agrees(spark, path, name, **tables):
    """Whether a query and its SQL give the same rows over small tables of one's own."""
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(path))
    cols = ", ".join(f'"{c}"' for c in got.columns)
    rows = lambda found: sorted(map(repr, found))
    want = con.execute(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall()
    assert len(want) and rows(tuple(r) for r in got.collect()) == rows(want)


def given(spark, table, where):
    return spark.read.parquet(f"/root/testdata/sf0.1/{table}.parquet").filter(where)


def test_a_mean_of_rates_does_not_depend_on_the_order_of_its_sum(spark, tmp_path):
    rates = [(k, k + i, r) for k in range(40) for i, r in enumerate((0.01, 0.07, 0.03, 0.05, 0.09, 0.0, 0.02, 0.05)[k % 5 :] if k % 5 in (0, 1) else (0.01, 0.02, 0.09))]
    lines = spark.createDataFrame([(12 * n, 4 * n, k, 1, 1.0, r, r) for k, n, r in rates], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    means = {r["run"]: (r["d"], r["x"]) for r in Inputs(spark, str(tmp_path)).d("grid").collect()}
    held = {k: [round(100 * r) for of, _, r in rates if of == k] for k in means}
    assert means == {k: (sum(v) / len(v),) * 2 for k, v in held.items()}


def test_points_of_different_places_have_different_keys(spark, tmp_path):
    agrees(spark, tmp_path, "m34_lines_of_runs", lineitem=given(spark, "lineitem", "l_suppkey IN (164, 401, 738)"))


def test_scores_without_radar_rain_and_at_ties(spark, tmp_path):
    pairs = [(176336, 76343), (293762, 93768), (331288, 31286), (436616, 36623)]
    e = spark.createDataFrame([(of, hour, kind) for hour, pair in enumerate(pairs) for of, kind in zip(pair, ("view", "click"), strict=True)], "event_id long, hour int, event_type string")
    e = e.select("event_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), "hour")).alias("ts"), "event_type")
    agrees(spark, tmp_path, "r10_verification_run", events=e)


def test_a_parcel_starts_as_warm_as_its_surroundings(spark, tmp_path):
    lines = given(spark, "lineitem", "l_suppkey IN (32, 49, 378, 511, 542, 640, 834)")
    agrees(spark, tmp_path, "w24_w25_parcel_buoyancy", lineitem=lines)
    out = QUERIES["w24_w25_parcel_buoyancy"](spark, str(tmp_path)).filter("p = 1000")
    assert out.count() == 7 and out.filter("sign <> 0").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_intervals_are_dealt_out_by_their_number(spark):
    rows = spark.range(1_300_000).select((F.col("id") % 7).alias("file"), (F.col("id") * 3).alias("s"), (F.col("id") * 3 + 5).alias("e"))
    out = series.merge_intervals(rows, "file", "s", "e", 20)
    assert "REPARTITION_BY_NUM" in plan_of(out)
    got = {r["file"]: (r["start"], r["end"], r["n"]) for r in out.collect()}
    assert got == {k: (3 * k, 3 * max(range(k, 1_300_000, 7)) + 5, len(range(k, 1_300_000, 7))) for k in range(7)}
    assert "REPARTITION_BY_NUM" not in plan_of(series.merge_intervals(rows.limit(100), "file", "s", "e", 20))


def test_pairs_of_flashes_and_scenes_are_not_shuffled(spark):
    t = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("time")
    flashes, scenes = spark.range(40).select(t, F.lit(1).alias("row"), F.lit(2).alias("col")), spark.range(40).select(F.col("id").alias("scene"), t)
    out = satellite.recent_flash_counts(flashes, scenes)
    assert plan_of(out).count("Exchange") == 2
    assert {r["scene"]: r["n"] for r in out.collect()} == {k: min(k, 5) for k in range(1, 40)}


def test_granules_that_fit_a_task_are_shuffled_once(spark):
    k = F.col("id")
    f = spark.range(300_000).select((k % 3000).alias("run"), F.floor(k / 30_000).alias("scan"), (F.floor(k / 3000) % 10).alias("fov"), (20 + F.floor(k / 30_000) * 0.3).alias("lat"), (F.floor(k / 3000) % 10 * 0.3).alias("lon"), F.lit(2.0).alias("value"))
    out = satellite.swath_to_grid(f, by=["run"])
    assert plan_of(out).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan_of(out)
    one, some = satellite.swath_to_grid(f.filter("run = 7")), out.filter("run = 7").drop("run")
    rows = lambda df: sorted((r["i"], r["j"], round(r["value"], 9)) for r in df.collect())
    assert rows(one) == rows(some) != []


def test_boxes_of_many_frames_are_dealt_out_by_their_number(spark):
    cells = spark.range(9000).select(F.col("id").alias("run"), F.lit(3).alias("i"), F.lit(4).alias("j"), F.lit(5.0).alias("value"))
    out = grid.box_mean(cells, 12, 12, 2, 60, ["run"])
    assert plan_of(out).count("REPARTITION_BY_NUM") == 2
    assert "REPARTITION_BY_NUM" not in plan_of(grid.box_mean(cells.filter("run < 9"), 12, 12, 2, 60, ["run"]))
    assert out.filter("mean = 5").count() == 9000 * 25


def test_alerts_of_a_bucket_share_a_timer_that_moves(spark, tmp_path):
    """Timers fire while later changes are due, so a bucket's timer is set again; one batch, as the query has it."""
    orders = spark.range(1, 400).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 3 == 0, "P").otherwise("O").alias("o_orderstatus"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 9).cast("int"))).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    agrees(spark, tmp_path, "x5_alert_life", orders=orders)


def test_variants_of_models_are_worked_out_in_one_grouping(spark):
    assert plan_of(QUERIES["m3_m17_model_variants"](spark, "/root/testdata/sf0.001")).count("FileScan") == 1
    fields = (("APCP", "surface", "0-6 hour acc fcst", 9.0), ("APCP", "surface", "0-12 hour acc fcst", 14.0), ("WEASD", "surface", "6 hour fcst", 4.0), ("LTNG", "surface", "", 3.0), ("LTNG", "entire atmosphere", "", 5.0), ("DPT", "2 m above ground", "", 281.0))
    cells = spark.createDataFrame([(1, hour, 2, 3, *f) for hour in (6, 12) for f in fields if f[0] != "APCP" or f[2].startswith(f"0-{hour} ")], "run int, hour int, i int, j int, var string, level string, acc string, value double")
    ids = {None: ["LTNG", "QPF6"], "gfs": ["SNOWT", "QPF6"], "gefsens": ["SNOWT", "DPT"], "rap": ["LTNG"]}
    rows = lambda df: sorted((*r,) for r in df.collect())
    got = products.products_of_models(cells, ids)
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    got = {m: rows(got.filter(F.col("model").eqNullSafe(F.lit(m))).drop("model")) for m in ids}
    assert got == {m: rows(products.products(cells, of, model=m)) for m, of in ids.items()}
    assert [v for *_, v in got[None]] == [5.0, 5.0, 9.0, 5.0] and [v for *_, v in got["gefsens"]] == [281.0, 281.0, 40.0, 40.0] and [v for *_, v in got["rap"]] == [3.0, 3.0]


def test_pairs_of_a_day_are_dealt_to_many_tasks(spark):
    """One day holds most times and alerts: no task gets all of its pairs, and none is lost or told twice."""
    begin = F.lit("2024-01-01").cast("timestamp_ntz")
    hour = lambda h: begin + F.make_dt_interval(F.lit(0), h.cast("int"))
    k = F.col("id")
    a = spark.range(600).select("id", hour(k % 24).alias("sent"), F.lit(None).cast("timestamp_ntz").alias("onset"), F.when(k % 50 != 0, hour(k % 24 + k % 5)).alias("ends"), (k % 7 == 0).alias("cancel"))
    t = spark.range(700).select(k.alias("place"), hour(F.when(k % 10 == 0, k).otherwise(k % 24)).alias("time"), F.create_map(k, k).alias("tags"))
    out = shapes.active_at(a, t, per_task=20_000).withColumn("task", F.spark_partition_id())
    tasks = {r["task"]: r["count"] for r in out.groupBy("task").count().collect()}
    got = sorted((r["place"], r["id"]) for r in out.collect())
    at = lambda p: p if p % 10 == 0 else p % 24
    assert got == [(p, i) for p in range(700) for i in range(600) if i % 7 and i % 24 <= at(p) and (i % 50 == 0 or at(p) < i % 24 + i % 5)]
    assert "_s2" not in out.columns and len(tasks) > 4 and max(tasks.values()) < len(got) / 3
