"""Cases of the fourth review that took too much disk."""

import math
import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from skyframe.operators import satellite, series, shapes


def test_pairs_take_little_room(spark, tmp_path):
    """Times of a slice come round at even steps: a pair takes less than a third of a byte of Parquet."""
    begin, k = F.lit("2024-01-01").cast("timestamp_ntz"), F.col("id")
    a = spark.range(1500).select((k * 7919 % 100_003).alias("id"), begin.alias("sent"), F.lit(None).cast("timestamp_ntz").alias("onset"), F.lit(None).cast("timestamp_ntz").alias("ends"), F.lit(False).alias("cancel"))
    t = spark.range(4000).select((k * 104_729 % 1_000_003).alias("place"), (begin + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))).alias("time"))
    shapes.active_at(a, t, per_task=2_000_000).select("place", "id").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 1500 * 4000
    assert sum(p.stat().st_size for p in Path(tmp_path, "out").glob("*.parquet")) < 1500 * 4000 / 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_nearest_in_time_is_found_without_pairs(spark):
    """Ties to the earlier time, then to the smaller key; times on both sides of a bucket's end; null series meet nothing."""
    rng, begin = random.Random(5), datetime(2024, 1, 1)
    rows = lambda n, k0: [(rng.choice(["a", "b", "b", None]), k0 + k if k % 50 else None, None if k % 41 == 0 else begin + timedelta(seconds=rng.randrange(0, 40_000, 20))) for k in range(n)]
    left, right = rows(400, 0), [*rows(300, 1000), *(("c", 5000 + k, begin + timedelta(seconds=9 * k)) for k in range(20))]
    left += [("c", 900 + k, begin + timedelta(seconds=k)) for k in (0, 4, 5, 13, 171, 290, 291, 292)]
    made = lambda of: spark.createDataFrame(of, "by string, key long, time timestamp_ntz")
    out = series.nearest_join(made(left), made(right), "by", "time", "key", "key", 120)
    assert "Join" not in plan_of(out)
    want = {}
    for b, k, t in left:
        met = [(abs(t - u), u, -math.inf if of is None else of) for c, of, u in right if b and b == c and t and u and abs(t - u) < timedelta(seconds=120)]
        if met:
            want[(b, k)] = min([min(met), *([want[(b, k)]] if (b, k) in want else [])])
    got = {(r["by"], r["left_key"]): (timedelta(microseconds=r["gap_us"]), -math.inf if r["right_key"] is None else r["right_key"]) for r in out.collect()}
    assert len(got) > 100 and got == {k: (gap, of) for k, (gap, _, of) in want.items()}


def test_cells_and_pixels_meet_where_their_scene_is(spark):
    """Functions give the cells and pixels of scenes that pair, without a shuffle of either; tables give the same."""
    k = F.col("id")
    at = lambda s: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("double"))
    scenes = spark.range(60).select(k.alias("scene"), at(k * 300).alias("time"), *((v + k % 9).alias(c) for c, v in (("west", -105.0), ("south", 30.0), ("east", -100.0), ("north", 35.0))))
    frames = spark.range(40).select((100 + k).alias("frame"), at(k * 400 + 7).alias("time"))
    grid = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def cells(of):
        made = of.select("*", grid(14, "i")).select("*", grid(9, "j"))
        return made.withColumns({"lon": -106.0 + F.col("i"), "lat": 29.5 + F.col("j"), "radar": (F.col("frame") + F.col("i") * 3 + F.col("j")) % 11 - 1.0}).drop("i", "j")

    def pixels(of):
        return of.select("*", grid(4, "row")).select("*", grid(4, "col")).withColumn("sat", F.when(F.col("row") != F.col("col"), (F.col("scene") + F.col("row") * 5 + F.col("col")) % 7.0))

    row, col = F.col("north") - F.col("lat"), F.col("lon") - F.col("west")
    out = satellite.verification_pairs(scenes, pixels, frames, cells, row, col, per_task=10)
    assert plan_of(out).count("Exchange") == plan_of(out).count("REPARTITION_BY_NUM") == 2
    tables = satellite.verification_pairs(scenes, pixels(scenes.select("scene")), frames, cells(frames.select("frame")), row, col)
    held = lambda df: sorted((r["scene"], r["frame"], r["lon"], r["lat"], r["radar"], r["sat"]) for r in df.collect())
    got, want = held(out), []
    for scene in range(60):
        gap, frame = min((abs(scene * 300 - f * 400 - 7), f) for f in range(40))
        w, n = -105.0 + scene % 9, 35.0 + scene % 9
        for i in range(14):
            for j in range(9):
                lon, lat, radar = -106.0 + i, 29.5 + j, (100 + frame + i * 3 + j) % 11 - 1.0
                r, c = math.floor(n - lat + 0.5), math.floor(lon - w + 0.5)
                if gap < 720 and w <= lon <= w + 5 and n - 5 <= lat <= n and radar >= 0 and 0 <= r < 4 and 0 <= c < 4 and r != c:
                    want.append((scene, 100 + frame, lon, lat, radar, (scene + r * 5 + c) % 7.0))
    assert len(want) > 200 and got == sorted(want) == held(tables)
    scores = satellite.verify_precip(out, "scene")
    assert "Join" not in plan_of(scores) and scores.count() == 3 * (1 + len({w[0] for w in want}))
