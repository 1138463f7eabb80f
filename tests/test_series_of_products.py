"""Series of products written frame by frame, colour tables, sources by hour, nearest sites: against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyframe.operators import colours, playback, products, shapes


def test_frames_are_worked_out_once(spark, tmp_path):
    asked, path = [], f"{tmp_path}/series"

    def doubled(df, by):
        asked.append(sorted(r[0] for r in df.select("frame").distinct().collect()))
        return df.filter("v > 0").select(*by, (F.col("v") * 2).alias("w"), "cell")

    frames = spark.createDataFrame([(f, c, float(f * c)) for f in (1, 2, 3, 4) for c in range(5)] + [(0, 1, 0.0), (None, 1, 1.0)], "frame int, cell int, v double")
    first = playback.product_series(frames.filter("frame < 3"), "frame", doubled, path)
    assert {r["frame"] for r in first.collect()} == {1, 2}
    out = playback.product_series(frames, "frame", doubled, path)
    again = playback.product_series(frames, "frame", doubled, path)
    want = sorted((f, c, 2.0 * f * c) for f in (1, 2, 3, 4) for c in range(1, 5))
    assert sorted((r["frame"], r["cell"], r["w"]) for r in out.collect()) == want == sorted((r["frame"], r["cell"], r["w"]) for r in again.collect())
    assert asked == [[0, 1, 2], [3, 4], []]  # frame 0 has no rows, and is not asked for again
    assert playback.product_series(frames.limit(0), "frame", doubled, f"{tmp_path}/none").count() == 0
    assert {r["frame"] for r in playback.last_frames(frames, "frame", 2).collect()} == {3, 4}


def test_a_failed_run_is_made_up_for(spark, tmp_path):
    frames, path = spark.createDataFrame([(1, 1.0), (2, 2.0)], "frame int, v double"), f"{tmp_path}/series"
    frames.filter("frame = 1").withColumn("v", F.lit(-1.0)).write.partitionBy("frame").parquet(f"{path}/frames")  # left behind without a ledger
    out = playback.product_series(frames, "frame", lambda df, by: df.select(*by, "v"), path)
    assert sorted((r["frame"], r["v"]) for r in out.collect()) == [(1, 1.0), (2, 2.0)]


def table(segments):
    """1024 colours of [(v, c1, c2 or None)], colour by colour."""
    s = sorted(segments, key=lambda x: x[0])
    out, k = [], 0
    for i in range(1024):
        v = s[0][0] + ((s[-1][0] - s[0][0]) or 1) * i / 1023
        while k < len(s) - 2 and v > s[k + 1][0]:
            k += 1
        a, b = s[k], s[min(k + 1, len(s) - 1)]
        t = min(1, max(0, (v - a[0]) / (b[0] - a[0]))) if b[0] > a[0] else 0
        end = a[2] or b[1]
        out.append(tuple(math.floor(x + (y - x) * t + 0.5) for x, y in zip(a[1], end, strict=True)))
    return out


def test_color_tables(spark):
    rng = random.Random(9)
    color = lambda: [float(rng.randint(0, 255)) for _ in range(4)]
    held = {k: [(rng.choice([1.0, 2.0, rng.uniform(-50, 50)]), color(), rng.choice([None, color()])) for _ in range(rng.randint(1, 7))] for k in range(12)}
    rows = [(k, [(p, *s) for p, s in enumerate(seg)]) for k, seg in held.items()] + [(99, []), (98, None)]
    palettes = spark.createDataFrame(rows, "palette int, segments array<struct<pos: int, v: double, c1: array<double>, c2: array<double>>>")
    tables = colours.color_tables(palettes)
    got = {k: {} for k in held}
    for r in tables.collect():
        got[r["palette"]][r["step"]] = tuple(r[c] for c in colours.CHANNELS)
    for k, seg in held.items():
        assert [got[k][i] for i in range(1024)] == table(seg), seg
    values = [(n, k, v) for n, (k, v) in enumerate((k, v) for k in (*held, 98, None) for v in (-100.0, 0.0, 1.0, 17.3, 60.0, None, float("nan")))]
    out = {r["n"]: tuple(r[c] for c in colours.CHANNELS) for r in colours.colour_by_table(spark.createDataFrame(values, "n int, p int, value double"), "value", "p", tables).collect()}
    for n, k, v in values:
        lo, hi = (min(x[0] for x in held[k]), max(x[0] for x in held[k])) if k in held else (0, 0)
        if k not in held or v is None or math.isnan(v):
            assert out[n] == (None,) * 4
        else:
            assert out[n] == got[k][min(1023, max(0, math.floor(((v - lo) / (hi - lo) if hi > lo else v > hi) * 1023 + 0.5)))]


def test_sources_by_hour(spark):
    cells = spark.createDataFrame([(1, h, 0, 0, v, "sfc", f"0-{h} hour acc fcst", x * h) for h in range(0, 13, 3) for v, x in (("A", 1.0), ("B", 10.0))], "run int, hour int, i int, j int, var string, level string, acc string, value double")
    mine = products.with_product({}, "P", [products.by_hour((0, 6, ("A", "sfc")), (7, None, ("B", "sfc")))])
    mine = products.with_product(mine, "W", [products.by_hour((0, 6, products.Field("A", "sfc", total=True)), (7, None, products.Field("B", "sfc", total=True)))], window=3)
    got = {(r["id"], r["hour"]): r["value"] for r in products.products(cells, ["P", "W"], mine).collect()}
    assert {h: v for (k, h), v in got.items() if k == "P"} == {0: 0.0, 3: 3.0, 6: 6.0, 9: 90.0, 12: 120.0}
    assert {h: v for (k, h), v in got.items() if k == "W"} == {0: 0.0, 3: 3.0, 6: 3.0, 9: 30.0, 12: 30.0}  # a window's two ends are of the source of its own hour


@pytest.mark.parametrize("where", ["all", "far", "poles"])
def test_nearest_site(spark, where):
    rng = random.Random(3)
    spread = {"all": (180, -90, 90), "far": (2, 40, 42), "poles": (180, 86, 90)}[where]
    sites = [(k, rng.uniform(-1, 1) * spread[0], rng.uniform(*spread[1:]), rng.random() < 0.2) for k in range(400)] + [(900, None, 1.0, False), (901, 5.0, 5.0, None)]
    points = [(k, rng.uniform(-400, 400), rng.choice([rng.uniform(-90, 90), -90.0, 90.0])) for k in range(300)] + [(999, None, 3.0)]
    s, p = spark.createDataFrame(sites, "site int, lon double, lat double, terminal boolean"), spark.createDataFrame(points, "place int, lon double, lat double")
    got = {r["place"]: r["dist_m"] for r in shapes.nearest_site(p, s, "place", "terminal").collect()}
    rad = math.radians
    for k, lon, lat in points:
        if lon is None:
            assert got[k] is None
            continue
        h = min(math.sin(rad(b - lat) / 2) ** 2 + math.cos(rad(lat)) * math.cos(rad(b)) * math.sin(rad(a - lon) / 2) ** 2 for _, a, b, t in sites if a is not None and not t)
        assert got[k] == pytest.approx(2 * 6371008.8 * math.asin(min(1, math.sqrt(h))), rel=1e-9, abs=1e-3)
    assert {r["site"] for r in shapes.nearest_site(p, s.limit(0), "place").collect()} == {None}
