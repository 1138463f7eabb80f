"""Gridded fields as rows (grid keys..., i, j, value): aggregates, joins, boxes, accumulations, contours, extrema.

`by` names the columns that tell grids apart (run, hour, field); every operator handles all grids at once. Boxes
and contours need dense grids, so they first join a skeleton of all cells (W7 is wrong on sparse rows otherwise).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions import geo
from skyframe.operators.joins import dealt, dimension


def ensemble_mean(cells: DataFrame, by: Sequence[str], members: int) -> DataFrame:
    """Mean over the members present; null where fewer than half of the members are."""
    enough = F.count_distinct("member") >= -(-members // 2)
    return cells.groupBy(*by).agg(F.when(enough, F.avg("value")).alias("value"), F.count_distinct("member").alias("n_members"))


def blend(a: DataFrame, others: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Mean of all grids on the first one's cells, null unless all are there."""
    out = a.withColumn("_v0", F.col("value"))
    for k, o in enumerate(others, 1):
        out = out.join(o.select(*by, F.col("value").alias(f"_v{k}")).hint("merge"), list(by), "left")
    total = sum((F.col(f"_v{k}") for k in range(1, len(others) + 1)), F.col("_v0"))
    return out.select(*by, (total / (len(others) + 1)).alias("value"))


def pool_grid(cells: DataFrame, factor: int, how: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """Blocks of factor x factor cells; max for the field, mean for overlays; nulls are skipped."""
    f = {"max": F.max, "mean": F.avg}[how]
    return cells.groupBy(*by, F.floor(F.col("i") / factor).alias("i"), F.floor(F.col("j") / factor).alias("j")).agg(f("value").alias("value"))


def downsample(cells: DataFrame, ni: int, nj: int, step: int, by: Sequence[str] = ()) -> DataFrame:
    """Block means without the ragged edge, with the block's centre."""
    whole = cells.filter((F.col("i") < ni // step * step) & (F.col("j") < nj // step * step))
    return pool_grid(whole, step, "mean", by).withColumns({"ci": F.col("i") * step + (step - 1) / 2, "cj": F.col("j") * step + (step - 1) / 2})


def grid_extrema(cells: DataFrame, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """Least and greatest value from the floor up, and where (ties: first by j, i)."""
    seen = cells.filter(F.col("value") >= floor)
    lo, hi = F.min(F.struct("value", "j", "i")), F.min(F.struct((-F.col("value")).alias("v"), "j", "i"))
    return seen.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi")).select(*by, F.col("lo.value").alias("min_value"), F.col("lo.i").alias("min_i"), F.col("lo.j").alias("min_j"), (-F.col("hi.v")).alias("max_value"), F.col("hi.i").alias("max_i"), F.col("hi.j").alias("max_j"))


def grid_bbox(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bounds of the cells that have data."""
    return cells.filter(F.col("value").isNotNull()).groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in "ij" for n, f in (("min", F.min), ("max", F.max))))


def nearest_cell(lon: Column, lat: Column, lon1: float, lat1: float, di: float, dj: float, ni: int, nj: int, wraps: bool = False) -> tuple[Column, Column]:
    """i, j of the cell centre nearest to a point (rows run from north to south); null outside."""
    x = F.pmod(lon - lon1, F.lit(360.0)) if wraps else lon - lon1
    i, j = F.floor(x / di + 0.5), F.floor((F.lit(lat1) - lat) / dj + 0.5)
    i = F.pmod(i, F.lit(ni)) if wraps else i
    inside = (i >= 0) & (i < ni) & (j >= 0) & (j < nj)
    return F.when(inside, i), F.when(inside, j)


def sample_grid(points: DataFrame, cells: DataFrame, by: Sequence[str] = (), **grid) -> DataFrame:
    """The value of the nearest cell at each point (lon, lat), of the point's own grid (`by`: run, hour, ...); null outside."""
    i, j = nearest_cell(F.col("lon"), F.col("lat"), **grid)
    c = cells.select(F.col("i").alias("_ci"), F.col("j").alias("_cj"), "value", *(F.col(k).alias(f"_{k}_of") for k in by))
    at = points.withColumns({"gi": i, "gj": j})
    same = [F.col("gi") == F.col("_ci"), F.col("gj") == F.col("_cj"), *(F.col(k) == F.col(f"_{k}_of") for k in by)]
    return at.join(c.hint("merge"), same, "left").drop("_ci", "_cj", *(f"_{k}_of" for k in by))


def align_grids(a: DataFrame, b: DataFrame, ratio: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Cells of grids that share geometry, or of grids whose cells are `ratio` of the other's wide, grid by grid: (by..., i, j, a, b)."""
    r = b.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("value").alias("b"), *(F.col(k).alias(f"_{k}_of") for k in by))
    l = a.select(*by, "i", "j", F.col("value").alias("a"), F.floor(F.col("i") / ratio).alias("_i"), F.floor(F.col("j") / ratio).alias("_j"))  # noqa: E741
    return l.join(r.hint("merge"), [F.col("_i") == F.col("bi"), F.col("_j") == F.col("bj"), *(F.col(k) == F.col(f"_{k}_of") for k in by)]).select(*by, "i", "j", "a", "b")


def align_unlike(a: DataFrame, b: DataFrame, grids_a: DataFrame, grids_b: DataFrame, by: Sequence[str] = (), tolerance: float = 1e-4) -> DataFrame:
    """J3 for grids of any geometry: (by..., i, j, a, b), every cell of a with the value of b over it, null where b has none.

    grids_a, grids_b: a row per grid, (by..., lon1, lat1, di, dj, ni, nj), lon1 and lat1 the centre of cell (0, 0), rows
    from north to south. Grids of equal size whose origins agree within the tolerance meet cell by cell; else each cell of a
    takes the cell of b whose centre is nearest to its own, none outside of b.
    """
    shape = ("lon1", "lat1", "di", "dj", "ni", "nj")
    ga = grids_a.select(*(F.col(k).alias(f"_{k}_a") for k in by), *(F.col(c).alias(f"_a_{c}") for c in shape))
    gb = grids_b.select(*(F.col(k).alias(f"_{k}_b") for k in by), *(F.col(c).alias(f"_b_{c}") for c in shape))
    if by:
        both = ga.join(gb.hint("merge"), [F.col(f"_{k}_a") == F.col(f"_{k}_b") for k in by])
        cells = a.join(dimension(both), [F.col(k) == F.col(f"_{k}_a") for k in by], "left")
    else:
        cells = a.crossJoin(F.broadcast(ga.limit(1))).crossJoin(F.broadcast(gb.limit(1)))
    close = lambda c: F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) < tolerance
    same = (F.col("_a_ni") == F.col("_b_ni")) & (F.col("_a_nj") == F.col("_b_nj")) & close("lon1") & close("lat1")
    lon, lat = F.col("_a_lon1") + F.col("i") * F.col("_a_di"), F.col("_a_lat1") - F.col("j") * F.col("_a_dj")
    i = F.when(same, F.col("i")).otherwise(F.floor((lon - F.col("_b_lon1")) / F.col("_b_di") + 0.5))
    j = F.when(same, F.col("j")).otherwise(F.floor((F.col("_b_lat1") - lat) / F.col("_b_dj") + 0.5))
    inside = i.between(0, F.col("_b_ni") - 1) & j.between(0, F.col("_b_nj") - 1)
    at = cells.select(*by, "i", "j", F.col("value").alias("a"), F.when(inside, i).alias("_i"), F.when(inside, j).alias("_j"))
    r = b.select(F.col("i").alias("_bi"), F.col("j").alias("_bj"), F.col("value").alias("b"), *(F.col(k).alias(f"_{k}_of") for k in by))
    met = [F.col("_i") == F.col("_bi"), F.col("_j") == F.col("_bj"), *(F.col(k) == F.col(f"_{k}_of") for k in by)]
    return at.join(r.hint("merge"), met, "left").select(*by, "i", "j", "a", "b")


def crop_grid(cells: DataFrame, west: float, south: float, east: float, north: float, lon1: float, lat1: float, di: float, dj: float) -> DataFrame:
    """Cells whose centres lie in a box; west over east crosses the date line. Rows run from north to south."""
    lon, lat = F.pmod(lon1 + F.col("i") * di + 180, F.lit(360.0)) - 180, lat1 - F.col("j") * dj
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return cells.filter(across & lat.between(south, north))


def normalize_rows(cells: DataFrame, grids: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of grids (by..., nj, lat1, dj, scan_mode) that run from south to north are turned round: (cells, lat1 of the north edge)."""
    g = grids.select(*(F.col(k).alias(f"_{k}_of") for k in by), "nj", F.col("lat1").alias("_lat1"), "dj", (F.col("scan_mode").bitwiseAND(64) != 0).alias("_turn"))
    met = cells.join(dimension(g), [F.col(k) == F.col(f"_{k}_of") for k in by])
    out = met.withColumn("j", F.when(F.col("_turn"), F.col("nj") - 1 - F.col("j")).otherwise(F.col("j"))).withColumn("lat1", F.when(F.col("_turn"), F.col("_lat1") + (F.col("nj") - 1) * F.col("dj")).otherwise(F.col("_lat1")))
    return out.drop(*(f"_{k}_of" for k in by), "nj", "_lat1", "dj", "_turn")


def dense(cells: DataFrame, ni: int, nj: int, by: Sequence[str] = ()) -> DataFrame:
    """All ni x nj cells of every grid; value is null where there was none."""
    grids = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    every = grids.select(*by, F.explode(F.sequence(F.lit(0), F.lit(ni - 1))).alias("i")).select(*by, "i", F.explode(F.sequence(F.lit(0), F.lit(nj - 1))).alias("j"))
    return every.join(cells.hint("merge"), [*by, "i", "j"], "left")


def box_stats(cells: DataFrame, ni: int, nj: int, r: int, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Sum, count, max and min of `value` over the (2r+1)-cell box around every cell, as two windows."""
    across = Window.partitionBy(*by, "j").orderBy("i").rangeBetween(-r, r)
    down = Window.partitionBy(*by, "i").orderBy("j").rangeBetween(-r, r)
    rows = ni * nj * (cells.select(*by).distinct().count() if by else 1)
    d = dealt(dense(cells, ni, nj, by).withColumn("_v", value.cast("double")), rows, *by, "j")
    d = d.withColumns({"_s": F.sum("_v").over(across), "_n": F.count("_v").over(across), "_hi": F.max("_v").over(across), "_lo": F.min("_v").over(across)})
    return dealt(d, rows, *by, "i").withColumns({"box_sum": F.sum("_s").over(down), "box_n": F.sum("_n").over(down), "box_max": F.max("_hi").over(down), "box_min": F.min("_lo").over(down)}).drop("_v", "_s", "_n", "_hi", "_lo")


def box_mean(cells: DataFrame, ni: int, nj: int, r: int, max_value: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the values under max_value in each box, null if there is none."""
    out = box_stats(cells, ni, nj, r, F.when(F.col("value") < max_value, F.col("value")), by)
    return out.withColumn("mean", F.try_divide("box_sum", "box_n"))


def box_sum(cells: DataFrame, ni: int, nj: int, r: int, by: Sequence[str] = ()) -> DataFrame:
    """W8"""
    return box_stats(cells, ni, nj, r, F.col("value"), by).withColumn("sum", F.coalesce("box_sum", F.lit(0.0)))


def accumulation(cells: DataFrame, by: Sequence[str], hours: int) -> DataFrame:
    """Total over the last `hours`, never under 0; the run total where that is as long; null if an end is missing."""
    then = cells.select(*by, (F.col("hour") + hours).alias("hour"), F.col("value").alias("_then"))
    joined = cells.join(then.hint("merge"), [*by, "hour"], "left")
    return joined.select(*by, "hour", F.when(F.col("hour") <= hours, F.col("value")).otherwise(F.greatest(F.lit(0.0), F.when(F.col("_then").isNotNull(), F.col("value") - F.col("_then")))).alias("total"))


def snow(cells: DataFrame, by: Sequence[str], hours: int, ratio: Column | float = 10.0) -> DataFrame:
    """Snow depth of W10 by a ratio: 10, or the Kuchera ratio of a column."""
    return accumulation(cells, by, hours).withColumn("snow", F.col("total") * ratio)


def gaussian_smooth(cells: DataFrame, ni: int, nj: int, sigma: float = 1.2, lo: float = 0.0, hi: float = 1.0, radius: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian mean over 7 x 7 cells of the normalised value, grid by grid; missing cells of the grid count as -0.6,
    cells outside not at all. The weights are products of one for each axis: two passes over seven neighbours in a row."""
    weights = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)}

    def along(x: str, at: str, n: int, w) -> Column:
        near = lambda k: F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w) if k else F.col(x)
        total = sum((F.coalesce(near(k), F.lit(0.0)) * g for k, g in weights.items()), F.lit(0.0))
        inside = sum((F.when((F.col(at) + k).between(0, n - 1), g).otherwise(0.0) for k, g in weights.items()), F.lit(0.0))
        return total / inside

    across, down = Window.partitionBy(*by, "j").orderBy("i"), Window.partitionBy(*by, "i").orderBy("j")
    d = dense(cells, ni, nj, by).select(*by, "i", "j", F.coalesce((F.col("value") - lo) / (hi - lo), F.lit(-0.6)).alias("_x"))
    d = d.withColumn("_x", along("_x", "i", ni, across))
    return d.select(*by, "i", "j", along("_x", "j", nj, down).alias("smooth"))


def pressure_centers(cells: DataFrame, ni: int, nj: int, r: int, prominence: float, split: float, by: Sequence[str] = ()) -> DataFrame:
    """Cells that top or bottom a complete box and stand out from its edge by `prominence`; H from `split` up, else L."""
    d = box_stats(cells, ni, nj, r, F.col("value"), by)
    row = Window.partitionBy(*by, "j").orderBy("i").rangeBetween(-r, r)
    col = Window.partitionBy(*by, "i").orderBy("j").rangeBetween(-r, r)
    d = d.withColumns({"_rmax": F.max("value").over(row), "_rmin": F.min("value").over(row), "_cmax": F.max("value").over(col), "_cmin": F.min("value").over(col)})
    up, left = Window.partitionBy(*by, "i").orderBy("j"), Window.partitionBy(*by, "j").orderBy("i")
    ends = lambda c, w: (F.lag(c, r).over(w), F.lead(c, r).over(w))
    d = d.withColumns({"_emax": F.greatest(*ends("_rmax", up), *ends("_cmax", left)), "_emin": F.least(*ends("_rmin", up), *ends("_cmin", left))})
    full = F.col("box_n") == (2 * r + 1) ** 2
    high = (F.col("value") >= F.col("box_max")) & (F.col("value") - F.col("_emax") >= prominence) & (F.col("value") >= split)
    low = (F.col("value") <= F.col("box_min")) & (F.col("_emin") - F.col("value") >= prominence) & (F.col("value") < split)
    score = F.when(high, F.col("value") - F.col("_emax")).otherwise(F.col("_emin") - F.col("value"))
    return d.filter(full & (high | low)).select(*by, "i", "j", "value", F.when(high, "H").otherwise("L").alias("kind"), score.alias("score"))


def suppress_nearby(df: DataFrame, by: str | Sequence[str], score: str, x: str, y: str, min_dist: float, limit: int) -> DataFrame:
    """By falling score, rows at least min_dist from all kept ones, at most `limit` per field (`by`: time, field, kind, ...).

    Each choice depends on those before it, so a field is one group; candidates of a field are few (W11's output).
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, y, x], ascending=[False, True, True], kind="stable")
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        kept, left = [], np.arange(len(pdf))
        while len(left) and len(kept) < limit:
            k = left[0]
            kept.append(k)
            left = left[(xs[left] - xs[k]) ** 2 + (ys[left] - ys[k]) ** 2 >= min_dist**2] if min_dist else left[1:]
            left = left[left != k]
        return pdf.iloc[kept]

    return df.groupBy(*([by] if isinstance(by, str) else by)).applyInPandas(pick, df.schema)


def contour_segments(cells: DataFrame, ni: int, nj: int, interval: float, min_level: float, by: Sequence[str] = ()) -> DataFrame:
    """Marching squares. Per cell of four present corners and level between them: (level, x1, y1, x2, y2); saddles give two segments."""
    d = dense(cells, ni, nj, by)
    row, col = Window.partitionBy(*by, "j").orderBy("i"), Window.partitionBy(*by, "i").orderBy("j")
    d = d.withColumn("b", F.lead("value").over(row)).withColumn("d", F.lead("value").over(col)).withColumn("c", F.lead("b").over(col)).withColumnRenamed("value", "a")
    whole = d.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull() & F.col("d").isNotNull())
    lo, hi = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    first, last = F.greatest(F.ceil(lo / interval), F.ceil(F.lit(min_level / interval))), F.floor(hi / interval)
    lev = whole.filter(first <= last).withColumn("level", F.explode(F.sequence(first, last))).withColumn("level", F.col("level") * interval)
    over = lambda c: F.when(F.col(c) >= F.col("level"), 1).otherwise(0)
    case = over("a") * 8 + over("b") * 4 + over("c") * 2 + over("d")
    t = lambda p, q: F.try_divide(F.col("level") - F.col(p), F.col(q) - F.col(p))
    x, y = F.col("i"), F.col("j")
    top, right = F.struct((x + t("a", "b")).alias("x"), y.cast("double").alias("y")), F.struct((x + 1).cast("double").alias("x"), (y + t("b", "c")).alias("y"))
    bottom, left = F.struct((x + t("d", "c")).alias("x"), (y + 1).cast("double").alias("y")), F.struct(x.cast("double").alias("x"), (y + t("a", "d")).alias("y"))
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    one = {(1, 14): (left, bottom), (2, 13): (bottom, right), (3, 12): (left, right), (4, 11): (top, right), (6, 9): (top, bottom), (7, 8): (left, top)}
    segs = None
    for codes, (p, q) in one.items():
        segs = F.when(case.isin(*codes), F.array(pair(p, q))) if segs is None else segs.when(case.isin(*codes), F.array(pair(p, q)))
    segs = segs.when(case == 5, F.array(pair(left, top), pair(bottom, right))).when(case == 10, F.array(pair(left, bottom), pair(top, right)))
    out = lev.withColumn("s", F.explode(segs))
    return out.select(*by, "level", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def contour_lines(segments: DataFrame, by: Sequence[str] = ("level",), least: int = 4) -> DataFrame:
    """Segments chained by their endpoints (4 decimals) into lines of at least 4 points: (by, line, points array<struct<x, y>>)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.select(*by).schema) + ", line int, points array<struct<x: double, y: double>>"

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        ends: dict[tuple, list] = {}
        segs = [((round(a, 4), round(b, 4)), (round(c, 4), round(d, 4))) for a, b, c, d in sorted(zip(pdf.x1, pdf.y1, pdf.x2, pdf.y2, strict=True))]
        for k, s in enumerate(segs):
            for p in s:
                ends.setdefault(p, []).append(k)
        used, out = [False] * len(segs), []

        def follow(line: list, at: tuple) -> None:
            while (k := next((k for k in ends[at] if not used[k]), None)) is not None:
                used[k] = True
                at = segs[k][1] if segs[k][0] == at else segs[k][0]
                line.append(at)

        for k, (p, q) in enumerate(segs):
            if not used[k]:
                used[k] = True
                line, back = [p, q], [p]
                follow(line, q)
                follow(back, p)
                line = back[:0:-1] + line
                if len(line) >= least:
                    out.append([{"x": x, "y": y} for x, y in line])
        key = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame([{**key, "line": n, "points": pts} for n, pts in enumerate(out)], columns=[*by, "line", "points"])

    return segments.groupBy(*by).applyInPandas(chain, schema)


def view_boxes(boxes: DataFrame, pad: float) -> DataFrame:
    """Boxes (west, south, east, north) wrapped and padded; one that crosses the date line becomes two."""
    wrap = lambda c: F.pmod(c + 180, F.lit(360.0)) - 180
    b = boxes.withColumns({"_w": wrap(F.col("west") - pad), "_e": wrap(F.col("east") + pad), "south": F.greatest(F.lit(-90.0), F.col("south") - pad), "north": F.least(F.lit(90.0), F.col("north") + pad)})
    part = lambda w, e: F.struct(w.alias("west"), e.alias("east"))
    parts = F.when(F.col("_w") <= F.col("_e"), F.array(part(F.col("_w"), F.col("_e")))).otherwise(F.array(part(F.col("_w"), F.lit(180.0)), part(F.lit(-180.0), F.col("_e"))))
    return b.drop("west", "east").withColumn("_p", F.explode(parts)).select("*", "_p.west", "_p.east").drop("_p", "_w", "_e")


def regrid_lambert(cells: DataFrame, bbox: tuple[float, float, float, float], step: float, x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Nearest sample of a Lambert grid on a lat/lon grid of `step` degrees over bbox (west, south, east, north); x, y project (lat, lon)."""
    w, s, e, n = bbox
    ni, nj = int((e - w) / step + 0.5), int((n - s) / step + 0.5)
    target = cells.sparkSession.range(ni * nj).select((F.col("id") % ni).cast("int").alias("ti"), F.floor(F.col("id") / ni).cast("int").alias("tj"))
    target = target.withColumns({"lon": w + (F.col("ti") + 0.5) * step, "lat": n - (F.col("tj") + 0.5) * step})
    at = target.withColumns({"_i": F.floor((x - x0) / dx + 0.5), "_j": F.floor((y - y0) / dy + 0.5)})
    c = cells.select(F.col("i").alias("_ci"), F.col("j").alias("_cj"), "value")
    return at.join(c.hint("merge"), (F.col("_i") == F.col("_ci")) & (F.col("_j") == F.col("_cj")), "left").select("ti", "tj", "value")


def resample_lambert(cells: DataFrame, grids: DataFrame, step: float = 0.025, by: Sequence[str] = (), pad: float = 0.05) -> DataFrame:
    """G11 on a box of its own: (by..., ti, tj, lon, lat, value), the nearest sample of each Lambert grid on a lat/lon grid of
    `step` degrees over the box of its border cells, padded; rows run from north to south, null outside of the source grid.

    grids: a row per grid, (by..., ni, nj, dx, dy, lo1, la1, latin1, latin2, lov, lad), lo1 and la1 the south-west corner.
    """
    rad, col = (lambda c: F.radians(F.col(c))), F.col
    tan = lambda p: F.tan(F.lit(math.pi / 4) + p / 2)
    p1, p2 = rad("latin1"), rad("latin2")
    g = grids.withColumn("_n", F.when(F.abs(p1 - p2) < 1e-9, F.sin(p1)).otherwise(F.log(F.cos(p1) / F.cos(p2)) / F.log(tan(p2) / tan(p1))))
    g = g.withColumn("_rf", geo.R_LAMBERT * F.cos(p1) * F.pow(tan(p1), "_n") / col("_n")).withColumn("_r0", col("_rf") / F.pow(tan(rad("lad")), "_n"))

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        turn, r = col("_n") * F.radians(lon - col("lov")), col("_rf") / F.pow(tan(F.radians(lat)), "_n")
        return r * F.sin(turn), col("_r0") - r * F.cos(turn)

    x0, y0 = forward(col("lo1"), col("la1"))
    g = g.withColumns({"_x0": x0, "_y0": y0})
    every = lambda n: F.sequence(F.lit(0), col(n) - 1, F.lit(8))
    ends = lambda n: F.array(F.lit(0), col(n) - 1)
    pairs = lambda outer, inner, swap: F.flatten(F.transform(outer, lambda u: F.transform(inner, lambda v: F.struct((v if swap else u).alias("i"), (u if swap else v).alias("j")))))
    border = g.withColumn("_b", F.explode(F.concat(pairs(every("ni"), ends("nj"), False), pairs(every("nj"), ends("ni"), True))))
    x, y = col("_x0") + col("_b.i") * col("dx"), col("_r0") - (col("_y0") + col("_b.j") * col("dy"))
    lon = col("lov") + F.degrees(F.atan2(x, y) / col("_n"))
    lat = F.degrees(2 * F.atan(F.pow(col("_rf") / (F.signum("_n") * F.sqrt(x * x + y * y)), 1 / col("_n")))) - 90
    keep = [c for c in g.columns if c not in by]
    box = border.withColumns({"_lon": lon, "_lat": lat}).groupBy(*by, *keep).agg(F.min("_lon").alias("_w"), F.max("_lon").alias("_e"), F.min("_lat").alias("_s"), F.max("_lat").alias("_t"))
    size = lambda lo, hi: F.ceil((col(hi) - col(lo) + 2 * pad) / step).cast("int")
    rows = box.withColumn("tj", F.explode(F.sequence(F.lit(0), size("_s", "_t") - 1))).repartition(*by, "tj")
    at = rows.withColumn("ti", F.explode(F.sequence(F.lit(0), size("_w", "_e") - 1)))
    at = at.withColumns({"lon": col("_w") - pad + col("ti") * step, "lat": col("_t") + pad - col("tj") * step})
    x, y = forward(col("lon"), col("lat"))
    at = at.withColumns({"_i": F.floor((x - col("_x0")) / col("dx") + 0.5), "_j": F.floor((y - col("_y0")) / col("dy") + 0.5)}).select(*by, "ti", "tj", "lon", "lat", "_i", "_j")
    c = cells.select(col("i").alias("_ci"), col("j").alias("_cj"), "value", *(col(k).alias(f"_{k}_of") for k in by))
    met = [col("_i") == col("_ci"), col("_j") == col("_cj"), *(col(k) == col(f"_{k}_of") for k in by)]
    return at.join(c.hint("merge"), met, "left").select(*by, "ti", "tj", "lon", "lat", "value")
