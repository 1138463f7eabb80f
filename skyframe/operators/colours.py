"""Values to colours by tables of 1024 steps, one for each palette, with alpha."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.operators.joins import dimension

STEPS = 1024
CHANNELS = ("red", "green", "blue", "alpha")


def color_tables(palettes: DataFrame, palette: str = "palette", segments: str = "segments") -> DataFrame:
    """(palette, lo, hi, step, red, green, blue, alpha), 1024 rows per palette of `segments` array<struct<pos, v, c1, c2>>.

    Entries go by value, then position. Between two entries colours run from c1 to c2, or to the next entry's c1 without
    one; alpha is 255 where it is missing; channels are rounded and kept in a byte. Palettes without segments have no rows.
    """
    ordered = F.array_sort(F.transform(segments, lambda s: F.struct(s["v"].alias("v"), s["pos"].alias("pos"), s["c1"].alias("c1"), s["c2"].alias("c2"))))
    p = palettes.filter(F.size(segments) > 0).select(F.col(palette).alias("palette"), ordered.alias("_s"))
    p = p.withColumns({"lo": F.col("_s")[0]["v"], "hi": F.element_at("_s", -1)["v"], "_n": F.size("_s")})
    p = p.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    v = F.col("lo") + F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")) * F.col("step") / (STEPS - 1)
    inner = F.slice("_s", 2, F.greatest(F.col("_n") - 2, F.lit(0)))
    p = p.withColumn("_v", v).withColumn("_k", F.size(F.filter(inner, lambda s: F.col("_v") > s["v"])))
    p = p.withColumns({"_a": F.get("_s", F.col("_k")), "_b": F.get("_s", F.least(F.col("_k") + 1, F.col("_n") - 1))})
    t = F.when(F.col("_b.v") > F.col("_a.v"), (F.col("_v") - F.col("_a.v")) / (F.col("_b.v") - F.col("_a.v"))).otherwise(0.0)
    p = p.withColumns({"_t": F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), "_to": F.coalesce("_a.c2", "_b.c1")})

    def channel(k: int):
        start, end = (F.coalesce(F.get(c, F.lit(k)), F.lit(255.0 if k == 3 else 0.0)) for c in ("_a.c1", "_to"))
        return F.pmod(F.floor(start + (end - start) * F.col("_t") + 0.5), F.lit(256)).cast("int")

    return p.select("palette", "lo", "hi", "step", *(channel(k).alias(c) for k, c in enumerate(CHANNELS)))


def colour_by_table(df: DataFrame, value: str, palette: str, tables: DataFrame) -> DataFrame:
    """df with red, green, blue and alpha of `value` by the table of its palette, flat beyond the palette's ends.

    Null and NaN values and values of unknown palettes have no colour; a palette of one value has its first colour up to that
    value and its last beyond. A value becomes a step of its palette's range, and
    (palette, step) is looked up, so a row carries no table; tables are broadcast up to 100,000 steps, merge-joined beyond.
    """
    ends = tables.filter("step = 0").select(F.col("palette").alias("_palette"), "lo", "hi")
    at = df.join(dimension(ends), F.col(palette) == F.col("_palette"), "left")
    v = F.col(value).cast("double")
    share = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise((v > F.col("hi")).cast("double"))
    step = F.when(share.isNotNull() & ~F.isnan(v), F.least(F.lit(STEPS - 1), F.greatest(F.lit(0), F.floor(share * (STEPS - 1) + 0.5))))
    at = at.withColumn("_step", step.cast("int")).drop("_palette", "lo", "hi")
    held = tables.select(F.col("palette").alias("_palette"), F.col("step").alias("_at"), *CHANNELS)
    return at.join(dimension(held), (F.col(palette) == F.col("_palette")) & (F.col("_step") == F.col("_at")), "left").drop("_step", "_palette", "_at")
