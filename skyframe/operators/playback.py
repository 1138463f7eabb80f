"""A product for every frame of a period, kept as a table with a partition per frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyframe.sources.shared import staged

#: A product of frames: gets the rows of the frames and the columns that tell frames apart, gives rows with these columns.
FrameProduct = Callable[[DataFrame, Sequence[str]], DataFrame]


def _read(spark, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def last_frames(frames: DataFrame, frame: str, n: int) -> DataFrame:
    """The rows of the newest n frames."""
    newest = frames.select(frame).distinct().orderBy(F.desc(frame)).limit(n)
    return frames.join(F.broadcast(newest), frame, "left_semi")


def product_series(frames: DataFrame, frame: str, product: FrameProduct, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The product of all frames, as (its columns, frame), read from the table at `path` (in a shared folder).

    Frames that the table holds already are not worked out again; the others go through `product` in one call, whose
    joins, windows and groups have the frame among their keys, and are written as a partition for each. A ledger beside
    the table names what is there, frames without any row included. It is written last, so a run that fails halfway is
    made up for by the next, which replaces the frames' partitions. A null frame takes no part.
    """
    spark = frames.sparkSession
    ledger = _read(spark, f"{path}/ledger", frames.select(frame).schema)
    known = frames.filter(F.col(frame).isNotNull())
    todo = known.join(ledger.withColumnRenamed(frame, "_done").distinct().hint("merge"), F.col(frame) == F.col("_done"), "left_anti")
    todo = staged(todo, "frames-to-do")
    made = product(todo, [frame, *by])
    new = todo.select(frame).distinct()
    if new.limit(1).count():
        # rows of a frame come together, and a frame with very many of them is split
        made.hint("rebalance", frame).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(frame).parquet(f"{path}/frames")
        new.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    rest = [f for f in made.schema if f.name != frame]
    return _read(spark, f"{path}/frames", StructType([*rest, frames.schema[frame]]))
