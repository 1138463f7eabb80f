"""What the operators of this subpackage share: tables, staging and text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts have it: `[\x20\x09-\x0D]`; bytes.split() and strip() use the same set.
BLANKS = " \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null ids: fold of the empty text)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose column is not in the first column of gone; any other column of df may have any name. Null values stay."""
    taken, name = {c.lower() for c in df.columns}, "gone"
    while name in taken:
        name += "_"
    left_out = gone.toDF(name).filter(F.col(name).isNotNull()).distinct().hint("merge")
    return df.join(left_out, df[column] == left_out[name], "left_anti")


def integral(df: DataFrame, column: str) -> Column:
    """The column as a long; other ids than whole numbers are refused when the plan is made, not by a task."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} is {kind}: give whole-number ids, for instance a table that numbers yours")
    return df[column].cast("long")


def sums_before(counts: DataFrame, keys: list[str], at: str, n: str, span: int = 4096) -> DataFrame:
    """(keys, at, before): the sum of n over the rows of the same keys with a smaller `at`; counts has one row per (keys, at).

    Rows are summed in stretches of `span` values of `at` first, so a hot key is spread over tasks. Null keys are a key.
    """
    inner = Window.partitionBy(*keys, "whole").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("whole").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select(*keys, at, F.col(n).alias("n"), F.floor(F.col(at) / span).alias("whole"))
    sums = rows.groupBy(*keys, "whole").agg(F.sum("n").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    sums = sums.select(*(F.col(k).alias(f"{k}_of") for k in (*keys, "whole")), "ahead")
    within = rows.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in (*keys, "whole")]
    return within.join(sums.hint("merge"), same).select(*keys, at, (F.col("ahead") + F.col("inside")).alias("before"))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is named, as in tests on one machine."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="skyframe-"))
    return _OWN[0]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and sizes are real."""
    path = f"{shared_dir(df.sparkSession)}/skyframe-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut record batches so that each slice holds about `size` bytes of text; a longer text comes alone."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        lengths, first, held = pc.fill_null(pc.binary_length(text), 0).to_pylist(), 0, 0
        for i, length in enumerate(lengths):
            if held and held + length > size:
                yield batch.slice(first, i - first), text.slice(first, i - first).to_pylist()
                first, held = i, 0
            held += length
        if first < len(lengths):
            yield batch.slice(first), text.slice(first).to_pylist()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5, held_out: int = 0, rows: int = 4000) -> DataFrame:
    """(place long, text, y int) of at most `rows` labelled documents outside the held-out fold, whatever their length.

    The documents are the first in the order of a hash of their ids, the same on every run; place is that order. Their ids are
    few enough to broadcast, their texts stay with the workers.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_out))
    drawn = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    drawn = drawn.select(F.col("doc_id").alias("drawn"), F.xxhash64("doc_id").alias("place"), "y")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), F.col("id") == F.col("drawn")).select("place", "text", "y")
