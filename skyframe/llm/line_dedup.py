"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Text is read once to hash lines and once to drop them; only 16-byte hashes are shuffled in between.
A hot line is counted by (hash, document) first, so no task sees all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import LOWER, slices, staged

_KEYS = "id {id}, h1 long, h2 long"


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").translate(LOWER)


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128 bits of the line's key as two signed longs; None for a line too short to count."""
    key = line_key(line)
    if len(key) < min_chars or _code_points(key) < min_chars:
        return None
    value = xxhash.xxh3_128_digest(key)
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows, h1, h2 = [], [], []
            for row, text in enumerate(texts):
                if not text:
                    continue
                found = {line_hash(x, min_chars) for x in text.split(b"\n")} - {None}
                rows += [row] * len(found)
                h1 += [x[0] for x in found]
                h2 += [x[1] for x in found]
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["id", "h1", "h2"])

    return run


def _reassemble(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            kept, lines, dropped = [], [], []
            for text, drops in zip(texts, batch.column(2).to_pylist(), strict=True):
                parts = (text or b"").split(b"\n")
                stay = parts
                if drops:
                    gone = {(x["h1"], x["h2"]) for x in drops}
                    stay = [x for x in parts if line_hash(x, min_chars) not in gone]
                kept.append(b"\n".join(stay).decode("utf-8", "replace"))
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "kept_text", "n_lines", "n_dropped"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Lines whose key occurs in at least `min_docs` documents stay only in the largest id that holds them.

    Returns (id_col, kept_text, n_lines, n_dropped), a row per row of docs; `keep` names the columns of docs to return
    in place of id_col. Null or empty text is one empty line: kept_text is then ''. Rows that repeat an id count as one document. A row with
    a null id keeps all its lines and counts for none. A line that repeats inside the document that keeps it stays as
    often as it is there. An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(c) for c in keep or (id_col,))).alias("row"))
    kind = rows.schema["id"].dataType.simpleString()
    keys = staged(rows.filter("id IS NOT NULL").select("id", "text").mapInArrow(_explode(min_chars), _KEYS.format(id=kind)), "line-keys")
    common = staged(keys.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs), "common-lines")
    drops = (
        keys.join(common.select("h1", "h2", "keeper").hint("merge"), ["h1", "h2"])
        .filter(F.col("id") != F.col("keeper"))
        .groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    )
    schema = f"row {rows.schema['row'].dataType.simpleString()}, kept_text string, n_lines long, n_dropped long"
    return rows.join(drops.hint("merge"), "id", "left").select("id", "text", "drops", "row").mapInArrow(_reassemble(min_chars), schema).select("row.*", "kept_text", "n_lines", "n_dropped")
