"""Benchmark decontamination by pigeonhole edit matching.

A test item of length n may occur in a document with up to e = floor(rate * n) edits. Cut into e + 1 pieces, one
piece then occurs unchanged. An Aho-Corasick automaton over all pieces reads each document once; where a piece
hits, Myers' bit-parallel algorithm computes the exact edit distance of the item to the surrounding text.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import LOWER, slices, without

#: ASCII: letters lower-cased, digits as they are, all else a blank; other bytes are left for later.
_ASCII = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
_BUILT: dict[str, tuple] = {}


def normalise(text: bytes | str) -> str:
    """Lower-cased words with one space between them; punctuation and white space do not count."""
    data = (text.encode("utf-8", "replace") if isinstance(text, str) else text).translate(_ASCII)
    words = b" ".join(data.split()).decode("utf-8", "replace")
    if words.isascii():
        return words
    words = words.lower()
    if apart := [c for c in set(words) if c != " " and not c.isalnum()]:
        words = " ".join(words.translate(dict.fromkeys(map(ord, apart), " ")).split())
    return words


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces (offset, piece) of near-equal length that make up the item."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=200_000)
def _places(item: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    return where


def least_distance(item: str, text: str) -> int:
    """The least edit distance of the item to any substring of the text: Myers' algorithm, a bit per character of the item."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where = _places(item)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up = (mh | ~(xv | ph)) & full
        down = ph & xv
    return best


def ancestors(n: int, piece: int) -> list[tuple[int, int]]:
    """The runs [lo, hi) of pieces that halving n pieces gives around one piece, smallest first, without itself and the whole."""
    lo, hi, out = 0, n, []
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if piece < mid else (mid, hi)
        out.append((lo, hi))
    return out[-2::-1]


def matches(text: str, automaton, items: list[tuple[int, str, int]]) -> dict[int, int]:
    """item id -> least distance, for the items that a normalised text holds within their budget.

    Of an item with at most e errors in e + 1 pieces, one half has fewer errors than pieces, and so on down to
    one piece. So a hit must hold in ever longer runs of j pieces with at most j - 1 errors before the whole
    item is compared. An item of budget 0 that starts and ends with a space must be there as whole words.
    """
    spans: dict[int, list[list[int]]] = defaultdict(list)
    text = f" {text} "
    last = len(text) - 1
    for end, hits in automaton.iter(text):
        for k, offset, length, runs in hits:
            at = end - length + 1 - offset
            if all(least_distance(part, text[max(1, at + a - j) : min(last, at + a + len(part) + j)]) <= j for a, part, j in runs):
                _, item, e = items[k]
                spans[k].append([max(1, at - e), min(last, at + len(item) + e)] if e else [at, at + len(item)])
    found: dict[int, int] = {}
    for k, ranges in spans.items():
        name, item, e = items[k]
        merged: list[list[int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        best = 0 if any(item in text[a:b] for a, b in merged) else min(least_distance(item, text[a:b]) for a, b in merged)
        if best <= e:
            found[name] = min(best, found.get(name, best))
    return found


def wanted_item(text: str, rate: float, whole_under: int) -> tuple[str, int] | None:
    """(what to look for, edits) of an item's text: whole words without edits under `whole_under` characters; None without words."""
    item = normalise(text)
    if not item:
        return None
    return (f" {item} ", 0) if len(item) < whole_under else (item, int(rate * len(item)))


def _automaton(items: list[tuple[int, str, int]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    held: dict[str, list] = defaultdict(list)
    for k, (_, item, e) in enumerate(items):
        cut = pieces(item, e)
        for n, (offset, piece) in enumerate(cut):
            runs = [(cut[lo][0], "".join(p for _, p in cut[lo:hi]), hi - lo - 1) for lo, hi in ancestors(len(cut), n)]
            held[piece].append((k, offset, len(piece), runs))
    for piece, hits in held.items():
        automaton.add_word(piece, hits)
    automaton.make_automaton()
    return automaton


def _scan(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = (_automaton(shared.value), shared.value)
        automaton, items = _BUILT[name]
        for batch, texts in slices(batches):
            rows, found, far = [], [], []
            for row, text in enumerate(texts):
                for item, distance in matches(normalise(text or b""), automaton, items).items():
                    rows.append(row)
                    found.append(item)
                    far.append(distance)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64()), pa.array(far, pa.int32())], ["id", "item_id", "distance"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.08, whole_under: int = 20, block_chars: int = 1_000_000) -> DataFrame:
    """(id_col, item_id, distance): the items (item_id, text) that a document holds with at most floor(rate * length) edits.

    Lengths and edits are of normalised text. Items under `whole_under` normalised characters, which other words hold
    by chance, have to be there as whole words, without edits. Null items and items without a letter or digit are found
    nowhere. Items go to the workers in blocks of about `block_chars` characters, one pass over docs each, so what is
    broadcast is bounded however many there are. Null and empty documents hold nothing. A row per id and item: documents
    that share an id, null ids included, are one, and an item id with several texts has the least distance of them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id long, distance int"
    wanted = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-(wanted.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().collect()
        held = sorted((r["item_id"], *x) for r in block if (x := wanted_item(r["text"], rate, whole_under)))
        if held:
            out = out.union(rows.mapInArrow(_scan(spark.sparkContext.broadcast(held), uuid.uuid4().hex), schema))
    return out.groupBy("id", "item_id").agg(F.min("distance").alias("distance")).withColumnRenamed("id", id_col)


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **rules) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows with a null id stay."""
    return without(docs, id_col, contaminated(docs, items, id_col, **rules).select(id_col))
