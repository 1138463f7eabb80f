"""Best-fit packing of token sequences.

Documents are tokenised where they lie; only (id, piece, start, length, crc) go on. Lengths are whole
numbers up to the capacity, so best-fit decreasing over all documents depends on the histogram of lengths
alone: at most `capacity` counts reach the driver, whatever the input. A segment tree over remaining
capacities finds the tightest open bin; documents of one length that go to bins of one remaining capacity
are placed by one tree query. The resulting rules (length, rank range -> bin range, offset) are applied to all
pieces by their rank within their length, which Spark computes in salted cells.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.common import LOWER, slices, staged, sums_before

_CACHES: dict[str, "WordEncoder"] = {}
_PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: a byte that prints stands for itself, the others for 256, 257, ... in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in prints)}


class WordEncoder:
    """text bytes -> its ids as little-endian unsigned 32-bit bytes.

    Words between ASCII blanks are encoded once each and kept, at most `most`: this tokenizer's patterns never
    cross white space. A word of letters, with or without ASCII marks after it, is one or two pre-tokens and goes
    straight to the BPE model; anything else goes through the whole tokenizer. Stems and marks are kept apart from
    words, since ids depend on where the pre-token ends: what a text gets never depends on what was met before.
    """

    LETTERS = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole, self.most = Tokenizer.from_file(path), most
        self.known: dict[bytes, bytes] = {}  # words
        self.parts: dict[bytes, bytes] = {}  # stems of letters only, and runs of ASCII marks
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.bpe = BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"])
        self.letters = _byte_letters()

    def _all(self, text: bytes) -> bytes:
        return array("I", self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _pretoken(self, piece: bytes) -> bytes:
        return array("I", [t.id for t in self.bpe.tokenize(piece.decode("latin-1") if piece.isascii() else "".join(map(self.letters.__getitem__, piece)))]).tobytes()

    def _stem(self, stem: bytes) -> bytes | None:
        """Ids of a stem that is one pre-token of plain Latin letters; None for any other."""
        if stem.isascii():
            return self._pretoken(stem)
        letters = stem.decode("utf-8", "replace")
        if not letters.isalpha() or max(letters) >= "\u0250" or "\u0130" in letters:
            return None
        return self._pretoken(unicodedata.normalize("NFC", letters).lower().encode())

    def _word(self, word: bytes) -> bytes:
        if not (m := self.LETTERS.fullmatch(word)):
            return self._all(word)
        stem, marks = m.groups()
        if (ids := self.parts.get(stem)) is None:
            if (ids := self._stem(stem)) is None:
                return self._all(word)
            self.parts[stem] = ids
        if not marks:
            return ids
        if (end := self.parts.get(marks)) is None:
            end = self.parts[marks] = self._all(marks)
        return ids + end

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        out = []
        for text in texts:
            if b"<|" in (text or b""):  # may hold the strings of special tokens
                out.append(self._all(text))
                continue
            words = (text or b"").translate(LOWER).split()
            known = self.known
            if len(known) > self.most:
                known.clear()
                self.parts.clear()
            for x in set(words).difference(known):
                known[x] = self._word(x)
            out.append(b"".join(map(known.__getitem__, words)))
        return out


def _encoder(path: str) -> WordEncoder:
    if path not in _CACHES:
        _CACHES[path] = WordEncoder(path)
    return _CACHES[path]


def _tokenise(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), array("I", [end_id]).tobytes()
        for batch, texts in slices(batches):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for row, ids in enumerate(encode(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, value in zip(cols, (row, piece, at // 4, len(part) // 4, crc32(part)), strict=True):
                        col.append(value)
            rows = batch.column(0).take(pa.array(cols[0], pa.int64()))
            numbers = [pa.array(c, k) for c, k in zip(cols[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([rows, *numbers], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's ids and the end id, cut at `capacity`."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_tokenise(tokenizer_path, end_id, capacity), _PIECES.format(id=rows.schema["id"].dataType.simpleString()))


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: the number of open bins of each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = self.size + remaining
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least `length` that an open bin has, in O(log capacity)."""
        at = self.size + length
        if self.open[at]:
            return length
        while at > 1 and not (at % 2 == 0 and self.open[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_rules(counts: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, end rank, first bin, offset, copies): the documents of this length with these
    ranks fill bins from `first bin` on, `copies` in each, the first of them at `offset`. A bin that takes
    one document of a length is then the tightest for the next, so it takes as many as fit.
    The number of rows depends on the capacity, not on the number of documents.
    """
    tree, bins, rules, used = CapacityTree(capacity), defaultdict(list), [], 0
    for length, left in sorted(counts, reverse=True):
        rank = 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, many = capacity, -(-left // (capacity // length))
                first, used = used, used + many
            else:
                first, many = bins[remaining].pop()
                tree.add(remaining, -many)
            copies = remaining // length
            full = min(many, left // copies)
            rest = left - full * copies if full < many else 0
            for at, n, each in ((first, full, copies), (first + full, 1 if rest else 0, rest)):
                if n:
                    rules.append((length, rank, rank + n * each, at, capacity - remaining, each))
                    rank, left = rank + n * each, left - n * each
                    if remaining - each * length:
                        bins[remaining - each * length].append((at, n))
                        tree.add(remaining - each * length, n)
            if over := many - full - (1 if rest else 0):
                bins[remaining].append((first + full + (1 if rest else 0), over))
                tree.add(remaining, over)
    return rules


def pack(pieces: DataFrame, capacity: int = 2048, cell: int = 256) -> DataFrame:
    """Add sequence_id and offset to pieces (id, piece, start, length, ids_crc32), 1 <= length <= capacity.

    Equal rows are told apart by their order; sequences are gapless from offset 0. An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = [(r["length"], r["count"]) for r in pieces.groupBy("length").count().collect()]  # at most `capacity` rows
    rules = spark.createDataFrame(best_fit_rules(counts, capacity), "length long, rank_from long, rank_to long, bin long, at long, copies long")
    cells = spark.createDataFrame([(n, -(-c // cell)) for n, c in counts], "length long, cells long")
    order = [F.col(c) for c in ("id", "piece", "start", "ids_crc32")]
    salted = pieces.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64(*order), F.col("cells")))
    before = sums_before(salted.groupBy("length", "cell").agg(F.count("*").alias("n")), ["length"], "cell", "n")
    ranked = (
        salted.join(before.hint("merge"), ["length", "cell"])
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "cell").orderBy(*order)) - 1)
    )
    hit = (ranked["length"] == rules["length"]) & (ranked["rank"] >= rules["rank_from"]) & (ranked["rank"] < rules["rank_to"])
    nth = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(rules), hit).select(
        "id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("bin") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("copies")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack. Null and empty texts are the end id alone; rows that repeat an id are packed each."""
    pieces = staged(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "token-pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
