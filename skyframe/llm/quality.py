"""Quality: a byte-level convolutional network in numpy.

Texts are read as bytes in chunks that overlap by 64 bytes and cover all of them. Filters of 8 bytes at every
place look up learned responses per byte, each filter keeps its greatest response in a chunk, and the
greatest and the mean of these over all chunks make one probability. For training, workers cut the sampled texts,
whatever their length, and send a bounded number of chunks of each, drawn from all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import fold_of, labelled_sample, slices

CHUNK, OVERLAP, WIDTH, STEP, FILTERS, EMBED = 512, 64, 8, 1, 16, 6
#: Default number of chunks of a text that may take part in training.
CHUNKS = 48

def chunks(text: bytes) -> list[np.ndarray]:
    """Overlapping chunks that cover the text; a text shorter than a filter is padded with zero bytes."""
    data = np.frombuffer(text.ljust(WIDTH, b"\0"), dtype=np.uint8)
    return [data[a : a + CHUNK] for a in range(0, max(1, len(data) - OVERLAP), CHUNK - OVERLAP)]


def _responses(tables: np.ndarray, data: np.ndarray, first: np.ndarray, places: np.ndarray):
    """Greatest response per chunk and filter. `places` are filter starts in `data`, `first` where each chunk's begin."""
    total = tables[0][data[places]]
    for k in range(1, WIDTH):
        total += tables[k][data[places + k]]
    return total, np.maximum.reduceat(total, first, axis=0)


def _layout(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all chunks, the places where filters start (the last one ends with its chunk), and each chunk's first place."""
    data = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    n = (sizes - WIDTH + STEP - 1) // STEP + 1
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.minimum((np.arange(n.sum()) - np.repeat(first, n)) * STEP, np.repeat(sizes - WIDTH, n))
    return data, first, np.repeat(begin, n) + inside


def _features(best: np.ndarray, owner_first: np.ndarray):
    """Greatest and mean over the chunks of each text, after a rectifier."""
    held = np.maximum(best, 0)
    n = np.diff(np.append(owner_first, len(held)))
    return np.concatenate([np.maximum.reduceat(held, owner_first, axis=0), np.add.reduceat(held, owner_first, axis=0) / n[:, None]], axis=1)


def drawn_chunks(text: bytes, most: int = CHUNKS) -> list[np.ndarray]:
    """All chunks of a text, or `most` of them drawn from the whole of it, the same ones on every run."""
    cut = chunks(text)
    if len(cut) <= most:
        return cut
    return [cut[k] for k in sorted(np.random.default_rng(crc32(text)).choice(len(cut), most, replace=False))]


def _draw(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            cut = [[c.tobytes() for c in drawn_chunks(t or b"", most)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.binary())), batch.column(2)], ["place", "chunks", "y"])

    return run


def fit(rows: list[tuple[list[np.ndarray], int]], epochs: int = 12, seed: int = 11, sample: int = 4) -> dict:
    """The model of (chunks of a text, label) rows; an epoch sees at most `sample` chunks, drawn anew, of each text.

    Without both labels it scores every text as the share of label 1 (no rows: 0.5).
    """
    y = np.array([v for _, v in rows], dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return {"prior": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    cut = [c for c, _ in rows]
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.2, 2 * FILTERS), "shift": np.array(np.log(y.mean() / (1 - y.mean()))),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    balance = np.where(y == 1, 1.0, min(4.0, y.sum() / (len(y) - y.sum()))).astype(np.float32)
    size = 64
    for epoch in range(epochs):
        order, rate = rng.permutation(len(rows)), 0.02 * (1 - epoch / epochs) + 0.002
        for at in range(0, len(order), size):
            docs = order[at : at + size]
            picked = [[cut[k][i] for i in sorted(rng.choice(len(cut[k]), min(sample, len(cut[k])), replace=False))] for k in docs]
            owner_first = np.concatenate([[0], np.cumsum([len(c) for c in picked])[:-1]])
            data, first, places = _layout([c for cs in picked for c in cs])
            tables = np.einsum("be,kef->kbf", p["embed"], p["filters"])
            total, best = _responses(tables, data, first, places)
            best = best + p["bias"]
            x = _features(best, owner_first)
            logit = x @ p["out"] + p["shift"]
            d = (1 / (1 + np.exp(-logit)) - y[docs]) * balance[docs] / len(docs)
            dx = d[:, None] * p["out"]
            n = np.diff(np.append(owner_first, len(best)))
            held = np.maximum(best, 0)
            owner = np.repeat(np.arange(len(docs)), n)
            top = (held == x[owner, :FILTERS]) & (held > 0)
            d_best = (top * dx[owner, :FILTERS] + dx[owner, FILTERS:] / n[owner][:, None]) * (best > 0)
            # The first place of each chunk's greatest response takes the gradient.
            span = np.diff(np.append(first, len(total)))
            is_best = total >= np.repeat(best - p["bias"], span, axis=0)
            where = np.minimum.reduceat(np.where(is_best, np.arange(len(total))[:, None], len(total) - 1), first, axis=0)
            d_tables = np.zeros_like(tables)
            columns = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(d_tables[k], (data[places[where] + k], columns), d_best)
            g = {"embed": np.einsum("kbf,kef->be", d_tables, p["filters"]), "filters": np.einsum("be,kbf->kef", p["embed"], d_tables), "bias": d_best.sum(axis=0), "out": x.T @ d, "shift": d.sum()}
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    tables = np.einsum("be,kef->kbf", p["embed"], p["filters"]).astype(np.float32)
    return {"prior": float(y.mean()), "tables": tables, "bias": p["bias"], "out": p["out"], "shift": float(p["shift"])}


class Scorer:
    def __init__(self, model: dict):
        self.model = model

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores 0..1; null and empty texts are scored as zero bytes."""
        m = self.model
        if "tables" not in m or not texts:
            return np.full(len(texts), m["prior"])
        out, cut = [], [chunks(t or b"") for t in texts]
        best = []
        flat = [c for cs in cut for c in cs]
        for at in range(0, len(flat), 256):
            data, first, places = _layout(flat[at : at + 256])
            best.append(_responses(m["tables"], data, first, places)[1])
        owner_first = np.concatenate([[0], np.cumsum([len(c) for c in cut])[:-1]]).astype(np.int64)
        out = _features(np.concatenate(best) + m["bias"], owner_first) @ m["out"] + m["shift"]
        return 1 / (1 + np.exp(-out.astype(np.float64)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch, texts in slices(batches, size=1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(texts), pa.float64())], ["id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, rows: int = 4000, threshold: float = 0.3, text_chunks: int = CHUNKS, epoch_chunks: int = 4) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs (doc_id, text), learned from labels (doc_id, quality).

    The fit is on a bounded sample: at most `rows` labelled texts, of each at most `text_chunks` chunks of 512 bytes drawn from
    all of it (a text of up to 21 kB has no more), and `epoch_chunks` of these, drawn anew, in each epoch. Every text is scored
    whole. Fold 0 of 5 by crc32 of the id is held out. Null and empty texts are
    scored as zero bytes. Rows that repeat an id are scored each, a null id stays null. Only the text enters a score.
    """
    drawn = labelled_sample(docs, labels, "quality", rows=rows).mapInArrow(_draw(text_chunks), "place long, chunks array<binary>, y int").collect()
    drawn.sort(key=lambda r: (r["place"], r["chunks"]))
    shared = docs.sparkSession.sparkContext.broadcast(fit([([np.frombuffer(c, np.uint8) for c in r["chunks"]], r["y"]) for r in drawn], sample=epoch_chunks))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), f"id {kind}, score double")
    return scored.select(F.col("id").alias("doc_id"), (fold_of("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
