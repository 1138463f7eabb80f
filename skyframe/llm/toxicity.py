"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A step reads one word as two inputs: the word itself and its character 3- to 5-grams, both hashed to buckets
that hold smoothed log-odds learned from labelled rows (out of fold while the network is trained on them).
The network reads windows of 32 words, each overlapping the next by 8, that cover the whole text; a text scores as its
worst window. It is trained on the windows that matter: the worst of each toxic text, the worst few of each clean one.
Workers read the sampled texts, whatever their length: first they count buckets, then they pick a few windows of each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import LOWER, fold_of, labelled_sample, slices, staged

BUCKETS = 1 << 16
STEPS, STRIDE, HIDDEN, INPUTS = 32, 24, 8, 6


# Words and their inputs


def _grams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 3, 4, 5: (word places in order, buckets) of every character n-gram of <word>."""
    data = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes, dtype=np.int32), sizes) - np.arange(len(data), dtype=np.int32)
    h = data * np.uint32(0x01000193) ^ data[np.minimum(np.arange(len(data)) + 1, len(data) - 1)]
    for n in (3, 4, 5):
        m = max(0, len(data) - n + 1)
        h = h[:m] * np.uint32(0x01000193) ^ data[n - 1 : n - 1 + m]
        whole = left[:m] >= n
        yield owner[:m][whole], (h[whole] * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.intp)


def _buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of these words and of their character n-grams, each once."""
    grams = np.zeros(BUCKETS, dtype=bool)
    for at in range(0, len(words), 2000):
        for _, found in _grams(words[at : at + 2000]):
            grams[found] = True
    return np.unique(np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % BUCKETS), np.flatnonzero(grams)


def _inputs(words: list[bytes], word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """(words, INPUTS): log-odds of the word; greatest, mean and least of its character grams; length; marks."""
    out = np.zeros((len(words), INPUTS), dtype=np.float32)
    for at in range(0, len(words), 2000):
        part, o = words[at : at + 2000], out[at : at + 2000]
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        total, most, least, n = np.zeros(len(part), np.float32), np.full(len(part), -99, np.float32), np.full(len(part), 99, np.float32), np.zeros(len(part))
        for owners, buckets in _grams(part):
            if len(owners):
                odds = gram_odds[buckets]
                first = np.flatnonzero(np.diff(owners, prepend=-1))
                k = owners[first]
                most[k] = np.maximum(most[k], np.maximum.reduceat(odds, first))
                least[k] = np.minimum(least[k], np.minimum.reduceat(odds, first))
                total[k] += np.add.reduceat(odds, first)
                n[k] += np.diff(np.append(first, len(odds)))
        data = np.frombuffer(b"a".join(part) + b"a", dtype=np.uint8)
        marks = np.add.reduceat(((data < 97) | (data > 122)) & (data < 128), np.cumsum(sizes + 1) - sizes - 1, dtype=np.int64)
        o[:, 0] = word_odds[np.fromiter(map(crc32, part), dtype=np.int64, count=len(part)) % BUCKETS]
        o[:, 1], o[:, 2], o[:, 3], o[:, 4], o[:, 5] = most, total / n, least, np.minimum(sizes, 20) / 10, np.minimum(marks, 20) / 5
    return out


def _odds(hits: np.ndarray, totals: np.ndarray, weight: float = 6.0) -> np.ndarray:
    """Log-odds of (clean, toxic) document counts per bucket, drawn to 0 where there are few."""
    share = totals / totals.sum()
    return (np.log((hits[1] + weight * share[1]) / (hits[0] + weight * share[0])) - np.log(share[1] / share[0])).astype(np.float32)


def window_starts(n: int) -> list[int]:
    """First words of the windows of an n-word text: overlapping, the last one ends with the text."""
    return [*range(0, max(1, n - STEPS), STRIDE), n - STEPS] if n > STEPS else [0]


# The network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(steps, mask, u, keep=None):
    """Hidden states (T, B, H) from the input part (B, 3H) of each step; mask (B, T) or None."""
    h, out = None, []
    for t, a in enumerate(steps):
        h = np.zeros((len(a), HIDDEN), dtype=np.float32) if h is None else h
        g = h @ u
        rz = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[:, t, None], new, h)
        if keep is not None:
            keep.append((h, r, z, n, g[:, 2 * HIDDEN :]))
        h = new
        out.append(h)
    return np.stack(out)


def _gru_back(d_out, mask, u, kept, du):
    """Gradients of the input parts (B, T, 3H); du is added to in place."""
    d_in, dh = [], 0
    for t in reversed(range(len(kept))):
        h, r, z, n, gn = kept[t]
        dh = dh + d_out[t]
        m = mask[:, t, None]
        dn, dz = np.where(m, dh * (1 - z), 0), np.where(m, dh * (h - n), 0)
        da_n = dn * (1 - n * n)
        d_rz = np.concatenate([da_n * gn * r * (1 - r), dz * z * (1 - z)], axis=1)
        dg = np.concatenate([d_rz, da_n * r], axis=1)
        du += h.T @ dg
        d_in.append(np.concatenate([d_rz, da_n], axis=1))
        dh = np.where(m, dh * z, dh) + dg @ u.T
    return np.stack(d_in[::-1], axis=1)


def _pool(p, states, mask):
    """Attention weights (T, B), pooled states (B, 2H) and logits."""
    a = np.tanh(states @ p["att"])
    e = a @ p["att_v"]
    if mask is not None:
        e = np.where(mask.T, e, -1e9)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = (w[:, :, None] * states).sum(axis=0)
    return a, w, pooled, pooled @ p["out"] + p["bias"]


def _train_step(p, x, mask, y, weight):
    """Weighted cross-entropy gradients of windows x (B, T, INPUTS)."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    back = {"f": slice(None), "b": slice(None, None, -1)}
    kept, states = {"f": [], "b": []}, []
    for d, way in back.items():
        a = x[:, way] @ p["w" + d] + p["c" + d]
        states.append(_gru([a[:, t] for t in range(x.shape[1])], mask[:, way], p["u" + d], kept[d])[way])
    s = np.concatenate(states, axis=2)
    a, w, pooled, logit = _pool(p, s, mask)
    d_logit = (_sigmoid(logit) - y) * weight / weight.sum()
    g["bias"] += d_logit.sum()
    g["out"] += pooled.T @ d_logit
    d_pooled = d_logit[:, None] * p["out"]
    dw = (s * d_pooled).sum(axis=2)
    de = w * (dw - (w * dw).sum(axis=0))
    g["att_v"] += (de[:, :, None] * a).sum(axis=(0, 1))
    da = de[:, :, None] * p["att_v"] * (1 - a * a)
    g["att"] += np.einsum("tbi,tbj->ij", s, da)
    ds = w[:, :, None] * d_pooled + da @ p["att"].T
    for i, (d, way) in enumerate(back.items()):
        d_in = _gru_back(ds[way, :, i * HIDDEN : (i + 1) * HIDDEN], mask[:, way], p["u" + d], kept[d], g["u" + d])
        g["w" + d] += np.einsum("bti,btj->ij", x[:, way], d_in)
        g["c" + d] += d_in.sum(axis=(0, 1))
    return g


def _logits(p, x, mask, block: int = 1024):
    if len(x) > block:
        return np.concatenate([_logits(p, x[at : at + block], mask[at : at + block]) for at in range(0, len(x), block)])
    s = np.concatenate([_gru([(x[:, way] @ p["w" + d] + p["c" + d])[:, t] for t in range(x.shape[1])], mask[:, way], p["u" + d])[way] for d, way in (("f", slice(None)), ("b", slice(None, None, -1)))], axis=2)
    return _pool(p, s, mask)[3]


# Training


def fold_of_text(text: bytes, folds: int) -> int:
    return crc32(text) % folds  # equal texts share a fold


class Counts:
    """How many clean and toxic documents of each fold have a word or an n-gram in each bucket."""

    def __init__(self, folds: int):
        self.folds, self.totals = folds, np.zeros((folds, 2))
        self.words, self.grams = np.zeros((folds, 2, BUCKETS), np.float32), np.zeros((folds, 2, BUCKETS), np.float32)

    def add(self, text: bytes, y: int) -> None:
        f, own = fold_of_text(text, self.folds), sorted(set(text.translate(LOWER).split()))
        words, grams = _buckets(own)
        self.totals[f, y] += 1
        self.words[f, y, words] += 1
        self.grams[f, y, grams] += 1

    def odds(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of words and n-grams by all other folds, or by all where the others lack a label."""
        rest = self.totals.sum(axis=0) - self.totals[f]
        if not rest.all():
            return self.all_odds()
        return _odds(self.words.sum(axis=0) - self.words[f], rest), _odds(self.grams.sum(axis=0) - self.grams[f], rest)

    def all_odds(self) -> tuple[np.ndarray, np.ndarray]:
        return _odds(self.words.sum(axis=0), self.totals.sum(axis=0)), _odds(self.grams.sum(axis=0), self.totals.sum(axis=0))


def training_windows(text: bytes, word_odds: np.ndarray, gram_odds: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (n, STEPS, INPUTS) and mask of up to `most` windows: those with the strongest words, a third of them drawn from all."""
    words = text.translate(LOWER).split()
    vocab = sorted(set(words))
    place = {w: i for i, w in enumerate(vocab)}
    table = np.concatenate([_inputs(vocab, word_odds, gram_odds), np.zeros((1, INPUTS), np.float32)])
    doc = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
    doc = np.append(doc, np.full(max(0, STEPS - len(doc)), len(vocab)))
    at = np.array(window_starts(len(words)))
    value = table[:, :2].sum(axis=1)
    strength = np.concatenate([np.sort(value[doc[at[k : k + 4096, None] + np.arange(STEPS)]], axis=1)[:, -4:].sum(axis=1) for k in range(0, len(at), 4096)])
    any_of = max(1, most // 3)
    best = np.argsort(-strength, kind="stable")[: most - any_of]
    drawn = np.random.default_rng(crc32(text)).integers(len(at), size=any_of)
    pick = np.unique(np.append(best, drawn))
    cut = doc[at[pick, None] + np.arange(STEPS)]
    mask = cut < len(vocab)
    mask[:, 0] |= ~mask.any(axis=1)  # an empty text is one blank step
    return table[cut], mask


def fit(rows: list[tuple[bytes, int]], folds: int = 4) -> dict:
    """The model of (text, label) rows. Without both labels it scores every text as the share of toxic rows (0 rows: 0)."""
    counts = Counts(folds)
    for text, y in rows:
        counts.add(text, y)
    odds = [counts.odds(f) for f in range(folds)]
    return fit_network(counts, [(*training_windows(t, *odds[fold_of_text(t, folds)]), y) for t, y in rows])


def fit_network(counts: Counts, windows: list[tuple[np.ndarray, np.ndarray, int]]) -> dict:
    """The model of bucket counts and (inputs, mask, label) of every text's windows."""
    return _with_odds(train(windows), counts)


def _with_odds(trained: dict, counts: Counts) -> dict:
    if "net" not in trained:
        return trained
    word_odds, gram_odds = counts.all_odds()
    return trained | {"word_odds": word_odds, "gram_odds": gram_odds}


def train(windows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, seed: int = 7) -> dict:
    """The network of (inputs, mask, label) of every text's windows, and the share of toxic texts."""
    y = np.array([v for *_, v in windows], dtype=np.int64)
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return {"prior": prior}
    rng = np.random.default_rng(seed)
    x, mask = np.concatenate([w[0] for w in windows]), np.concatenate([w[1] for w in windows])
    doc_of = np.repeat(np.arange(len(windows)), [len(w[0]) for w in windows])
    p = {}
    for d in "fb":
        p["w" + d] = rng.normal(0, 0.4, (INPUTS, 3 * HIDDEN)).astype(np.float32)
        p["u" + d] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        p["c" + d] = np.zeros(3 * HIDDEN, dtype=np.float32)
    p["att"] = rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)).astype(np.float32)
    p["att_v"] = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
    p["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
    p["bias"] = np.float32(-1.0) * np.ones((), np.float32)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    label = y[doc_of].astype(np.float32)
    share = 1 / np.bincount(doc_of, minlength=len(y))[doc_of]
    for epoch in range(epochs):
        logit = _logits(p, x, mask)
        worst = np.full(len(y), -np.inf)
        np.maximum.at(worst, doc_of, logit)
        used = np.flatnonzero((label == 0) | (logit >= worst[doc_of]))
        weight = np.where(label[used] == 1, 2.0, 0.5 * share[used] + 0.5 * (logit[used] >= worst[doc_of[used]])).astype(np.float32)
        order = rng.permutation(len(used))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        size = 128 if len(used) < 4000 else 256
        for at in range(0, len(order), size):
            b = order[at : at + size]
            g = _train_step(p, x[used[b]], mask[used[b]], label[used[b]], weight[b])
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    logit, worst = _logits(p, x, mask), np.full(len(y), -np.inf)
    np.maximum.at(worst, doc_of, logit)
    # Move the bias so that 0.5 is where labelled rows, scored out of fold, are split best (F1).
    cuts = np.sort(worst)
    middle = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [0.0]])
    f1 = [2 * ((worst >= c) & (y == 1)).sum() / max(1, (worst >= c).sum() + y.sum()) for c in middle]
    top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    p["bias"] = (p["bias"] - middle[top[len(top) // 2]]).astype(np.float32)
    return {"prior": prior, "net": p}


def _count_buckets(folds: int):
    """A row per fold and label with the counts of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(folds)
        for batch, texts in slices(batches):
            for text, y in zip(texts, batch.column(2).to_pylist(), strict=True):
                counts.add(text or b"", y)
        held = [(f, y) for f in range(folds) for y in (0, 1) if counts.totals[f, y]]
        yield pa.RecordBatch.from_arrays([
            pa.array([f for f, _ in held], pa.int32()), pa.array([y for _, y in held], pa.int32()), pa.array([counts.totals[k] for k in held], pa.float64()),
            pa.array([counts.words[k].tobytes() for k in held], pa.binary()), pa.array([counts.grams[k].tobytes() for k in held], pa.binary()),
        ], ["fold", "y", "n", "words", "grams"])

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    """The counts of all partitions for a fold and label as one row."""
    added = [pa.array([sum(np.frombuffer(x, np.float32) for x in table.column(c).to_pylist()).tobytes()], pa.binary()) for c in ("words", "grams")]
    return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in ("fold", "y")), pa.array([sum(table.column("n").to_pylist())]), *added], table.column_names)


def _pick_windows(shared, folds: int, most: int):
    """A row per slice of texts: the windows of each (place, inputs, mask, label), pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [training_windows(t or b"", *shared.value[fold_of_text(t or b"", folds)], most) for t in texts]
            held = [(place, x, mask, y) for place, (x, mask), y in zip(batch.column(0).to_pylist(), found, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["held"])

    return run


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [w for batch in batches for x in batch.column(0).to_pylist() for w in pickle.loads(x)]
    held.sort(key=lambda w: (w[0], w[1].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([w[1:] for w in held]))], pa.binary())], ["model"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = 4000, text_windows: int = 3, folds: int = 4, parts: int = 8) -> dict:
    """fit() of a labelled sample that stays with the workers: `parts` tasks read it, one trains on so many windows of every text, bounded by `rows`
    and `text_windows`. What reaches the driver are the bucket counts per fold and label, and the network."""
    sample = staged(labelled_sample(docs, labels, "toxic", rows=rows).repartition(parts), "toxic-sample")
    counts, schema = Counts(folds), "fold int, y int, n double, words binary, grams binary"
    for r in sample.mapInArrow(_count_buckets(folds), schema).groupBy("fold", "y").applyInArrow(_add_counts, schema).collect():
        counts.totals[r["fold"], r["y"]] = r["n"]
        counts.words[r["fold"], r["y"]] = np.frombuffer(r["words"], np.float32)
        counts.grams[r["fold"], r["y"]] = np.frombuffer(r["grams"], np.float32)
    if not counts.totals.sum(axis=0).all():
        return fit_network(counts, [(None, None, y) for y in (0, 1) for _ in range(int(counts.totals[:, y].sum()))])
    odds = docs.sparkSession.sparkContext.broadcast([counts.odds(f) for f in range(folds)])
    picked = sample.mapInArrow(_pick_windows(odds, folds, text_windows), "held binary").repartition(1)
    return _with_odds(pickle.loads(picked.mapInArrow(_train, "model binary").first()["model"]), counts)


class Scorer:
    """Scores texts with a fitted model; keeps the input part of words it has met, at most `most` of them."""

    def __init__(self, model: dict, most: int = 200_000):
        self.model, self.most = model, most
        if "net" in model:
            p = model["net"]
            self.w, self.c = np.concatenate([p["wf"], p["wb"]], axis=1), np.concatenate([p["cf"], p["cb"]])
            self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((self.most + 1, 6 * HIDDEN), dtype=np.float32)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        met = set(words)
        new = list(met.difference(self.place))
        if len(self.place) + len(new) > self.most:
            new = list(met)
            self.place, self.table = {}, np.zeros((max(self.most, len(new)) + 1, 6 * HIDDEN), dtype=np.float32)
        n = len(self.place)
        if new:
            self.table[n : n + len(new)] = _inputs(new, self.model["word_odds"], self.model["gram_odds"]) @ self.w + self.c
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))

    def _windows(self, index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        p, half, states = self.model["net"], 3 * HIDDEN, []
        for d, columns in (("f", slice(0, half)), ("b", slice(half, None))):
            order = range(index.shape[1]) if d == "f" else range(index.shape[1] - 1, -1, -1)
            m = mask if mask is None or d == "f" else mask[:, ::-1]
            s = _gru((self.table[index[:, t], columns] for t in order), m, p["u" + d])
            states.append(s if d == "f" else s[::-1])
        return _pool(p, np.concatenate(states, axis=2), mask)[3]

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores 0..1; a text without words scores as the share of toxic rows, 0.49 at most. One label only: its share for all."""
        if "net" not in self.model:
            return np.full(len(texts), self.model["prior"])
        out = np.full(len(texts), min(self.model["prior"], 0.49))
        words = [(t or b"").translate(LOWER).split() for t in texts]
        ids = self._ids([w for ws in words for w in ws])
        first = np.concatenate([[0], np.cumsum([len(ws) for ws in words])])
        worst = np.full(len(texts), -np.inf)
        long = [(k, first[k] + s) for k, ws in enumerate(words) if len(ws) >= STEPS for s in window_starts(len(ws))]
        for at in range(0, len(long), 8192):
            doc, start = np.array(long[at : at + 8192]).T
            np.maximum.at(worst, doc, self._windows(ids[start[:, None] + np.arange(STEPS)], None))
        short = np.array([k for k, ws in enumerate(words) if 0 < len(ws) < STEPS], dtype=np.int64)
        if len(short):
            n = np.array([len(words[k]) for k in short])
            mask = np.arange(STEPS) < n[:, None]
            index = np.where(mask, ids[np.minimum(first[short][:, None] + np.arange(STEPS), len(ids) - 1)], 0)
            worst[short] = self._windows(index, mask)
        scored = np.isfinite(worst)
        out[scored] = _sigmoid(worst[scored].astype(np.float64))
        return out


_SCORERS: dict[int, Scorer] = {}


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        for batch, texts in slices(batches, size=1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_SCORERS[key](texts), pa.float64())], ["id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 4000, text_windows: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs (doc_id, text), learned from labels (doc_id, toxic).

    The fit is on a bounded sample: at most `rows` labelled texts; all words of them count for the log-odds, `text_windows`
    windows of each (the strongest, and some drawn from all) train the network. Every text is scored by all its windows. Fold 0 of 5 by crc32 of the id is held out. Null and empty
    texts are scored as the share of toxic rows, under 0.5; if the sample has one label only, so is every text (as 0 or 1;
    without any label as 0). Rows that repeat an id are scored each, a null id stays null. Only the text enters a score.
    """
    spark = docs.sparkSession
    model = learn(docs, labels, rows, text_windows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(spark.sparkContext.broadcast(model)), f"id {kind}, score double")
    return scored.select(F.col("id").alias("doc_id"), (fold_of("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        for batch, texts in slices(batches, size=1_000_000):
            yield batch.filter(pa.array(_SCORERS[key](texts) < threshold))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = 4000, threshold: float = 0.5, text_windows: int = 3) -> DataFrame:
    """The rows of docs (doc_id, text, ...) whose score is under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows, text_windows))
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)
