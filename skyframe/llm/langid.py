"""Language identification by segmentation-marginalised unigrams.

A word has the probability, per language, of all its segmentations into pieces of a fixed public vocabulary:
a forward pass sums over them. Piece probabilities are expected counts over all training texts (a forward-backward
pass under even probabilities), summed per language and piece, so what reaches the driver is bounded by the vocabulary.
Words go through both passes whole. Many words at a time are summed as plain numbers; words that are too long for one
table with others, or whose sum gets too small for a plain number, are summed in logarithms, one by one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import fold_of, slices

#: Characters of words that share a table, the least sum that a plain number may hold, and characters to a stretch of a longer word.
TOGETHER, SMALLEST, STRETCH, SLOTS = 40, 1e-200, 20_000, 1 << 20
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_VOCABULARIES: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces of a public sentencepiece model, looked up by a rolling hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.size = len(pieces) + 1  # the last id stands for any character that is no piece
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.tables = []
        left = np.arange(len(pieces))
        while len(left):
            shift = np.uint64(44 - 11 * len(self.tables))
            slot = (hashes[left] >> shift) & np.uint64(SLOTS - 1)
            _, first = np.unique(slot, return_index=True)
            ids, keys = np.full(SLOTS, -1, dtype=np.int32), np.zeros(SLOTS, dtype=np.uint64)
            ids[slot[first]], keys[slot[first]] = left[first], hashes[left[first]]
            self.tables.append((shift, ids, keys))
            left = np.delete(left, first)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) * 0x9E3779B97F4A7C15 % 2**64
        return h

    def arcs(self, marked: list[str]):
        """(word, start, end, piece) of every piece in the marked words, sorted by (end, word)."""
        sizes = np.array([len(w) for w in marked])
        data = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        owner, begin = np.repeat(np.arange(len(marked)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(data)) - begin
        left = np.repeat(sizes, sizes) - place
        h, out = np.zeros(len(data), dtype=np.uint64), []
        single = np.zeros(len(data), dtype=bool)
        for n in range(1, self.longest + 1):
            m = len(data) - n + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint64(0x100000001B3) + data[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            at = np.flatnonzero(left[:m] >= n)
            if not len(at):
                break
            piece = np.full(len(at), -1, dtype=np.int64)
            for shift, ids, keys in self.tables:
                slot = (h[at] >> shift) & np.uint64(SLOTS - 1)
                piece = np.where((keys[slot] == h[at]) & (ids[slot] >= 0), ids[slot], piece)
            hit = piece >= 0
            if n == 1:
                single[at[hit]] = True
            out.append((owner[at[hit]], place[at[hit]], place[at[hit]] + n, piece[hit]))
        bare = np.flatnonzero(~single)
        out.append((owner[bare], place[bare], place[bare] + 1, np.full(len(bare), self.size - 1)))
        word, start, end, piece = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((word, end))
        return word[order], start[order], end[order], piece[order], sizes


def _steps(place: np.ndarray, word: np.ndarray, reverse: bool):
    """Arc ranges of one place each, and within them the first arc of every word."""
    cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    for lo, hi in reversed(spans) if reverse else spans:
        yield lo, hi, np.flatnonzero(np.diff(word[lo:hi], prepend=-1))


def marked(word: str) -> str:
    """The word as the vocabulary has it, with a word mark in front."""
    return "▁" + word


def forward(vocabulary: Vocabulary, words: list[str], p: np.ndarray):
    """Sums over all segmentations, alpha[word, place, language]; p is (pieces, languages)."""
    word, start, end, piece, sizes = arcs = vocabulary.arcs([marked(w) for w in words])
    alpha = np.zeros((len(words), sizes.max() + 1, p.shape[1]))
    alpha[:, 0] = 1
    for lo, hi, first in _steps(end, word, False):
        alpha[word[lo:hi][first], end[lo]] = np.add.reduceat(alpha[word[lo:hi], start[lo:hi]] * p[piece[lo:hi]], first, axis=0)
    return arcs, alpha


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def _stretches(vocabulary: Vocabulary, text: str, reverse: bool = False):
    """(start, end, piece) of the arcs of one marked word that start in each stretch of it."""
    begins = range(0, len(text), STRETCH)
    for at in reversed(begins) if reverse else begins:
        _, start, end, piece, _ = vocabulary.arcs([text[at : at + STRETCH + vocabulary.longest - 1]])
        held = start < STRETCH
        yield start[held] + at, end[held] + at, piece[held]


def log_forward(vocabulary: Vocabulary, text: str, logp: np.ndarray) -> np.ndarray:
    """Natural logs of forward()'s sums for one marked word of any length: (places + 1, languages)."""
    alpha = np.full((len(text) + 1, logp.shape[1]), -np.inf)
    alpha[0] = 0
    for start, end, piece in _stretches(vocabulary, text):
        cuts = np.flatnonzero(np.diff(end, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            # Arcs of the stretch before may have reached this place already.
            alpha[end[lo]] = np.logaddexp(alpha[end[lo]], _log_sum(alpha[start[lo:hi]] + logp[piece[lo:hi]]))
    return alpha


def _log_backward_counts(vocabulary: Vocabulary, text: str, logp: np.ndarray, total: np.ndarray, times: float) -> None:
    """Add `times` the expected piece counts of one marked word to total; logp is (pieces, 1)."""
    alpha = log_forward(vocabulary, text, logp)[:, 0]
    beta = np.full(len(text) + 1, -np.inf)
    beta[-1] = 0
    for start, end, piece in _stretches(vocabulary, text, reverse=True):
        order = np.argsort(-start, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        cuts = np.flatnonzero(np.diff(start, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            beta[start[lo]] = _log_sum(beta[end[lo:hi]] + logp[piece[lo:hi], 0])
        total += np.bincount(piece, times * np.exp(alpha[start] + logp[piece, 0] + beta[end] - alpha[-1]), len(total))


def log_scores(vocabulary: Vocabulary, words: list[str], logp: np.ndarray, block: int = 2000) -> np.ndarray:
    """Natural log of each word's probability per language."""
    out, p = np.zeros((len(words), logp.shape[1])), np.exp(logp)
    short = np.array([k for k, w in enumerate(words) if len(w) <= TOGETHER], dtype=np.int64)
    alone = np.setdiff1d(np.arange(len(words)), short)
    for at in range(0, len(short), block):
        part = short[at : at + block]
        (_, _, _, _, sizes), alpha = forward(vocabulary, [words[k] for k in part], p)
        z = alpha[np.arange(len(part)), sizes]
        out[part] = np.log(np.maximum(z, SMALLEST))
        alone = np.append(alone, part[(z < SMALLEST).any(axis=1)])
    for k in alone.tolist():
        out[k] = log_forward(vocabulary, marked(words[k]), logp)[-1]
    return out


def expected_counts(vocabulary: Vocabulary, counts: Counter, block: int = 2000) -> np.ndarray:
    """Expected piece counts over all segmentations of the counted words, pieces being even."""
    total, words = np.zeros(vocabulary.size), [w for w in counts if len(w) <= TOGETHER]
    p = np.full((vocabulary.size, 1), 1 / vocabulary.size)
    for at in range(0, len(words), block):
        part = words[at : at + block]
        (word, start, end, piece, sizes), alpha = forward(vocabulary, part, p)
        beta = np.zeros(alpha.shape[:2])
        beta[np.arange(len(part)), sizes] = 1
        order = np.lexsort((word, start))
        w, s, e, q = word[order], start[order], end[order], piece[order]
        for lo, hi, first in _steps(s, w, True):
            inner = w[lo:hi][first]
            beta[inner, s[lo]] = np.add.reduceat(beta[w[lo:hi], e[lo:hi]] * p[q[lo:hi], 0], first)
        n = np.array([counts[x] for x in part], dtype=np.float64)
        z = alpha[np.arange(len(part)), sizes, 0]
        total += np.bincount(piece, alpha[word, start, 0] * p[piece, 0] * beta[word, end] / z[word] * n[word], vocabulary.size)
    for x, n in counts.items():
        if len(x) > TOGETHER:
            _log_backward_counts(vocabulary, marked(x), np.log(p), total, n)
    return total


def words_of(text: bytes | None) -> list[str]:
    """Lower-cased words without ASCII marks at their edges."""
    return [x for w in (text or b"").decode("utf-8", "replace").lower().split() if (x := w.strip(_EDGES))]


def _vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _learn(path: str, most: int = 150_000, most_chars: int = 8_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen, totals, docs = _vocabulary(path), defaultdict(Counter), {}, Counter()

        def flush() -> None:
            for lang, counts in seen.items():
                totals[lang] = totals.get(lang, 0) + expected_counts(vocabulary, counts)
            seen.clear()

        for batch, texts in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                docs[lang] += 1
                seen[lang].update(words_of(text))
            if sum(map(len, seen.values())) > most or sum(sum(map(len, counts)) for counts in seen.values()) > most_chars:
                flush()
        flush()
        for lang, n in docs.items():
            counts = totals.get(lang, np.zeros(vocabulary.size))
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(held) + 1), pa.string()), pa.array([-1, *held.tolist()], pa.int32()), pa.array([float(n), *counts[held].tolist()], pa.float64())], ["lang", "piece", "n"])

    return run


def fit(docs: DataFrame, vocabulary_path: str, lang_col: str = "lang", text_col: str = "text") -> dict:
    """{languages, prior, logp}: from all rows of docs with a language; the driver gets at most vocabulary x languages sums."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(_learn(vocabulary_path), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    if not langs:
        return {"langs": []}
    size = Vocabulary(vocabulary_path).size
    counts, docs_of = np.zeros((size, len(langs))), np.zeros(len(langs))
    lang, piece, n = np.array([langs.index(x) for x in sums.column("lang").to_pylist()]), sums.column("piece").to_numpy(), sums.column("n").to_numpy()
    docs_of[lang[piece < 0]] = n[piece < 0]
    counts[piece[piece >= 0], lang[piece >= 0]] = n[piece >= 0]
    counts[size - 1] = 0
    p = (counts + 0.1) / (counts.sum(axis=0) + 0.1 * size)
    p[size - 1] = 1e-7
    return {"langs": langs, "prior": np.log(docs_of / docs_of.sum()), "logp": np.log(p)}


class Identifier:
    """Languages of texts; keeps the scores of words it has met, about `most` of them and `most_chars` characters in all."""

    def __init__(self, model: dict, path: str, most: int = 300_000, most_chars: int = 16_000_000):
        self.model, self.vocabulary, self.most, self.most_chars = model, _vocabulary(path), most, most_chars
        self.place: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((0, len(model["langs"])))

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """`und` and score 0 for texts without a letter, or if there is nothing to learn from."""
        words = [words_of(t) for t in texts]
        letters = [any(any(c.isalpha() for c in w) for w in ws) for ws in words]
        if not self.model["langs"]:
            return ["und"] * len(texts), [0.0] * len(texts)
        met = {w for ws in words for w in ws}
        if len(self.place) + len(met) > self.most or self.chars > self.most_chars:
            self.place, self.table, self.chars = {}, self.table[:0], 0
        new = list(met.difference(self.place))
        if new:
            self.chars += sum(map(len, new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.table = np.concatenate([self.table, log_scores(self.vocabulary, new, self.model["logp"])])
        langs, scores = [], []
        for ws, any_letter in zip(words, letters, strict=True):
            if not any_letter:
                langs.append("und")
                scores.append(0.0)
                continue
            s = self.model["prior"] + self.table[list(map(self.place.__getitem__, ws))].sum(axis=0)
            e = np.exp(s - s.max())
            langs.append(self.model["langs"][int(s.argmax())])
            scores.append(float(e.max() / e.sum()))
        return langs, scores


def _identify(shared, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(shared.value, path)
        for batch, texts in slices(batches):
            langs, scores = identify(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) per row of docs, over whole texts and whole words: `und` and 0 for null texts and texts without a letter; ties go to the first language by name."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(model), vocabulary_path), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def languages(docs: DataFrame, vocabulary_path: str, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows outside the held-out fold that have a language."""
    model = fit(docs.filter(fold_of("doc_id", folds) != held_out), vocabulary_path)
    return identify(docs, model, vocabulary_path).withColumn("held_out", fold_of("doc_id", folds) == held_out)
