"""Language-model scoring from a log-frequency Bloom filter.

A count c is kept as its level q = 1 + floor(log_1.5 c): the n-gram is put into the filter q times, as
(n-gram, 1) ... (n-gram, q). A reader probes level after level until one is missing. Words and word pairs of
the training texts are counted in blocks of their hash; each block becomes one stretch of the filter. Stretches go
to all workers, in as many passes over the texts as it takes to keep a broadcast within `pass_bytes`.

A pair's probability is Witten-Bell smoothing that allows for what the filter gets wrong,
    p(w | v) = (r c(vw) + T(v) p(w)) / (C(v) + T(v) + F(v)).
c(vw) is what pairs read at that level were counted on average; r = x / (x + 4 e) is the trust in a hit, x the chance
that v and w, as frequent as they are, meet that often, and e the filter's rate of false hits at that level; C(v) is the
context's count, the greatest that its level stands for if it is not exact; T(v) and F(v) are the distinct successors
and the false hits to expect of such a context, from the histogram of word counts. Trust in the hits of a rare context
leaves room for false ones. So the probabilities of all words after a context sum to at most 1, give or take what
the middle of a level differs from a count. Pairs with an unknown word are not probed. The unigram base score beside it uses exact counts: frequent words from a bounded table on every worker, all
others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import LOWER, fold_of, slices, staged

BASE, LEVELS, FIRST_PROBES, MORE_PROBES, DOUBT = 1.5, 60, 14, 5, 4.0
#: Rates of false hits at the first level and at each further one, half of the bits being set.
FALSE_FIRST, FALSE_MORE = 0.5**FIRST_PROBES, 0.5**MORE_PROBES
#: Keys of the end token and of the context before a text's first word.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR, _UNI = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BLOCK_SCHEMA = "block int, word_bits binary, n_word_bits long, pair_bits binary, n_pair_bits long, words binary, counts binary, stats array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(v * _PAIR ^ (w >> np.uint64(7)) ^ w * np.uint64(0xC2B2AE3D27D4EB4F))


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


#: The greatest count of each level; level 0: none.
LEVEL_MOST = np.array([0.0] + [max(np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1) for q in range(1, LEVELS)])


def level_stats(counts: np.ndarray) -> np.ndarray:
    """How many counts each level has, and their sum: (2, LEVELS)."""
    q = level(counts)
    return np.stack([np.bincount(q, minlength=LEVELS), np.bincount(q, counts, LEVELS).astype(np.int64)])


def level_means(stats: np.ndarray) -> np.ndarray:
    """The count to expect of an n-gram read at each level: false hits lift a share of the lower levels into it."""
    n, total, means = 0.0, 0.0, LEVEL_MOST.copy()
    for q in range(1, LEVELS):
        n, total = n * FALSE_MORE + stats[0, q], total * FALSE_MORE + stats[1, q]
        if n > 0:
            means[q] = total / n
    return means


def _probes(keys: np.ndarray, q: int, n_bits: int) -> Iterator[np.ndarray]:
    """Bit places of (key, level q): more probes for the first level, which decides about unseen n-grams."""
    a = _mix(keys + np.uint64(q * 0xA0761D6478BD642F % 2**64))
    low, step = a & np.uint64(0xFFFFFFFF), (a >> np.uint64(32)) | np.uint64(1)
    for i in range(FIRST_PROBES if q == 1 else MORE_PROBES):
        yield (low + np.uint64(i) * step) % np.uint64(n_bits)


def build_bits(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The filter of these n-grams, sized for half of its bits to be set."""
    levels = level(counts)
    puts = len(keys) * FIRST_PROBES + int((levels - 1).sum()) * MORE_PROBES
    n_bits = max(64, int(puts / np.log(2)) // 8 * 8 + 8)
    flags = np.zeros(n_bits, dtype=bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in _probes(keys[levels >= q], q, n_bits):
            flags[at.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little"), n_bits


class LogFilter:
    """Stretches of bits, one per hash block, and their probes. Blocks that are not held have a negative place.

    The bits travel as bytes, which a worker reads where they lie.
    """

    def __init__(self, bits: bytes | bytearray, first: np.ndarray, n_bits: np.ndarray):
        self.data, self.first, self.n_bits = bits, first, n_bits

    @property
    def bits(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8)

    def block(self, keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(len(self.first))).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The levels at which these keys are read; their blocks must be held."""
        block = self.block(keys)
        first, n_bits, q = self.first[block], self.n_bits[block].astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
        left, bits = np.arange(len(keys)), self.bits
        for lv in range(1, LEVELS):
            held = left
            for i in range(FIRST_PROBES if lv == 1 else MORE_PROBES):
                if not len(held):
                    break
                if i == 0:
                    a = _mix(keys[held] + np.uint64(lv * 0xA0761D6478BD642F % 2**64))
                    low, step, f, n = a & np.uint64(0xFFFFFFFF), (a >> np.uint64(32)) | np.uint64(1), first[held], n_bits[held]
                at = ((low + np.uint64(i) * step) % n).astype(np.int64)
                hit = (bits[f + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                if not hit.all():
                    held, low, step, f, n = held[hit], low[hit], step[hit], f[hit], n[hit]
            q[held] = lv
            left = held
            if not len(left):
                break
        return q


# Counting


def _count(blocks: int):
    """Rows (block, kind, keys, counts): words (kind 0) and pairs (1) of a slice, counted and dealt by hash block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _SCORERS.clear()  # a worker may still hold the filter of another pass
        known: dict[bytes, int] = {}
        for _, texts in slices(batches, size=2_000_000):
            ids = []
            if len(known) > 200_000:
                known.clear()
            for t in texts:
                words = (t or b"").translate(LOWER).split()
                for w in set(words).difference(known):
                    known[w] = word_hash(w)
                ids.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
            nexts = np.concatenate([x for i in ids for x in (i, [END])]).astype(np.uint64)
            befores = np.concatenate([x for i in ids for x in ([START], i)]).astype(np.uint64)
            for kind, keys in ((0, nexts), (1, pair_keys(befores, nexts))):
                keys, counts = np.unique(keys, return_counts=True)
                block = ((keys if kind else _mix(keys ^ _UNI)) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                keys, counts, block = keys[order], counts[order].astype(np.uint32), block[order]
                cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
                yield pa.RecordBatch.from_arrays([
                    pa.array(block[cuts[:-1]], pa.int32()), pa.array(np.full(len(cuts) - 1, kind), pa.int32()),
                    pa.array([keys[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ], ["block", "kind", "keys", "counts"])

    return run


def _merge(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(counts), np.uint32).astype(np.float64)
    k, where = np.unique(k, return_inverse=True)
    return k, np.bincount(where, c, len(k)).astype(np.int64)


#: Upper ends of the count histogram's bins, an eighth of a doubling apart.
_BINS = np.unique(np.floor(2 ** (np.arange(0, 8 * 48) / 8)).astype(np.int64))


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block from rows sorted by block."""
    now, held = None, {0: ([], []), 1: ([], [])}

    def done():
        words, counts = _merge(*held[0])
        pairs, pair_counts = _merge(*held[1])
        word_bits, n_word_bits = build_bits(_mix(words ^ _UNI), counts)
        pair_bits, n_pair_bits = build_bits(pairs, pair_counts)
        bin_of = np.searchsorted(_BINS, counts, "right") - 1
        stats = np.concatenate([np.bincount(bin_of, minlength=len(_BINS)), np.bincount(bin_of, counts, len(_BINS)).astype(np.int64), level_stats(counts).ravel(), level_stats(pair_counts).ravel()])
        return pa.RecordBatch.from_arrays([
            pa.array([now], pa.int32()), pa.array([word_bits.tobytes()], pa.binary()), pa.array([n_word_bits], pa.int64()), pa.array([pair_bits.tobytes()], pa.binary()), pa.array([n_pair_bits], pa.int64()),
            pa.array([words.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([stats.tolist()], pa.list_(pa.int64())),
        ], ["block", "word_bits", "n_word_bits", "pair_bits", "n_pair_bits", "words", "counts", "stats"])

    for batch in batches:
        for block, kind, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and block != now:
                yield done()
                held = {0: ([], []), 1: ([], [])}
            now = block
            held[kind][0].append(keys)
            held[kind][1].append(counts)
    if now is not None:
        yield done()


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, c = np.frombuffer(words, np.int64), np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[c >= least]), pa.array(c[c >= least])], ["h", "c"])

    return run


# Scoring


class Model:
    """What a worker needs in one pass: all words' filter, the pass's pair filter, exact counts of frequent words, statistics."""

    def __init__(self, words: LogFilter, pairs: LogFilter, head: tuple[np.ndarray, np.ndarray], stats: np.ndarray, leads: bool = True):
        self.word_filter, self.pair_filter, self.leads = words, pairs, leads
        self.head_keys, self.head_counts = head
        bins = len(_BINS)
        n, total = stats[:bins].astype(float), stats[bins : 2 * bins].astype(float)
        self.tokens, self.words = int(total.sum()), int(n.sum())
        word_levels, pair_levels = stats[2 * bins :].reshape(2, 2, LEVELS)
        self.word_means, self.pair_means = level_means(word_levels), level_means(pair_levels)
        above = np.cumsum(pair_levels[0][::-1])[::-1]
        self.reach = above / max(1, above[0])  # share of pairs that have a level or a higher one
        self.norm = self.tokens + 0.5 * (self.words + 1)
        held = n > 0
        if held.any():
            grid = np.exp(np.linspace(0, np.log(max(2, self.tokens)), 400))
            meet = -np.expm1(-np.outer(grid, total[held] / n[held]) / self.tokens)
            self.grid, self.successors, self.false, spread = np.log(grid), meet @ n[held], np.zeros(400), np.zeros(400)
            for q in range(1, 9):
                rate = FALSE_FIRST * FALSE_MORE ** (q - 1)
                weight = self.trust(meet, q) * np.minimum(self.pair_means[q], grid)[:, None]
                self.false += rate * weight @ n[held]
                spread += rate * weight**2 @ n[held]
            self.spread = np.sqrt(spread)
        else:
            self.grid, self.successors, self.false, self.spread = np.zeros(1), np.ones(1), np.zeros(1), np.zeros(1)

    def trust(self, meet: np.ndarray, q: np.ndarray | int) -> np.ndarray:
        """Trust in hits at level q of pairs that meet with this chance."""
        true = meet * self.reach[q]
        return true / (true + DOUBT * FALSE_FIRST * FALSE_MORE ** (q - 1.0))

    def reserve(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """T, F and its standard deviation for contexts seen c times: distinct successors, at least 1, and the weight of false hits."""
        x = np.log(np.maximum(c, 1))
        return np.maximum(1.0, np.interp(x, self.grid, self.successors)), np.interp(x, self.grid, self.false), np.interp(x, self.grid, self.spread)


class Scorer:
    def __init__(self, model: Model, most: int = 200_000):
        self.m, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.hash = np.zeros(0, np.uint64)
        self.exact = np.zeros(0, np.int64)  # -1: not among the frequent
        self.count, self.bound = np.zeros(0), np.zeros(0)  # as expected, and at most
        self._add([END, START])
        self.count[1], self.bound[1] = self.count[0], self.bound[0]  # as many starts as ends

    def _add(self, hashes: list) -> None:
        h = np.array(hashes, dtype=np.uint64)
        signed = h.view(np.int64)
        at = np.minimum(np.searchsorted(self.m.head_keys, signed), max(0, len(self.m.head_keys) - 1))
        exact = np.where(self.m.head_keys[at] == signed, self.m.head_counts[at], -1) if len(self.m.head_keys) else np.full(len(h), -1)
        q = np.zeros(len(h), dtype=np.int64)
        rare = np.flatnonzero(exact < 0)
        q[rare] = self.m.word_filter.levels(_mix(h[rare] ^ _UNI))
        count, bound = np.where(exact >= 0, exact, self.m.word_means[q]), np.where(exact >= 0, exact, LEVEL_MOST[q])
        self.hash, self.exact, self.count, self.bound = (np.concatenate(x) for x in ((self.hash, h), (self.exact, exact), (self.count, count), (self.bound, bound)))

    def probability(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(w | v) of word numbers, and whether this pass answers for the pair."""
        m, c_v, c_w = self.m, self.count[v], self.count[w]
        p_w = (c_w + 0.5) / m.norm
        keys = pair_keys(self.hash[v], self.hash[w])
        known = (c_v > 0) & (c_w > 0)
        mine = np.where(known, m.pair_filter.first[m.pair_filter.block(keys)] >= 0, m.leads)
        at = np.flatnonzero(known & mine)
        q = m.pair_filter.levels(keys[at])
        seen, q = at[q > 0], q[q > 0]
        meet = -np.expm1(-c_v[seen] * c_w[seen] / max(1, m.tokens))
        t, false, spread = m.reserve(c_v)
        room = self.bound[v] + false
        room /= room + 3 + 2 * spread  # with these hits and three false ones more than usual the sum stays within 1
        joint = np.zeros(len(v))
        joint[seen] = np.minimum(m.trust(meet, q), room[seen]) * np.minimum(m.pair_means[q], np.minimum(self.bound[v[seen]], self.bound[w[seen]]))
        return np.where(c_v > 0, (joint + t * p_w) / (self.bound[v] + t + false), p_w), mine

    def __call__(self, texts: list[bytes | None]):
        """Per text: tokens, base score and known tokens of its frequent words, model score, and its other words with their numbers."""
        words = [(t or b"").translate(LOWER).split() for t in texts]
        met = {w for ws in words for w in ws}
        if len(self.place) + len(met) > self.most:
            self.clear()
        new = list(met.difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.hash), len(self.hash) + len(new)), strict=True))
            self._add([word_hash(w) for w in new])
        get, n = self.place.__getitem__, np.array([len(ws) + 1 for ws in words])
        rows = [np.fromiter(map(get, ws), dtype=np.int64, count=len(ws)) for ws in words]
        w = np.concatenate([x for r in rows for x in (r, [0])]).astype(np.int64)
        v = np.concatenate([x for r in rows for x in ([1], r)]).astype(np.int64)
        first = np.cumsum(n) - n
        # A pair that recurs in these texts is probed once.
        pairs, where = np.unique(v * len(self.hash) + w, return_inverse=True)
        p, mine = self.probability(pairs // len(self.hash), pairs % len(self.hash))
        score = np.add.reduceat(np.where(mine, np.log10(np.minimum(p, 1.0)), 0.0)[where], first)
        exact = self.exact[w]
        base = np.add.reduceat(np.where(exact >= 0, np.log10(np.maximum(exact, 0) + 0.5) - np.log10(self.m.norm), 0), first)
        known = np.add.reduceat((exact >= 0).astype(np.int64), first)
        rest = []
        for a, b in zip(first, first + n, strict=True):
            ids, times = np.unique(w[a:b][exact[a:b] < 0], return_counts=True)
            rest.append((self.hash[ids].view(np.int64).tolist(), times.tolist()))
        return n, base, known, score, rest


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return _SCORERS[id(model)]


def text_key(text: bytes | None) -> int:
    """By this the passes over one text find together; texts of one key are equal, but for a chance of 2**-64 a pair."""
    return xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)


def _score(shared):
    """The first pass: all columns, with this pass's part of the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch, texts in slices(batches, size=1_500_000):
            n, base, known, score, rest = _scorer(shared.value)(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n, pa.int64()), pa.array(base), pa.array(known, pa.int64()), pa.array(score), pa.array([text_key(t) for t in texts], pa.int64()),
                pa.array([r[0] for r in rest], pa.list_(pa.int64())), pa.array([r[1] for r in rest], pa.list_(pa.int64())),
            ], ["row", "id", "n_tokens", "base", "known", "part", "text_key", "words", "times"])
            row += len(n)

    return run


def _score_more(shared):
    """A further pass: its part of the score, by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, size=1_500_000):
            score = _scorer(shared.value)(texts)[3]
            yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in texts], pa.int64()), pa.array(score)], ["text_key", "part"])

    return run


def _stretch(built: DataFrame, blocks: int, kind: str, some: list[int] | None = None) -> LogFilter:
    """The word or pair filter of all blocks, or of some."""
    rows = built.select("block", f"{kind}_bits", f"n_{kind}_bits")
    held = (rows if some is None else rows.filter(F.col("block").isin(some))).toArrow()
    n_bits, first = np.full(blocks, 64, np.int64), np.full(blocks, 0 if some is None else -1, np.int64)
    at = held.column("block").to_numpy()
    n_bits[at] = held.column(f"n_{kind}_bits").to_numpy()
    sizes = n_bits[at] // 8
    first[at] = 8 + np.cumsum(sizes) - sizes  # eight empty bytes stand for blocks without an n-gram
    bits = bytearray(8 + int(sizes.sum()))
    for chunk in held.to_batches():
        for b, data in zip(chunk.column(0).to_pylist(), chunk.column(1), strict=True):
            bits[first[b] : first[b] + n_bits[b] // 8] = data.as_buffer()
    return LogFilter(bits, first, n_bits)


def learn(training: DataFrame, text_col: str = "text", head: int = 200_000, block_tokens: int = 2_000_000, pass_bytes: int = 192_000_000):
    """What is learned from the rows of training: (table of blocks, statistics, `least`, function that gives the models of all passes).

    Words counted `least` times or more, at most `head` of them, are known exactly on every worker.
    """
    texts = training.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = training.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    blocks = max(24, int(size / 6 / block_tokens))
    counted = texts.mapInArrow(_count(blocks), "block int, kind int, keys binary, counts binary")
    built = staged(counted.repartition(2 * blocks, "block").sortWithinPartitions("block").mapInArrow(_block, _BLOCK_SCHEMA), "ngram-blocks")

    stats = np.zeros(2 * len(_BINS) + 4 * LEVELS, np.int64)
    for r in built.select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        stats[r["at"]] = r["n"]
    above = np.cumsum(stats[: len(_BINS)][::-1])[::-1]
    least = int(_BINS[min(int((above > head).sum()), len(_BINS) - 1)])

    def models() -> Iterator[Model]:
        frequent = built.select("words", "counts").mapInArrow(_frequent(least), "h long, c long").toArrow()
        keys, counts = frequent.column("h").to_numpy(), frequent.column("c").to_numpy()
        order = np.argsort(keys)
        words = _stretch(built, blocks, "word")
        passes: list[list[int]] = [[]]
        held = 0
        for b, n in sorted((r["block"], r["n_pair_bits"] // 8) for r in built.select("block", "n_pair_bits").collect()):
            if held and held + n > pass_bytes:
                passes.append([])
                held = 0
            passes[-1].append(b)
            held += n
        present = {b for some in passes for b in some}
        for k, some in enumerate(passes):
            pairs = _stretch(built, blocks, "pair", some)
            if k == 0:
                pairs.first[[b for b in range(blocks) if b not in present]] = 0
            yield Model(words, pairs, (keys[order], counts[order]), stats, leads=k == 0)

    return built, stats, least, models


def score(docs: DataFrame, training: DataFrame, text_col: str = "text", id_col: str = "doc_id", head: int = 200_000, block_tokens: int = 2_000_000, pass_bytes: int = 192_000_000) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row of docs, learned from the rows of training.

    Null texts are empty: one end token. Rows that repeat an id are scored each. Without training rows the counts
    are zero and both scores even. `head` bounds the exact counts kept on every worker; all other words are joined.
    The filter holds every n-gram of the training rows. Each pass over docs takes a stretch of pairs of at most `pass_bytes`
    (a block of `block_tokens` tokens at least) and the filter of all words.
    """
    spark = docs.sparkSession
    built, stats, least, models = learn(training, text_col, head, block_tokens, pass_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for k, model in enumerate(models()):
        shared = spark.sparkContext.broadcast(model)
        if k == 0:
            tokens, words = model.tokens, model.words
            main = staged(rows.mapInArrow(_score(shared), f"row long, id {kind}, n_tokens long, base double, known long, part double, text_key long, words array<long>, times array<long>"), "lm-scores")
        else:
            parts.append(staged(rows.select(F.lit(0).alias("id"), "text").mapInArrow(_score_more(shared), "text_key long, part double").groupBy("text_key").agg(F.max("part").alias("part")), "lm-part"))
        shared.unpersist()
    rest = main.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("h"), F.col("x.times").alias("times"))
    rare = built.select("words", "counts").mapInArrow(_rare(least), "w long, c long")
    norm = float(np.log10(tokens + 0.5 * (words + 1)))
    joined = rest.join(rare.hint("merge"), F.col("h") == F.col("w"), "left")
    tail = joined.groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - norm)).alias("tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("seen")).withColumnRenamed("row", "r")
    out = main.drop("words", "times").join(tail.hint("merge"), F.col("row") == F.col("r"), "left").withColumnRenamed("part", "score")
    for more in parts:
        out = out.join(more.withColumnRenamed("text_key", "k").hint("merge"), F.col("text_key") == F.col("k")).withColumn("score", F.col("score") + F.col("part")).drop("k", "part")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0))).alias("base_score"), "score",
    )


def _rare(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, c = np.frombuffer(words, np.int64), np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[c < least]), pa.array(c[c < least])], ["w", "c"])

    return run


def score_held_out(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """score() of all docs (doc_id, text), learned from those outside the held-out fold."""
    scored = score(docs, docs.filter(fold_of("doc_id", folds) != held_out))
    return scored.withColumn("held_out", fold_of("doc_id", folds) == held_out)
