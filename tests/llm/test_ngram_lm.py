"""The model's score is a log-probability: sums over the vocabulary, and the formula without a filter between."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import ngram_lm as lm
from skyframe.llm.common import fold_of, table

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_sums_over_the_vocabulary(spark):
    """Frequent, drawn, rare and unseen contexts, and the start: p(w | v) over all training words is at most 1.02."""
    docs = table(spark, SF, "documents")
    built, _, _, models = lm.learn(docs.filter(fold_of("doc_id", 5) != 1), head=3000)
    held = built.select("words", "counts").toArrow()
    w = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in held.column(0)])
    c = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in held.column(1)])
    scorer = lm.Scorer(next(iter(models())), most=10**9)
    scorer._add(w.tolist())
    scorer._add([lm.word_hash(b"neverseenword%d" % k) for k in range(3)])
    vocabulary, rng = np.arange(2, 2 + len(w)), np.random.default_rng(0)
    kinds = {
        "frequent": np.argsort(-c)[:25], "drawn": rng.choice(len(c), 60, p=c / c.sum()), "once": rng.choice(np.flatnonzero(c == 1), 60), "few": rng.choice(np.flatnonzero((c > 1) & (c < 9)), 60),
        "unseen": len(w) + np.arange(3), "start": [-1],
    }
    for kind, contexts in kinds.items():
        sums = np.array([scorer.probability(np.full(len(w), v + 2), vocabulary)[0].sum() for v in contexts])
        assert (sums <= 1.02).all() and (sums > 0.3).all(), (kind, sums.max())


def formula(texts, train):
    """Scores from plain counts, levels and the Witten-Bell formula."""
    count, pairs = Counter(), Counter()
    for t in train:
        ws = [*words_of(t), None]
        count.update(ws)
        pairs.update(zip(["<s>", *ws[:-1]], ws, strict=True))
    n, v = sum(count.values()), len(count)
    level = lambda x: 1 + math.floor(math.log(x) / math.log(1.5) + 1e-9)
    means = {q: np.mean([x for x in pairs.values() if level(x) == q]) for q in {level(x) for x in pairs.values()}}
    count["<s>"] = count[None]
    bins = Counter()
    totals = Counter()
    for w, x in count.items():
        if w != "<s>":
            k = int(np.searchsorted(lm._BINS, x, "right"))
            bins[k] += 1
            totals[k] += x
    grid = np.exp(np.linspace(0, np.log(max(2, n)), 400))
    successors = [sum(bins[k] * -math.expm1(-g * totals[k] / bins[k] / n) for k in bins) for g in grid]
    out = []
    for t in texts:
        ws, score = [*words_of(t), None], 0.0
        for a, w in zip(["<s>", *ws[:-1]], ws, strict=True):
            p_w = (count[w] + 0.5) / (n + 0.5 * (v + 1))
            if c := count[a]:
                tv = max(1.0, float(np.interp(math.log(c), np.log(grid), successors)))
                joint = min(means[level(pairs[a, w])], c, count[w]) * c / (c + 3) if pairs[a, w] else 0.0
                p_w = (joint + tv * p_w) / (c + tv)
            score += math.log10(p_w)
        out.append(score)
    return out


def test_score_equals_the_formula_and_passes_change_nothing(spark, monkeypatch):
    """With so many probes that no hit is false, on a small corpus; in one pass and in many."""
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").filter("doc_id < 60").collect()] + [(1000, None), (1001, ""), (1002, "x " * 5000), (1003, "x " * 5000), (1000, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.filter("doc_id % 2 = 0")
    monkeypatch.setattr(lm, "FIRST_PROBES", 40)
    monkeypatch.setattr(lm, "MORE_PROBES", 40)
    monkeypatch.setattr(lm, "FALSE_FIRST", 0.0)
    monkeypatch.setattr(lm, "FALSE_MORE", 0.0)
    texts = [(t or "").encode() for k, t in rows if k % 2 == 0]
    want = formula([t for _, t in rows], [t.decode() for t in texts])
    _, _, _, models = _local(texts)
    got = [lm.Scorer(next(iter(models())))([(t or "").encode()])[3][0] for _, t in rows]
    assert got == pytest.approx(want)
    whole = sorted(map(tuple, lm.score(df, train).collect()), key=str)
    monkeypatch.undo()
    one, many = (sorted(map(tuple, lm.score(df, train, head=50, pass_bytes=b).collect()), key=str) for b in (10**9, 3000))
    assert len(whole) == len(one) == len(many) == len(rows)
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert [r[5] for r in one] == pytest.approx([r[5] for r in many])


def _local(texts):
    """learn() without Spark, for the settings of this process."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), pa.array([t.decode() for t in texts])], ["id", "text"])
    rows = sorted((r for b in lm._count(4)(iter([batch])) for r in b.to_pylist()), key=lambda r: r["block"])
    schema = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    built = [r for b in lm._block(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])) for r in b.to_pylist()]
    stats = np.sum([r["stats"] for r in built], axis=0)

    def filter_of(kind):
        n, first, bits, at = np.full(4, 64), np.zeros(4, np.int64), [np.zeros(8, np.uint8)], 8
        for r in built:
            n[r["block"]], first[r["block"]] = r[f"n_{kind}_bits"], at
            bits.append(np.frombuffer(r[f"{kind}_bits"], np.uint8))
            at += len(bits[-1])
        return lm.LogFilter(np.concatenate(bits).tobytes(), first, n)

    w, c = (np.concatenate([np.frombuffer(r[k], np.int64) for r in built]) for k in ("words", "counts"))
    order = np.argsort(w)
    return built, stats, 1, lambda: [lm.Model(filter_of("word"), filter_of("pair"), (w[order], c[order]), stats)]


def test_held_out_texts_score_better_than_the_base(spark):
    d = table(spark, SF, "documents").select("doc_id", "text")
    out = lm.score_held_out(d).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] / out[2] > out[1] / out[2] + 0.4
