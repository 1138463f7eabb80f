"""The two networks against plain loops, and samples whose texts have any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import quality, toxicity
from skyframe.llm.common import labelled_sample, table

SF = "/root/testdata/sf0.01"


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def naive_toxicity(model, text):
    """Every window step by step, one unit vector at a time; the worst window counts."""
    p, h = model["net"], toxicity.HIDDEN
    words = text.encode().translate(toxicity.LOWER).split()
    if not words:
        return min(model["prior"], 0.49)
    worst = -np.inf
    for at in toxicity.window_starts(len(words)):
        window = words[at : at + toxicity.STEPS]
        x = [toxicity._inputs([w], model["word_odds"], model["gram_odds"])[0].astype(float) for w in window]
        states = {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                a, g = x[t] @ p["w" + d] + p["c" + d], s @ p["u" + d]
                r, z = sigmoid(a[:h] + g[:h]), sigmoid(a[h : 2 * h] + g[h : 2 * h])
                n = np.tanh(a[2 * h :] + r * g[2 * h :])
                s = (1 - z) * n + z * s
                states[d, t] = s
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(x))]
        e = np.array([np.tanh(s @ p["att"]) @ p["att_v"] for s in both])
        w = np.exp(e - e.max())
        pooled = sum(a * s for a, s in zip(w / w.sum(), both, strict=True))
        worst = max(worst, float(pooled @ p["out"] + p["bias"]))
    return sigmoid(worst)


def naive_quality(model, text):
    data, t, n = text.ljust(quality.WIDTH, b"\0"), model["tables"].astype(float), quality.WIDTH
    best = []
    for at in range(0, max(1, len(data) - quality.OVERLAP), quality.CHUNK - quality.OVERLAP):
        chunk = data[at : at + quality.CHUNK]
        best.append(np.max([sum(t[k][chunk[i + k]] for k in range(n)) for i in range(len(chunk) - n + 1)], axis=0))
    held = np.maximum(np.array(best) + model["bias"], 0)
    return sigmoid(np.concatenate([held.max(axis=0), held.mean(axis=0)]) @ model["out"] + model["shift"])


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["text"].encode(), r["y"]) for r in labelled_sample(table(spark, SF, "documents"), table(spark, SF, "labels"), "toxic", rows=250).collect()]


def test_toxicity_equals_plain_loops(rows):
    model = toxicity.fit(rows)
    texts = [t.decode() for t, _ in rows[:25]] + ["", " \n", "one", "two words", "w " * 31, "w " * 32, "w " * 33, "w x " * 100, "é日本" * 300]
    assert toxicity.Scorer(model)([t.encode() for t in texts]) == pytest.approx([naive_toxicity(model, t) for t in texts], abs=2e-3)


def test_quality_equals_plain_loops(spark):
    drawn = labelled_sample(table(spark, SF, "documents"), table(spark, SF, "labels"), "quality", rows=120).collect()
    model = quality.fit([(quality.drawn_chunks(r["text"].encode()), r["y"]) for r in drawn], epochs=3)
    texts = [r["text"].encode() for r in drawn[:6]] + [b"", b"a", b"b" * 8, b"c" * 511, b"d" * 512, b"e" * 513, b"f" * 960, b"g" * 961]
    assert quality.Scorer(model)(texts) == pytest.approx([naive_quality(model, t) for t in texts], abs=1e-4)


def test_quality_learns_by_descent(spark):
    """More epochs fit the training rows better, which wrong gradients would not."""
    drawn = labelled_sample(table(spark, SF, "documents"), table(spark, SF, "labels"), "quality", rows=200).collect()
    rows, y = [(quality.drawn_chunks(r["text"].encode()), r["y"]) for r in drawn], np.array([r["y"] for r in drawn])
    loss = []
    for epochs in (1, 12):
        s = np.clip(quality.Scorer(quality.fit(rows, epochs=epochs))([r["text"].encode() for r in drawn]), 1e-9, 1 - 1e-9)
        loss.append(-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))
    assert loss[1] < 0.6 * loss[0]


def test_long_labelled_texts_are_learned_from(spark):
    """The only toxic rows are texts of 300,000 characters: without them there is one label, and a score of 0 for all."""
    bad, good = "zorgle vexing", "meadow river"
    rows = [(k, f"{good} {k} " * 10, 0) for k in range(1, 60)] + [(100 + k, f"{good} quiet " * 8000 + f"{bad} {k} " * 12 + f"{good} calm " * 8000, 1) for k in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, toxic int, quality int")
    asked = spark.createDataFrame([(1, f"{bad} now " * 12), (2, f"{good} now " * 12)], "doc_id long, text string")
    tox = toxicity.Scorer(toxicity.learn(docs, labels))([r["text"].encode() for r in asked.orderBy("doc_id").collect()])
    assert tox[0] > 0.5 > tox[1]
    short = labels.filter("doc_id < 100")
    assert toxicity.Scorer(toxicity.learn(docs, short))([b"x"]) == pytest.approx([0.0])
    held = quality.quality(docs, labels).join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert held > 0.9  # the long texts are told from the short ones
    chunk = quality.drawn_chunks(b"ab" * 100_000 + b"END")
    assert len(chunk) == quality.CHUNKS and len({c.tobytes() for c in chunk}) >= 1


def test_one_label_only(spark):
    docs = table(spark, SF, "documents").limit(300)
    labels = table(spark, SF, "labels").withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(0))
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, labels).collect()} == {(1.0, 1)}
    assert {(r["score"], r["predicted"]) for r in quality.quality(docs, labels).collect()} == {(0.0, 0)}


def test_workers_learn_what_one_process_learns(spark, rows):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    drawn = labelled_sample(docs, labels, "toxic", rows=250).orderBy("place").collect()
    a, b = toxicity.learn(docs, labels, rows=250, parts=3), toxicity.fit([(r["text"].encode(), r["y"]) for r in drawn])
    assert a["word_odds"] == pytest.approx(b["word_odds"]) and a["gram_odds"] == pytest.approx(b["gram_odds"])
    texts = [t for t, _ in rows[:60]]
    assert toxicity.Scorer(a)(texts) == pytest.approx(toxicity.Scorer(b)(texts), abs=0.02)


def test_chunks_of_a_long_text_come_from_all_of_it():
    text = b"".join(b"%08d" % k for k in range(40_000))
    chunk = [bytes(c) for c in quality.drawn_chunks(text, 40)]
    places = [int(c[:8]) for c in chunk]
    assert len(set(places)) == 40 and places == sorted(places) and min(places) < 8_000 and max(places) > 32_000
    assert [bytes(c) for c in quality.drawn_chunks(text, 40)] == chunk  # the same on every run
    assert len(quality.drawn_chunks(text, 10**6)) == len(quality.chunks(text))


def test_more_windows_hold_the_fewer(rows):
    counts = toxicity.Counts(4)
    for text, y in rows:
        counts.add(text, y)
    words, grams = counts.all_odds()
    long = max((t for t, _ in rows), key=len)
    shapes = [len(toxicity.training_windows(long, words, grams, most)[0]) for most in (1, 3, 6, 12)]
    assert shapes[0] == 1 and shapes[1] <= 3 and shapes[3] <= 12 and shapes == sorted(shapes)


def test_rows_that_stay_keep_all_their_columns(spark):
    """Columns named like those that the operator works with."""
    docs = table(spark, SF, "documents").limit(300).selectExpr("doc_id", "text", "doc_id + 1 AS id", "'s' AS score", "doc_id % 7 AS place", "0.5D AS y", "array(doc_id) AS gone")
    labels = table(spark, SF, "labels")
    kept = toxicity.without_toxic(docs, labels, rows=250)
    assert kept.schema == docs.schema
    bad = {r["doc_id"] for r in toxicity.toxicity(docs.select("doc_id", "text"), labels, rows=250).filter("score >= 0.5").collect()}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] not in bad)
