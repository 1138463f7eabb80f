"""Sums over all segmentations for words of any length."""

from collections import Counter

import numpy as np
import pytest

from skyframe.llm import langid, queries

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def vocabulary():
    return langid._vocabulary(queries.PIECE_BPE)


def sum_of_segmentations(vocabulary, text, logp):
    """Natural log, per language, of the sum over all segmentations: a plain recurrence over places, in logs."""
    pieces = {}
    _, start, end, piece, _ = vocabulary.arcs([text])
    for s, e, q in zip(start.tolist(), end.tolist(), piece.tolist(), strict=True):
        pieces.setdefault(e, []).append((s, q))
    out = [np.zeros(logp.shape[1])]
    for e in range(1, len(text) + 1):
        out.append(np.logaddexp.reduce([out[s] + logp[q] for s, q in pieces[e]], axis=0))
    return out[-1]


def test_long_words_are_not_cut(vocabulary, monkeypatch):
    words = ["ab" * 100, "größenordnung" * 30, "x" * 41, "語" * 200, "la"]
    logp = np.log(RNG.random((vocabulary.size, 3)) * 1e-4)
    want = [sum_of_segmentations(vocabulary, langid.marked(w), logp) for w in words]
    assert langid.log_scores(vocabulary, words, logp) == pytest.approx(np.array(want))
    monkeypatch.setattr(langid, "STRETCH", 7)  # arcs that cross stretches count once
    assert langid.log_scores(vocabulary, words, logp) == pytest.approx(np.array(want))
    cut = sum(langid.log_scores(vocabulary, ["ab" * 20], logp)[0] for _ in range(5))
    assert abs(want[0] - cut).max() > 1e-3


def test_sums_below_plain_numbers_are_kept(vocabulary):
    logp = np.full((vocabulary.size, 2), np.log(1e-30))
    logp[:, 1] = np.log(1e-40)
    got = langid.log_scores(vocabulary, ["q\u0378" * 18, "la"], logp)
    assert got[0] == pytest.approx(sum_of_segmentations(vocabulary, langid.marked("q\u0378" * 18), logp)) and got[0, 1] < -800


def test_expected_counts_are_one_sum(vocabulary, monkeypatch):
    words = Counter({"wordsofany": 3, "length" * 5: 2})
    plain = langid.expected_counts(vocabulary, words)
    monkeypatch.setattr(langid, "TOGETHER", 0)
    monkeypatch.setattr(langid, "STRETCH", 5)
    assert langid.expected_counts(vocabulary, words) == pytest.approx(plain)
    assert plain[plain > 0].size > 10


def test_a_long_word_changes_the_prediction_as_a_whole(spark):
    """A text that is one 200-character word is scored by the sum over all of it."""
    docs = spark.createDataFrame([(k, "haus und baum " * 5, "de") for k in range(20)] + [(100 + k, "house and tree " * 5, "en") for k in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(docs, queries.PIECE_BPE)
    word = "haus" * 50
    got = langid.identify(spark.createDataFrame([(1, word), (2, "und" * 5000)], "doc_id long, text string"), model, queries.PIECE_BPE).collect()
    s = model["prior"] + sum_of_segmentations(langid._vocabulary(queries.PIECE_BPE), langid.marked(word), model["logp"])
    row = {r["doc_id"]: r for r in got}[1]
    assert row["lang_pred"] == model["langs"][int(s.argmax())] == "de"
    assert row["score"] == pytest.approx(1 / np.exp(s - s.max()).sum())
