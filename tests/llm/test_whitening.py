"""Whitening against numpy's eigenvectors and exact sums in Python, odd matrices and odd tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from skyframe.llm import queries, whitening

KIND = "vec_id long, embedding array<double>, x int, n int, component int"


def spectra():
    rng = np.random.default_rng(7)
    turned = lambda values: (q := np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]) @ np.diag(values) @ q.T
    yield "plain", turned(rng.uniform(0, 9, 30))
    yield "equal", turned([5.0] * 6 + [1.0] * 10)
    yield "near", turned([5, 5 - 1e-10, 5 - 2e-10, 5 - 1e-13, 2, 1, 1 - 1e-7, 1e-9, 0, 0])
    yield "graded", turned(10.0 ** -np.arange(14))
    yield "diagonal", np.diag([1.0, 3.0, 2.0, 3.0])
    yield "one", np.array([[4.0]])
    yield "zero", np.zeros((5, 5))
    yield "indefinite", turned([3.0, -8.0, 1e-3, 0.0, -2.0])
    yield "two", np.array([[0.0, 1.0], [1.0, 0.0]])


@pytest.mark.parametrize("name, a", list(spectra()))
def test_leading(name, a):
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a, 16)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:16]
    norm = max(np.abs(want).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-14 * len(a) * norm
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() <= 1e-13
    for s in (-1.0, 0.5, 1.5, 4.2):
        assert whitening.inertia(a - s * np.eye(len(a)))[0] == (np.linalg.eigvalsh(a) < s).sum()


def brute(rows, components=16):
    """(id, component) -> (n, deviation, whitened up to its sign, explained), all sums exact."""
    fine = [(k, v) for k, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in fine), default=0)
    xs = [(k, [math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))) for k, v in fine]
    fit = sorted({tuple(x) for _, x in xs})
    if not width:
        return []
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[float(Fraction(c) - Fraction(t, n)) for c, t in zip(x, s, strict=True)] for x in fit])
    v = off.T @ off / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for k, x in xs:
        d = np.array([float(Fraction(c) - Fraction(t, n)) for c, t in zip(x, s, strict=True)])
        for j in range(len(e)):
            some = e[j] > width * 2.3e-16 * np.trace(v)
            out.append((k, j + 1, n, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), abs(d @ u[:, j] / e[j] ** 0.5) if some else None, e[j] / np.trace(v) if some else 0.0))
    return out


def check(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0, r[4] or 0.0)
    own = sorted(((r[0], r[1], r[2], r[3], r[4] if r[4] is None else abs(r[4]), r[5]) for r in got), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:4] for r in own] == [r[:4] for r in want]
    for a, b in zip(own, want, strict=True):
        assert (a[4] is None) == (b[4] is None)
        assert (a[4] or 0.0, a[5]) == pytest.approx((b[4] or 0.0, b[5]), rel=1e-7, abs=1e-7)
    errors = {r["identity_error"] for r in got}
    assert len(errors) <= 1 and all(x < 1e-9 for x in errors)


def test_random_vectors_with_copies_and_nulls(spark):
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((300, 20)) * np.linspace(3, 0.1, 20)).tolist()
    rows = [(i, v, 1, 1, 1) for i, v in enumerate(base)] + [(1000 + i, base[0], 1, 1, 1) for i in range(400)]
    rows += [(2, None, 1, 1, 1), (3, [None] + base[0][1:], 1, 1, 1), (4, [math.nan] + base[0][1:], 1, 1, 1), (5, [math.inf] + base[0][1:], 1, 1, 1), (None, base[5], 1, 1, 1), (7, base[6], 1, 1, 1)]
    check(spark, rows)


def test_small_and_empty_tables(spark):
    for rows in ([], [(1, [1.0, 2.0], 1, 1, 1)], [(1, [1.0, 2.0], 1, 1, 1)] * 3, [(1, [], 1, 1, 1)], [(1, [0.5], 1, 1, 1), (2, [], 1, 1, 1), (3, [0.5, 9.0, 1.0], 1, 1, 1)],
                 [(1, None, 1, 1, 1)], [(i, [float(i), 2.0 * i, 0.0], 1, 1, 1) for i in range(9)]):
        check(spark, rows)


def test_a_mean_far_away_costs_no_digits(spark):
    rng = np.random.default_rng(5)
    check(spark, [(i, (rng.standard_normal(4) + 2.0**30).tolist(), 1, 1, 1) for i in range(200)])


def test_entries_too_large_for_a_long(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0], 1, 1, 1), (2, [-1e300, 0.0], 1, 1, 1), (3, [0.0, 5.0], 1, 1, 1)], KIND)).collect()
    assert len(out) == 6 and {r["deviation"] for r in out if r["vec_id"] == 1} == {None}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1], 1, 1, 1) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {(r[0], r[1]): r for r in queries.op12_embedding_whitening(spark, sf).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    for k, j, n, deviation, whitened, explained in want:
        r = got[k, j]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert (abs(r["whitened"]), r["explained"]) == pytest.approx((whitened, explained), rel=1e-6, abs=1e-8)
