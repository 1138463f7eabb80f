"""Velocity folds on small sweeps whose answers are known, and choices of centres against a plain loop."""

import numpy as np
import pandas as pd

from skyframe.operators import radar


def test_unfold_follows_the_beam():
    v = np.array([[8.0, 9.0, -9.0, -8.0, 9.0]])
    assert radar.unfold(v, np.array([10.0])).tolist() == [[8.0, 9.0, -9.0, 12.0, 9.0]]  # two gates before are too few to lead
    two = np.array([[8.0, 9.0, 9.5, 9.0], [8.0, -9.5, 9.0, 9.0]])
    assert radar.unfold(two, np.array([10.0, 10.0]))[1].tolist() == [8.0, 10.5, 9.0, 9.0]  # else the beam before leads
    assert radar.unfold(two, np.array([0.0, 0.0])).tolist() == two.tolist()


def test_pairs_of_neighbours_settle_a_beam():
    v = np.array([[9.0, 5.0], [-11.0, 5.0], [9.0, np.nan]])
    assert radar.despoke_pairs(v.copy(), np.full(3, 10.0))[1].tolist() == [9.0, 5.0]


def test_median_of_neighbours_settles_a_beam():
    v = np.full((9, 2), 9.0)
    v[4] = [-11.0, np.nan]
    out = radar.despoke_median(v.copy(), np.full(9, 10.0))
    assert out[4, 0] == 9.0 and np.isnan(out[4, 1])


def test_runs_go_back_in_place():
    """Runs that no neighbour backs go back to what was measured; a beam sees its neighbours as they are by then."""
    raw = np.full((5, 20), -10.0)
    both = raw.copy()
    both[1], both[2] = 46.0, 46.0
    assert (radar.revert_runs(both.copy(), raw) == both).all()  # each backs the other
    alone = raw.copy()
    alone[2] = 46.0
    assert (radar.revert_runs(alone.copy(), raw) == raw).all()
    one = np.full((1, 20), 46.0)
    assert (radar.revert_runs(one.copy(), np.full((1, 20), -10.0)) == 46.0).all()  # under three beams a beam backs itself
    chain = raw.copy()
    chain[1], chain[2, :6], chain[2, 6:] = 46.0, 46.0, 20.0
    assert (radar.revert_runs(chain.copy(), raw)[1] == -10.0).all()  # backed in 30 % of its gates
    row = raw.copy()
    row[1], row[2], row[3, :10] = 46.0, 46.0, -10.0
    row[1, :14] = 20.0  # backs nothing, and its own run is too short
    assert (radar.revert_runs(row.copy(), raw)[2] == -10.0).all()


def test_suppression_equals_a_plain_loop(spark):
    from skyframe.operators import grid

    rng = np.random.default_rng(3)
    rows = [(int(t), k, int(rng.integers(40)), int(rng.integers(40)), float(rng.integers(20))) for t in range(3) for k in "HL" for _ in range(60)]
    df = spark.createDataFrame(rows, "time int, kind string, i int, j int, score double")
    got = {tuple(r) for r in grid.suppress_nearby(df, ["time", "kind"], "score", "i", "j", 6, 10).collect()}
    want = set()
    for _, g in pd.DataFrame(rows, columns=["time", "kind", "i", "j", "score"]).groupby(["time", "kind"]):
        kept = []
        for r in sorted(g.itertuples(index=False), key=lambda r: (-r.score, r.j, r.i)):
            if len(kept) < 10 and all((r.i - q.i) ** 2 + (r.j - q.j) ** 2 >= 36 for q in kept):
                kept.append(r)
        want |= {tuple(r) for r in kept}
    assert got == want
