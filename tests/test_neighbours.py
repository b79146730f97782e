"""Exact nearest neighbours against all distances."""

import math

import numpy as np
import pytest

from lakeloom.operators import neighbours


def brute(queries, points, k, others, metric):
    def vector(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        if metric == "cosine":
            length = math.sqrt(sum(x * x for x in v))
            return [x / length for x in v] if length else None
        return v

    out = []
    for q, v in queries:
        if q is None or (v := vector(v)) is None:
            continue
        found = sorted((math.dist(v, w), p) for p, w in ((p, vector(w)) for p, w in points) if p is not None and w is not None and len(w) == len(v) and not (others and p == q))
        out += [(q, r + 1, p, d) for r, (d, p) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "metric", "others"), [(2048, 32, "euclidean", True), (25, 2, "euclidean", False), (10, 3, "cosine", True)])
def test_nearest(spark, monkeypatch, block, chunk, metric, others):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "CELL", 30)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(5, 3)) * 4
    rows = [(i, [float(x) for x in np.round(centres[i % 5] + rng.normal(size=3) / 2, 1)]) for i in range(250)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[3], rows[3]]
    rows += [(None, [1.0, 2.0, 3.0]), (2000, None), (2001, []), (2002, [0.0, 0.0, 0.0]), (2003, [1.0, None, 2.0]), (2004, [1.0, float("nan"), 2.0]), (2005, [1.0, 2.0]), (2006, [1.0, 2.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    asked = df.where("vec_id % 3 = 0 OR vec_id > 1000")
    got = sorted(tuple(r) for r in neighbours.nearest(asked, df, 4, metric=metric, others=others).collect())
    want = brute([r for r in rows if r[0] is not None and (r[0] % 3 == 0 or r[0] > 1000)], rows, 4, others, metric)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert neighbours.nearest(df.limit(0), df, 4).count() == neighbours.nearest(df, df.limit(0), 4).count() == 0
    with pytest.raises(ValueError, match="metric"):
        neighbours.nearest(df, df, 1, metric="hamming")


def test_bounds_shrink():
    """A block beyond every query's bound is left out; one within some bounds is compared with these queries alone."""
    rng = np.random.default_rng(1)
    q = neighbours._Block(range(50), rng.normal(size=(50, 4)))
    best = neighbours.Nearest(q, 3, True)
    best.meet(neighbours._Block(range(100, 200), rng.normal(size=(100, 4))), np.zeros(4), 9.0)
    assert np.isfinite(best.bound).all()
    before, calls = best.bound.copy(), []
    plain = neighbours._distances
    try:
        neighbours._distances = lambda a, b: (calls.append(len(a)), plain(a, b))[1]
        best.meet(neighbours._Block([300], [[50.0] * 4]), np.full(4, 50.0), 0.0)
        assert not calls
        best.meet(neighbours._Block([301], [q.x[0] + 1e-3]), q.x[0], 0.01)
        assert calls and calls[0] < 50 and best.bound[0] < before[0]
    finally:
        neighbours._distances = plain


def test_far_blocks_are_not_dealt():
    import pandas as pd

    pivots = np.array([[0.0], [10.0], [20.0], [30.0]])
    meta = pd.DataFrame({"block": [1, 2, 3, 4], "cell": [0, 1, 2, 3], "radius": [1.0] * 4})
    asking = pd.DataFrame({"q": [7, 8], "cell": [0, 2], "radius": [1.0, 1.0], "bound": [3.0, float("inf")]})
    found = pd.concat(neighbours._pairs(pivots, meta)(iter([asking])))
    assert found[found.q == 7].block.tolist() == [1] and found[found.q == 8].block.tolist() == [3, 2, 4, 1]


def test_query_blocks_form_few_groups(monkeypatch):
    """A point block goes to at most as many tasks as there are groups, however many query blocks need it."""
    import pandas as pd

    blocks = pd.DataFrame({"block": range(100), "cell": [i % 4 for i in range(100)], "n": [2048] * 100})
    pivots = np.array([[0.0], [10.0], [20.0], [30.0]])
    found = neighbours._groups(blocks, pivots)
    assert sorted(b for b, _ in found) == list(range(100)) and {g for _, g in found} == set(range(8))
    assert all(len({b % 4 for b, g2 in found if g2 == g}) <= 2 for g in range(8))
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 20480)
    assert {g for _, g in neighbours._groups(blocks, pivots)} == set(range(10))
    assert neighbours._groups(blocks[:0], pivots) == []
