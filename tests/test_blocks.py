"""Blocked products against numpy, for any size of block."""

import numpy as np
import pytest
from clipwright.operators import blocks as K

DIM = 6


def side(spark, r, n, groups=("a",), first=0):
    return [(groups[int(r.integers(len(groups)))], first + i, [float(x) for x in r.normal(size=DIM)]) for i in range(n)]


@pytest.mark.parametrize("block", [7, 1000])
def test_margin_excess(spark, block):
    r = np.random.default_rng(1)
    rows = side(spark, r, 90, (0, 1, 2)) + [(0, 900, [0.0] * DIM), (1, 901, None), (None, 902, [1.0] * DIM)]
    df = spark.createDataFrame(rows, "by long, id long, v array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 1), (2, 77)], "left long, right long")
    got = {(x.left, x.right): (x.n, x.loss) for x in K.margin_excess(df, pairs, 0.1, block).collect()}
    of = lambda k: K.unit(np.array([v for by, _, v in rows if by == k and v is not None]))
    for a, b in ((0, 1), (1, 1)):
        over = np.maximum(of(a) @ of(b).T - 0.1, 0)
        assert got[a, b][0] == over.size and got[a, b][1] == pytest.approx(over.mean(), abs=1e-12)
    assert set(got) == {(0, 1), (1, 1)}


@pytest.mark.parametrize("block", [5, 1000])
def test_silhouettes(spark, block):
    r = np.random.default_rng(2)
    rows = side(spark, r, 60, ("a", "b", "c")) + [("lone", 900, [0.0] * DIM), ("a", 901, [1.0] * DIM), ("a", 902, [1.0] * DIM)]
    got = {x.id: x.silhouette for x in K.silhouettes(spark.createDataFrame(rows, "by string, id long, v array<double>"), block).collect()}
    v, by = np.array([x[2] for x in rows]), np.array([x[0] for x in rows])
    far = np.sqrt(((v[:, None] - v) ** 2).sum(axis=2))
    for i, (own, key, _) in enumerate(rows):
        n = (by == own).sum()
        a = far[i, by == own].sum() / max(n - 1, 1)
        b = min(far[i, by == g].mean() for g in set(by) - {own})
        assert got[key] == pytest.approx(0.0 if n == 1 else (b - a) / max(a, b), abs=1e-9)


def test_one_cluster_and_no_rows(spark):
    schema = "by string, id long, v array<double>"
    assert [x.silhouette for x in K.silhouettes(spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0])], schema)).collect()] == [0.0, 0.0]
    assert K.silhouettes(spark.createDataFrame([], schema)).count() == 0
    assert K.nearest(spark.createDataFrame([], "id long, v array<double>"), spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), 3).count() == 0


@pytest.mark.parametrize("block", [4, 1000])
def test_nearest(spark, block):
    r = np.random.default_rng(3)
    q = [(i, v) for _, i, v in side(spark, r, 30)] + [(500, [0.0] * DIM)]
    w = [(i, v) for _, i, v in side(spark, r, 50)]
    w += [(100 + i, v) for i, v in w[:10]]
    df = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    got = {(x.id, x.rank): (x.word, x.s) for x in K.nearest(df(q), df(w), 3, block=block).collect()}
    s = np.round(K.unit(np.array([v for _, v in q])) @ K.unit(np.array([v for _, v in w])).T, 9)
    for i, (key, _) in enumerate(q):
        order = sorted(range(len(w)), key=lambda j: (-s[i, j], w[j][0]))[:3]
        assert [got[key, k + 1] for k in range(3)] == [(w[j][0], pytest.approx(s[i, j], abs=2e-9)) for j in order]


@pytest.mark.parametrize("of", [K.silhouettes, lambda df: K.nearest(df, df, 3)])
def test_copies_of_rows_do_not_grow_with_the_rows(spark, of, monkeypatch):
    """What every row is dealt out to is fixed, so what is shuffled grows with the rows."""
    seen, dealt = [], K._dealt

    def counted(*args):
        out = dealt(*args)
        seen.append(out)
        return out

    monkeypatch.setattr(K, "_dealt", counted)
    copies = []
    for n in (20_000, 60_000):
        seen.clear()
        of(spark.range(n).selectExpr("IF(id % 3 = 0, 'a', 'b') AS by", "id", "array(CAST(id % 7 AS double), CAST(id % 11 AS double)) AS v"))
        copies.append(sum(x.count() for x in seen) / n)
    assert copies[1] == pytest.approx(copies[0])


def test_best_words_of_equal_and_odd_rows():
    r = np.random.default_rng(4)
    x, y = K.unit(r.normal(size=(700, 3)).round(1)), K.unit(r.normal(size=(5000, 3)).round(0))
    x[3], x[5], y[7], word = np.nan, 0.0, np.nan, r.permutation(5000)
    s = np.round(x @ y.T, 9)
    order = np.lexsort((np.broadcast_to(word, s.shape), -s), axis=1)[:, :3]
    row, found, told = K.best_words(x, y, word, 3, 9)
    assert row.tolist() == np.repeat(np.arange(700), 3).tolist() and found.tolist() == word[order].reshape(-1).tolist()
    assert np.allclose(told, np.take_along_axis(s, order, 1).reshape(-1), atol=2e-9, equal_nan=True)
