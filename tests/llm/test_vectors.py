"""Whitening and hard negatives against plain NumPy, with nulls, repeats and hard spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.llm import hardnegatives as H
from tsengine.llm import vectors as V
from tsengine.llm import whitening as W

SPECTRA = [[5, 5, 5, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5], [3, 2, 1, 0, 0], [1, 1, 1], list(np.linspace(1, 1.0001, 40)), [1e6] + [1] * 20 + [1e-6] * 5, [0, 0]]


@pytest.mark.parametrize("lam", SPECTRA)
def test_refined_eigenvectors(lam):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(len(lam), len(lam))))
    a = (q * np.array(lam, float)) @ q.T
    a = (a + a.T) / 2
    _, x = np.linalg.eigh(a.astype(np.float32))
    got, v = W.refine(a.astype(np.longdouble), x[:, ::-1].astype(np.longdouble))
    scale = np.abs(a).max() or 1.0
    assert np.abs(v.T @ v - np.eye(len(lam))).max() < 1e-14
    assert np.abs(a @ v - v * got).max() < 1e-14 * scale
    assert np.allclose(got.astype(float), sorted(lam, reverse=True), atol=1e-13 * scale)


def frame(spark, rows, label=True):
    named = [(i, lab, v, "clash", "clash") for i, lab, v in rows]
    return spark.createDataFrame(named, "vec_id long, label int, vector array<double>, n string, component string").repartition(3)


def embeddings(seed, d, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.2, 3, d)
    x[n // 2 :] += rng.normal(size=d)
    rows = [(i, int(rng.integers(4)), [float(c) for c in v]) for i, v in enumerate(x)]
    rows[1] = (1, 1, None)
    rows[2] = (2, 1, [float("nan")] * d)
    rows[3] = (3, 1, [None] + rows[3][2][1:])
    rows[4] = (4, 1, [1.0])
    rows[5] = (5, 1, [])
    rows[50] = (50, None, rows[50][2])
    rows[100] = (100, 9, rows[100][2])  # the only one of its label
    rows[150] = (150, 1, [0.0] * d)
    rows[201] = (201, 1, rows[200][2])  # a tie
    return rows


def sound(rows):
    d = max(len(v) for _, _, v in rows if v)
    return [(i, lab, v) for i, lab, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]


def test_whitening(spark):
    rows = embeddings(1, 6, 400)
    rows.append(rows[60])
    got = W.whitened(frame(spark, rows).select("vec_id", "vector"), components=4).toPandas()
    x = np.floor(64 * np.array([v for _, _, v in sound(rows)])) + 1e6
    n, ids = len(x), np.array([i for i, _, _ in sound(rows)])
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    want = (x - x.mean(0)) @ v[:, :4] / np.sqrt(e[:4])
    assert len(got) == 4 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    deviation = dict(zip(ids, ((n * x.astype(int) - x.astype(int).sum(0)) ** 2).sum(1)))
    assert all(deviation[i] == s for i, s in zip(got["vec_id"], got["deviation"]))
    for k in range(4):
        mine = got[got["component"] == k + 1]
        mean = mine.groupby("vec_id")["whitened"].mean()
        w = np.array([want[ids == i, k].mean() for i in mean.index])
        assert np.allclose(mean, w * np.sign((mean * w).sum()), atol=1e-9)
        assert np.allclose(mine["explained"], e[k] / e.sum(), rtol=1e-9)


def test_whitening_of_little(spark):
    rows = [(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0]), (3, 0, None)]
    got = W.whitened(frame(spark, rows).select("vec_id", "vector")).collect()
    assert len(got) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 2 for r in got)
    assert W.whitened(frame(spark, rows[2:]).select("vec_id", "vector")).count() == 0


def test_sums_of_large_entries_are_exact(spark):
    rows = [(i, 0, [float(2**40 + i), -float(2**41)]) for i in range(9)]
    kept, d = V.fit_vectors(frame(spark, rows), "vector")
    n, s = W.sums(kept, d)
    scaled, _ = W.covariance(kept, d, n, s)
    x = [[64 * int(c) for c in v] for _, _, v in rows]
    assert s == [sum(c) for c in zip(*x)]
    assert scaled.tolist() == [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(2)] for i in range(2)]


def brute(rows):
    rows = [r for r in sound(rows) if r[1] is not None]
    x, ids, lab = np.floor(256 * np.array([v for *_, v in rows])).astype(int), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = []
    for a in np.flatnonzero(ids % 50 == 0):
        s = x @ x[a]
        first = lambda at, k: sorted(at, key=lambda i: (-s[i], ids[i]))[:k]  # noqa: B023, E731
        for p in first([i for i in np.flatnonzero(lab == lab[a]) if i != a], 5):
            near = [i for i in np.flatnonzero(lab != lab[a]) if 50 * s[p] <= 100 * s[i] <= 95 * s[p]]
            out += [(ids[a], ids[p], k + 1, ids[i], s[p], s[i]) for k, i in enumerate(first(near, 3))]
    return sorted(tuple(map(int, r)) for r in out)


@pytest.mark.parametrize("d, n", [(64, 900), (7, 700), (100, 400)])
def test_hard_negatives(spark, monkeypatch, d, n):
    rows = embeddings(d, d, n)
    if d == 7:  # many ties
        rows = [(i, lab, v and [c if c is None or not np.isfinite(c) else round(2 * c) / 8 for c in v]) for i, lab, v in rows]
        for name, size in (("BLOCK", 16), ("ANCHOR_BLOCKS", 1), ("ROW_BLOCKS", 3), ("TILE", 5), ("DENSE", 0.5)):
            monkeypatch.setattr(H, name, size)
    got = sorted(tuple(r) for r in H.hard_negatives(frame(spark, rows)).collect())
    assert got == brute(rows) and len(got) > 50


def test_hard_negatives_of_little(spark):
    none = frame(spark, embeddings(1, 3, 250)).filter("false")
    assert H.hard_negatives(none).count() == 0
    lone = frame(spark, embeddings(1, 3, 250)).filter("vec_id % 50 <> 0")
    assert H.hard_negatives(lone).count() == 0


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(2)
    for d in (1, 3, 64, 130):
        x = np.floor(rng.normal(size=(300, d)) * 50)
        x[0] = 0
        turn = H.rotation(d)
        codes = H.Codes(x, turn)
        lo, hi = H.Queries(x[:40], turn).interval(slice(0, 40), codes, H._words(codes.bits))
        s = x[:40] @ x.T
        assert (lo <= s).all() and (s <= hi).all()
        if d == 64:  # and tell something
            assert (hi - lo).mean() < 0.75 * 2 * np.outer(np.linalg.norm(x[:40], axis=1), np.linalg.norm(x, axis=1)).mean()


def test_scores_of_large_components_are_whole():
    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 3.0]])
    assert H.score(a, b).tolist() == [[2**60 + 3]]
    with pytest.raises(OverflowError):
        H.score(a * 8, b * 8)
