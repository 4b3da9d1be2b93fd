import math
from fractions import Fraction

import numpy as np
import pytest

from gleanframe.llm import whitening
from gleanframe.llm.spectral import eigen, polar_factor

SCHEMA = "vec_id long, embedding array<float>, n string, vector string, i string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "own", "own", "own") for i, v in vectors], SCHEMA)


def brute(vectors, components):
    """Exact sums in plain Python, eigenvectors by another solver."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors]
    n, width = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(width)]
    off = [[n * x[k] - sums[k] for k in range(width)] for _, x in kept]
    v = np.array([[float(Fraction(sum(o[a] * o[b] for o in off), n**3)) for b in range(width)] for a in range(width)])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    z = (np.array(off, float) / n) @ axes / np.sqrt(e)
    rows = {}
    for (i, _), o, zs in zip(kept, off, z):
        for c in range(min(components, width)):
            rows.setdefault((i, c + 1), []).append((n, sum(x * x for x in o), zs[c], e[c] / np.trace(v)))
    return rows


def vectors_of(n, width, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * np.linspace(3, 1, width) @ rng.standard_normal((width, width))
    return [(i, row.tolist()) for i, row in enumerate(x.astype(np.float32).astype(float))]


@pytest.mark.parametrize("partitions", [1, 7])
def test_rows_match_exact_sums(spark, partitions):
    good = vectors_of(300, 12) + [(7, [0.0] * 12)] * 100
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0] * 5)]
    got = whitening.whitened(table(spark, good + odd).repartition(partitions), components=8).collect()
    want = brute(good, 8)
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        matches = [w for w in want[r.vec_id, r.component] if (w[0], w[1]) == (r.n, r.deviation)]
        assert matches, r
        z, share = matches[0][2:]
        if abs(z) > 0.1:
            signs.setdefault(r.component, np.sign(z) * np.sign(r.whitened))
            assert np.sign(z) * np.sign(r.whitened) == signs[r.component]
        assert abs(abs(z) - abs(r.whitened)) < 1e-9 and abs(share - r.explained) < 1e-12
        assert r.identity_error < 1e-9


def test_partitions_do_not_matter(spark):
    rows = vectors_of(500, 6)
    model = [
        whitening.fit(table(spark, rows).repartition(p).selectExpr("cast(embedding AS array<double>) AS vector")) for p in (1, 5)
    ]
    assert (model[0].projection == model[1].projection).all() and (model[0].explained == model[1].explained).all()


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(i) * 2.0**40, float(i % 3), -1e30 if i == 3 else 2.0**50]) for i in range(9)]
    got = whitening.whitened(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} or {r.component for r in got} == {1}
    assert all(r.deviation is None for r in got)


def test_equal_and_missing_vectors_give_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 5, [(1, [])]):
        got = whitening.whitened(table(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert got.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_components_match_another_solver(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    for spectrum in (rng.random(n), np.r_[np.ones(n // 2), 2 * np.ones(n - n // 2)], np.logspace(0, -14, n), np.zeros(n), 1 + 1e-9 * np.arange(n)):
        a = q @ np.diag(spectrum) @ q.T
        a = (a + a.T) / 2
        e, v = eigen(a)
        scale = max(np.linalg.norm(a), 1e-300)
        assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * n * scale
        assert np.abs(a @ v - v * e).max() <= 1e-14 * n * scale and np.abs(v.T @ v - np.eye(n)).max() < 1e-13 * n


def test_polar_factor_holds_the_signs():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    for spectrum in (np.linspace(-1, 1.1, 9), np.array([1e-12, -1e-9, 1, 2, -3, 4, 5e3, -6, 7])):
        u = polar_factor(q @ np.diag(spectrum) @ q.T)
        assert np.abs(u - q @ np.diag(np.sign(spectrum)) @ q.T).max() < 1e-2 if min(abs(spectrum)) < 1e-8 else 1e-12
        assert np.abs(u @ u - np.eye(9)).max() < 1e-12
