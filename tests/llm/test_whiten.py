"""Whitening against numpy's own eigenvectors and against whole-number sums."""

import numpy as np
import pytest

from watchpost.llm import whiten


def matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 40, 64):
        a = rng.standard_normal((n, n))
        yield a @ a.T
    yield np.eye(12)
    yield np.diag([3.0, 3, 3, 2, 1, 1, 0, 0])
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    yield q @ np.diag(np.r_[np.full(10, 5.0), 5 - 1e-9, np.full(9, 1e-6), np.zeros(10)]) @ q.T
    yield np.ones((6, 6))
    yield 1e-200 * np.diag([1.0, 2, 3])
    yield np.zeros((4, 4))


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: str(len(a)))
def test_leading_components(a):
    a = (a + a.T) / 2
    values, vectors = whiten.leading_components(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    norm = np.abs(a).max()
    assert np.abs(values - want).max(initial=0) <= 1e-13 * len(a) * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-12 * norm * len(a)


def test_sturm_counts():
    d, e = np.array([2.0, 1, -1, 4]), np.array([0.5, 0, 2])
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.array([-9, *((values[1:] + values[:-1]) / 2), 9])
    assert whiten.sturm_counts(d, e, at).tolist() == [0, 1, 2, 3, 4]


def brute(rows, dims):
    """Per (vec_id, component): the values by definition, vectors from numpy, signs as they come."""
    sound = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    xs = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for _, v in sound]
    listed = sorted(set(xs))
    n = len(listed)
    sums = [sum(c) for c in zip(*listed, strict=True)]
    y = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in listed])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = {}
    for (i, _), x in zip(sound, xs, strict=True):
        z = np.array([c - s / n for c, s in zip(x, sums, strict=True)]) @ vectors / np.sqrt(values)
        for k in range(len(values)):
            out[i, k + 1] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), z[k], values[k] / np.trace(y.T @ y / n))
    return out


def test_rows_match_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((120, 20)) * np.linspace(0.3, 3, 20)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(500 + i, rows[3][1]) for i in range(40)]  # copies count once in the fit list
    rows += [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int").repartition(7)
    model = whiten.fit(df)
    got = whiten.long_form(whiten.whiten(df, model), model).collect()
    want = brute([(i, v) for i, v in rows if i < 904], 20)
    assert len(got) == len(want) and {(r.vec_id, r.component) for r in got} == want.keys()
    sign = {}
    for r in got:
        n, deviation, z, explained = want[r.vec_id, r.component]
        s = sign.setdefault(r.component, 1.0 if abs(r.whitened - z) < abs(r.whitened + z) else -1.0) if abs(z) > 0.1 else sign.get(r.component)
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - explained) < 1e-12 * max(1, explained)
        assert s is None or abs(r.whitened - s * z) < 1e-9
        assert r.identity_error < 1e-10


def test_empty_equal_and_wide_values(spark):
    schema = "vec_id long, embedding array<double>"
    for rows, count in (([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(None, [1.0, 2.0]), (2, [1.5, 2.0]), (2, [1.5, 2.0])], 3)):
        df = spark.createDataFrame(rows, schema)
        model = whiten.fit(df)
        assert whiten.long_form(whiten.whiten(df, model), model).count() == count
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], schema)
    model = whiten.fit(df)
    got = whiten.long_form(whiten.whiten(df, model), model).collect()
    assert [r.deviation for r in got] == [None, None] and all(abs(abs(r.whitened) - 1) < 1e-9 for r in got)
