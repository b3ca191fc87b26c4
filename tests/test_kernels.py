"""Sliding kernels against sorting every window, and the decomposition against a plain one."""

import datetime
import random

import numpy as np
import pytest

from watchpost.functions import kernels as ke

DAY = datetime.date(2024, 1, 1)


def median(xs):
    xs = sorted(xs)
    return (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2


def brute(values, window=42, least=14, base_least=10):
    """(z, baseline) of each row by sorting its windows anew."""
    meds, devs, out = [], [], []
    for i, x in enumerate(values):
        rows = [v for v in values[max(0, i - window + 1) : i + 1] if v is not None]
        before = [v for v in values[max(0, i - window) : i] if v is not None]
        meds.append(median(rows) if len(rows) >= least else None)
        devs.append(None if x is None or meds[i] is None else abs(x - meds[i]))
        away = [d for d in devs[max(0, i - window + 1) : i + 1] if d is not None]
        mad = median(away) if len(away) >= least else None
        scale = mad / 0.6745 if mad else float(np.std(rows)) if len(rows) >= least else None
        z = (x - meds[i]) / scale if x is not None and meds[i] is not None and scale else 0.0
        out.append((z, median(before) if len(before) >= base_least else None))
    return out


def test_trailing_equals_sorted_windows(spark):
    rng = random.Random(2)
    series = {("a", 1): [rng.gauss(10, 3) for _ in range(200)], ("a", None): [float(rng.randrange(3)) for _ in range(150)], ("b", 1): [None if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(120)], (None, 2): [5.0] * 60 + [6.0] + [5.0] * 5, ("c", 3): [1.0] * 13, ("d", 3): [], ("e", 3): [None] * 30}
    rows = [(k, s, DAY + datetime.timedelta(i), v, "kept") for (k, s), xs in series.items() for i, v in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, s int, date date, value double, z2 string").repartition(5)
    got = ke.trailing(df, ["k", "s"], baseline="base")
    assert got.columns == [*df.columns, "z", "base"]
    found = {(r.k, r.s, r.date): (r.z, r.base) for r in got.collect()}
    assert len(found) == len(rows)
    for (k, s), xs in series.items():
        for i, (z, base) in enumerate(brute(xs)):
            a, b = found[k, s, DAY + datetime.timedelta(i)]
            assert a == pytest.approx(z, abs=1e-9) and (b == base if base is None or b is None else b == pytest.approx(base))
    only = {(r.k, r.s, r.date): r.b for r in ke.trailing(df, ["k", "s"], z=None, baseline="b").collect()}
    assert only == {key: base for key, (_, base) in found.items()}
    assert ke.trailing(df.limit(0), ["k", "s"]).count() == 0


def test_series_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        xs = [float(x) for x in np.random.default_rng(1).normal(0, 1, 100)]
        df = spark.createDataFrame([("a", DAY + datetime.timedelta(i), v) for i, v in enumerate(xs)] + [("b", DAY, 1.0)], "k string, date date, value double")
        got = {r.date: r.z for r in ke.trailing(df, ["k"]).where("k = 'a'").collect()}
        assert [got[DAY + datetime.timedelta(i)] for i in range(100)] == pytest.approx([z for z, _ in brute(xs)], abs=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_loess(y, x, q, weight):
    """One place: a weighted line through the q nearest points, by its normal equations."""
    m = len(y)
    k = min(q, m)
    first = min(max(x - (q - 1) // 2, 0), m - k)
    reach = max(abs(x - first), abs(first + k - 1 - x)) + max(0, (q - m) // 2)
    at = np.arange(first, first + k)
    w = np.array([(1 - min(1.0, abs(i - x) / reach) ** 3) ** 3 if reach else 1.0 for i in at]) * weight[at]
    if not w.sum():
        return y[min(max(x, 0), m - 1)]
    mean = (w * at).sum() / w.sum()
    if np.sqrt((w * (at - mean) ** 2).sum() / w.sum()) <= 0.001 * max(m - 1, 1):
        return (w * y[at]).sum() / w.sum()
    root = np.sqrt(w)
    line, *_ = np.linalg.lstsq(np.stack([root, root * (at - x)], 1), root * y[at], rcond=None)
    return line[0]


def plain_stl(y, period=7, seasonal=7, inner=2, outer=15):
    """The season, place by place."""
    n, ones = len(y), np.ones(len(y))
    low, long = 9, 15
    trend, weight = np.zeros(n), ones
    for k in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                own, w = (y - trend)[p::period], weight[p::period]
                cycle[p::period] = [plain_loess(own, x, seasonal, w) for x in range(-1, len(own) + 1)]
            level = cycle
            for width in (period, period, 3):
                level = np.array([level[i : i + width].mean() for i in range(len(level) - width + 1)])
            level = np.array([plain_loess(level, x, low, ones) for x in range(n)])
            season = cycle[period : n + period] - level
            trend = np.array([plain_loess(y - season, x, long, weight) for x in range(n)])
        miss = np.abs(y - season - trend)
        six = 6 * np.median(miss)
        ratio = miss / six if six else np.where(miss > 0, 1.0, 0.0)
        weight = np.where(ratio <= 0.001, 1.0, np.where(ratio <= 0.999, (1 - np.minimum(ratio, 1) ** 2) ** 2, 0.0))
    return season


def seasonal_series(rng, n):
    days = np.arange(n)
    y = 20 + 3 * np.sin(2 * np.pi * days / 7) * (1 + days / n) + 0.02 * days + rng.normal(0, 0.4, n)
    y[rng.integers(n, size=max(1, n // 25))] += 15
    return y


def test_decomposition_equals_a_plain_one():
    rng = np.random.default_rng(4)
    lengths = [16, 17, 20, 29, 45, 45, 60, 16]
    series = [seasonal_series(rng, n) for n in lengths] + [np.full(30, 4.0), np.zeros(15), np.zeros(0), np.arange(40.0)]
    gap = seasonal_series(rng, 40)
    gap[7] = np.nan
    got = ke.decomposed([*series, gap])
    for s, season in zip(series, got, strict=False):
        assert season == pytest.approx(plain_stl(s) if len(s) >= 16 else np.zeros(len(s)), abs=1e-6)
    assert not got[-1].any()


def test_two_hundred_series_alone_or_together():
    rng = np.random.default_rng(5)
    series = [seasonal_series(rng, int(n)) for n in rng.integers(16, 40, 200)]
    together = ke.decomposed(series)
    for i, s in enumerate(series):
        assert together[i] == pytest.approx(ke.stl(s[None])[0][0], abs=1e-9)
        if i % 40 == 0:
            assert together[i] == pytest.approx(plain_stl(s), abs=1e-6)


def test_decomposition_leaves_the_cycle_out_and_the_outbreak_in(spark, monkeypatch):
    rng = np.random.default_rng(6)
    days = np.arange(140)
    weekly = 5 * np.array([3, 1, 0, 0, 0, -1, -3])[days % 7]
    quiet, ill = 50 + weekly + rng.normal(0, 0.5, 140), 50 + weekly + rng.normal(0, 0.5, 140) + np.maximum(0, days - 120) * 1.5
    rows = [(k, "s", DAY + datetime.timedelta(int(i)), float(v), 1) for k, xs in (("quiet", quiet), ("ill", ill), ("short", quiet[:10])) for i, v in enumerate(xs)] + [("gap", "s", DAY + datetime.timedelta(i), None if i == 9 else float(i % 7), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "district_id string, signal_type string, date date, value double, n int").repartition(3)
    monkeypatch.setattr(ke, "GATHERED", 50)
    got = ke.stl_residual_z(df).collect()
    assert len(got) == len(rows)
    by = {k: sorted((r.date, r.season, r.z) for r in got if r.district_id == k) for k in ("quiet", "ill", "short", "gap")}
    assert np.abs(np.array([s for _, s, _ in by["quiet"]])[20:120] - weekly[20:120]).mean() < 1
    assert max(z for _, _, z in by["ill"][125:]) > 6 > max(z for _, _, z in by["quiet"][60:])
    assert all(s == 0 for k in ("short", "gap") for _, s, _ in by[k])
    assert [z for _, _, z in by["gap"]] == pytest.approx([z for z, _ in brute([None if i == 9 else float(i % 7) for i in range(40)])], abs=1e-9)
