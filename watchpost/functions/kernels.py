"""Kernels over sorted series: sliding order statistics and a robust seasonal decomposition by local regression.

Spark deals and sorts the series; a task reads its rows in order, a batch at a time, and carries what a window still needs from
one batch to the next, so that no series has to fit anywhere.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


class Sliding:
    """The median of the numbers among the last `window` rows: a sorted ring, in which a row costs two searches."""

    __slots__ = ("order", "ring", "window")

    def __init__(self, window: int):
        self.window, self.ring, self.order = window, deque(), []

    def push(self, x: float | None) -> None:
        ring, order = self.ring, self.order
        if len(ring) == self.window and (old := ring.popleft()) is not None:
            del order[bisect_left(order, old)]
        ring.append(x)
        if x is not None:
            insort(order, x)

    def median(self, least: int) -> float | None:
        """None with fewer than `least` numbers."""
        n = len(self.order)
        if n < least or not n:
            return None
        half = n // 2
        return self.order[half] if n % 2 else 0.5 * self.order[half - 1] + 0.5 * self.order[half]

    def deviation(self) -> float:
        """Population deviation of the numbers, from their own mean."""
        x = np.array(self.order)
        return float(np.sqrt(np.mean((x - x.mean()) ** 2)))


class Trailing:
    """Robust z of each row against the `window` rows that end with it, and the median of the `window` rows before it."""

    def __init__(self, window: int, least: int, base_least: int):
        self.values, self.away, self.least, self.base_least = Sliding(window), Sliding(window), least, base_least

    def step(self, x: float | None) -> tuple[float, float | None]:
        base = self.values.median(self.base_least)
        self.values.push(x)
        middle = self.values.median(self.least)
        off = None if x is None or middle is None else x - middle
        self.away.push(None if off is None else abs(off))
        if off is None:
            return 0.0, base
        spread = self.away.median(self.least)
        if spread:
            return off / (spread / 0.6745), base
        scale = self.values.deviation()
        return (off / scale if scale else 0.0), base


def sorted_series(df: DataFrame, keys: list[str], order: str, value: str, kernel: Callable[[], Callable[[list], list[tuple]]], out: list[str]) -> DataFrame:
    """df with the double columns `out`: kernel() makes what turns the next values of a series, in order, into as many tuples. Null and NaN
    reach it as None; null keys make a series like any other; ties of the order go by value."""
    names = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(value).cast("double").alias("_x"), F.xxhash64(*keys).alias("_s"))
    at = [names.index(k) for k in keys]
    dealt = plain.repartition(*[f"c{i}" for i in at]).sortWithinPartitions("_s", *[f"c{i}" for i in at], f"c{names.index(order)}", "_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(n_columns).to_numpy(zero_copy_only=False)
            values = [None if v != v else v for v in x.tolist()]
            starts = [0, *_changes(batch, at, n_columns + 1)]
            found: list[tuple] = []
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                name = tuple(batch.column(i)[a].as_py() for i in at)
                if step is None or name != now:
                    now, step = name, kernel()
                found += step(values[a:b])
            columns = [pa.array(c, pa.float64()) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], *columns], [f"c{i}" for i in range(n_columns)] + [f"_o{k}" for k in range(len(out))])

    n_columns = len(names)
    schema = StructType([*[StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)], *[StructField(f"_o{k}", DoubleType()) for k in range(len(out))]])
    done = dealt.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[F.col(f"_o{k}").alias(c) for k, c in enumerate(out)])


def trailing(df: DataFrame, keys: list[str], value: str = "value", order: str = "date", window: int = 42, least: int = 14, base_least: int = 10, z: str | None = "z", baseline: str | None = None) -> DataFrame:
    """Adds z and baseline, those that are named, in one pass over the sorted series."""

    def kernel() -> Callable[[list], list[tuple]]:
        own = Trailing(window, least, base_least)
        if z and baseline:
            return lambda xs: [own.step(x) for x in xs]
        if z:
            return lambda xs: [(own.step(x)[0],) for x in xs]
        only = Sliding(window)

        def base(xs: list) -> list[tuple]:
            out = []
            for x in xs:
                out.append((only.median(base_least),))
                only.push(x)
            return out

        return base

    return sorted_series(df, keys, order, value, kernel, [c for c in (z, baseline) if c])


def _near(x: np.ndarray, m: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the q points 0 .. m - 1 nearest to each x (all points where there are fewer), and how far they reach from x; a
    window of more points than there are reaches farther by half of those that are missing."""
    k = min(q, m)
    first = np.clip(x - (q - 1) // 2, 0, m - k)
    reach = np.maximum(np.abs(x - first), np.abs(first + k - 1 - x)).astype(float)
    return first, reach + max(0, (q - m) // 2)


def loess(y: np.ndarray, q: int, at: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Local lines through the rows of y (series x points at 0, 1, ..) at the places `at`, with tricube weights over the q nearest points, times `weight`.
    Where no point has a weight the value of the nearest point stays."""
    m = y.shape[1]
    x = np.arange(m) if at is None else at
    first, reach = _near(x, m, q)
    index = first[:, None] + np.arange(min(q, m))
    away = index - x[:, None]
    tricube = np.clip(1 - (np.abs(away) / np.maximum(reach, 1e-300)[:, None]) ** 3, 0, None) ** 3
    tricube[(reach == 0)] = 1.0
    w = tricube[None] if weight is None else tricube[None] * weight[:, index]
    total = w.sum(2)
    some = total > 0
    share = w / np.where(some, total, 1)[:, :, None]
    mean = (share * away).sum(2)
    off = away[None] - mean[:, :, None]
    spread = (share * off**2).sum(2)
    values = y[:, index]
    level = (share * values).sum(2)
    wide = np.sqrt(spread) > 0.001 * max(m - 1, 1)
    slope = np.where(wide, (share * off * values).sum(2) / np.where(wide, spread, 1), 0.0)
    return np.where(some, level - slope * mean, y[:, np.clip(x, 0, m - 1)])


def _moving(y: np.ndarray, k: int) -> np.ndarray:
    upto = np.concatenate((np.zeros((len(y), 1)), np.cumsum(y, 1)), 1)
    return (upto[:, k:] - upto[:, :-k]) / k


def stl(y: np.ndarray, period: int = 7, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(season, trend, weight) of each row of y (series x days) by LOESS, as published by Cleveland and others in 1990, with `outer` rounds of robustness weights.

    The windows of trend and low pass follow from the period: the next odd numbers from 1.5 * period / (1 - 1.5 / seasonal) and from period + 1."""
    n = y.shape[1]
    odd = lambda v: int(np.ceil(v)) | 1
    low, long = odd(period + 1), odd(1.5 * period / (1 - 1.5 / seasonal))
    trend, season, weight = np.zeros_like(y, float), np.zeros_like(y, float), None
    for k in range(outer + 1):
        for _ in range(inner):
            # Each place in the cycle is smoothed on its own and goes on by one period at both ends.
            cycle = np.zeros((len(y), n + 2 * period))
            for place in range(period):
                own = (y - trend)[:, place::period]
                cycle[:, place::period] = loess(own, seasonal, np.arange(-1, own.shape[1] + 1), None if weight is None else weight[:, place::period])
            level = loess(_moving(_moving(_moving(cycle, period), period), 3), low)
            season = cycle[:, period : n + period] - level
            trend = loess(y - season, long, weight=weight)
        if k < outer:
            miss = np.abs(y - season - trend)
            six = 6 * np.median(miss, 1, keepdims=True)
            ratio = miss / np.where(six > 0, six, 1)
            weight = np.where(ratio <= 0.001, 1.0, np.where(ratio <= 0.999, np.clip(1 - ratio**2, 0, None) ** 2, 0.0))
            weight = np.where(six > 0, weight, np.where(miss > 0, 0.0, 1.0))
    return season, trend, np.ones_like(y, float) if weight is None else weight


#: Rows of whole series that a task gathers before it decomposes them together, and numbers of a window that are held at once.
GATHERED, HELD = 20_000, 2_000_000


def decomposed(series: list[np.ndarray], period: int = 7) -> list[np.ndarray]:
    """The season of each series, many of one length at a time; 0 for series of under 2 * period + 2 rows and for those with a gap (NaN)."""
    out = [np.zeros(len(s)) for s in series]
    lengths: dict[int, list[int]] = {}
    for i, s in enumerate(series):
        if len(s) >= 2 * period + 2 and not np.isnan(s).any():
            lengths.setdefault(len(s), []).append(i)
    for n, which in lengths.items():
        step = max(1, HELD // (n * 16))
        for k in range(0, len(which), step):
            for i, season in zip(which[k : k + step], stl(np.stack([series[i] for i in which[k : k + step]]), period)[0], strict=True):
                out[i] = season
    return out


def stl_residual_z(df: DataFrame, keys: list[str] = ("district_id", "signal_type"), value: str = "value", order: str = "date", period: int = 7, window: int = 42, least: int = 14, season: str = "season", z: str = "z") -> DataFrame:
    """Adds each row's season by robust decomposition and the trailing z of what is left without it; the trend stays in, since a lasting rise is what
    is looked for. Series under 2 * period + 2 rows, and series with a missing value, keep their values and have the season 0. A task holds
    GATHERED rows and one series more; series are as long as their history."""
    keys, names = list(keys), df.columns
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(value).cast("double").alias("_x"), F.xxhash64(*keys).alias("_s"))
    at = [names.index(k) for k in keys]
    dealt = plain.repartition(*[f"c{i}" for i in at]).sortWithinPartitions("_s", *[f"c{i}" for i in at], f"c{names.index(order)}", "_x")
    n_columns = len(names)
    schema = StructType([*[StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)], StructField("_o0", DoubleType()), StructField("_o1", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def told(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.concat_batches(parts)
            x = whole.column(n_columns).to_numpy(zero_copy_only=False)
            starts = [0, *_changes(whole, at, n_columns + 1)]
            series = [x[a:b] for a, b in zip(starts, [*starts[1:], len(x)], strict=True)]
            seasons, scores = decomposed(series, period), []
            for s, off in zip(series, seasons, strict=True):
                own = Trailing(window, least, least)
                scores += [own.step(None if v != v else v)[0] for v in (s - off).tolist()]
            yield pa.RecordBatch.from_arrays([*whole.columns[:n_columns], pa.array(np.concatenate(seasons)), pa.array(scores, pa.float64())], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows > GATHERED:
                # All but the last series, which may go on.
                whole = pa.concat_batches(held)
                last = (_changes(whole, at, n_columns + 1) or [0])[-1]
                if last:
                    yield from told([whole.slice(0, last)])
                held, rows = [whole.slice(last)], whole.num_rows - last
        if rows:
            yield from told(held)

    done = dealt.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_o0").alias(season), F.col("_o1").alias(z))


def _changes(batch: pa.RecordBatch, at: list[int], hashed: int) -> list[int]:
    """Where another series begins, but for the first."""
    h = batch.column(hashed).to_numpy()
    new = h[1:] != h[:-1]
    for i in at:
        codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return (np.flatnonzero(new) + 1).tolist()
