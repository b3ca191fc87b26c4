"""Whitening of embeddings: leading principal components of a distributed covariance, broadcast to project every row.

Entries are read on a grid of whole numbers, x = floor(scale * entry) + offset, so that equal vectors are equal exactly. The
fit list has each distinct x once. Sums are whole numbers; each task centres its rows before it multiplies them and returns one
matrix of a dimension's square, and Spark adds these entry by entry. What the driver solves depends on the dimension alone:
Householder reflections make the covariance tridiagonal, Sturm counts bisect for its largest eigenvalues, inverse iteration
gives their vectors, which are made orthogonal within clusters of close eigenvalues, and the reflections turn them back.

Defined cases: rows whose vector is null, empty or has a null or non-finite entry are left out; where lengths differ, the
length that most rows have (the longer one of ties) is the dimension, and rows of other lengths are left out too. Grid values
stop at +-2^52. Components with an eigenvalue under 1e-13 of the trace are none: rows of equal vectors give no component
at all. `deviation` is null where it exceeds a long. Repeated rows each get their result, a null id too; an empty table gives none.
Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.sources.shared import scratch

COMPONENTS = 16
#: Eigenvalues nearer than this share of the matrix' norm are one cluster.
CLUSTER = 1e-3
#: Rows that are centred at once.
BLOCK = 4096
_MOST = 1 << 52
_LOW = (1 << 26) - 1


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that make a symmetric matrix tridiagonal."""
    a = a.copy()
    turns = []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        v[0] += length if v[0] >= 0 else -length
        size = np.linalg.norm(v)
        v = v / size if size else v
        turns.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each value: the negative pivots of its shifted factors."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def largest_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection of all at once."""
    around = np.abs(np.concatenate(([0.0], e))) + np.abs(np.concatenate((e, [0.0])))
    low, high = np.full(k, (d - around).min()), np.full(k, (d + around).max())
    spread = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - spread * 1e-12, high + spread * 1e-12
    below = len(d) - 1 - np.arange(k)  # eigenvalues that are smaller than the wanted one
    for _ in range(120):
        middle = (low + high) / 2
        under = sturm_counts(d, e, middle) > below
        low, high = np.where(under, low, middle), np.where(under, middle, high)
        if np.all(high - low <= 2 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))):
            break
    return (low + high) / 2


def _solver(d: np.ndarray, e: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges; pivots of less than `least` become that."""
    n = len(d)
    main, up, far = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        sub = float(e[i])
        if abs(main[i]) >= abs(sub):
            if abs(main[i]) < least:
                main[i] = least
            f = sub / main[i]
            steps.append((False, f))
            main[i + 1] -= f * up[i]
        else:
            f = main[i] / sub
            steps.append((True, f))
            main[i], main[i + 1], up[i] = sub, up[i] - f * main[i + 1], main[i + 1]
            far[i], up[i + 1] = up[i + 1], -f * up[i + 1]
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i, (turned, f) in enumerate(steps):
            if turned:
                x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
            else:
                x[i + 1] -= f * x[i]
        for i in range(n - 1, -1, -1):
            s = x[i]
            if i + 1 < n:
                s -= up[i] * x[i + 1]
            if i + 2 < n:
                s -= far[i] * x[i + 2]
            x[i] = s / main[i]
        return np.array(x)

    return solve


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest eigenvalues of a symmetric matrix, falling."""
    n, norm = len(a), float(np.abs(a).max()) if a.size else 0.0
    k = min(k, n)
    if not k or not norm:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, turns = tridiagonal(a / norm)
    values = largest_eigenvalues(d, e, k)
    size = float(np.abs(d).max() + 2 * (np.abs(e).max() if len(e) else 0))
    eps, rng = np.finfo(float).eps, np.random.default_rng(42)
    vectors, first, shift = np.zeros((n, k)), 0, np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * size:
            first = j
        # Equal eigenvalues get shifts a little apart, so that their solutions differ.
        shift = min(values[j], shift - 10 * eps * size) if j > first else values[j]
        solve, x = _solver(d, e, shift, eps * size), rng.standard_normal(n)
        for _ in range(6):
            before = vectors[:, first:j]
            for _ in range(2):
                x = x - before @ (before.T @ x)
            x = solve(x / np.linalg.norm(x))
            for _ in range(2):
                x = x - before @ (before.T @ x)
            x = x / np.linalg.norm(x)
        vectors[:, j] = x
    for i in range(len(turns) - 1, -1, -1):
        v, rest = turns[i], vectors[i + 1 :]
        rest -= 2 * np.outer(v, v @ rest)
    vectors /= np.linalg.norm(vectors, axis=0)
    return values * norm, vectors


@dataclass
class Whitening:
    """What projects a row: its grid, the fit list's size and sums, components as columns, their eigenvalues, and the total variance."""

    scale: int
    offset: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def projected(self, y: np.ndarray) -> np.ndarray:
        return y @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n * x - sums)^2."""
        whole, rest = (np.array([f(s) for s in self.sums], np.int64) for f in (lambda s: s // self.n, lambda s: s % self.n))
        near = x - whole
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((near * self.n - rest) ** 2).sum(1).tolist()
        exact = ((near.astype(object) * self.n - rest.astype(object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def grid(embeddings: DataFrame, vector: str, scale: int, offset: int, keep: list[str]) -> DataFrame:
    """The columns `keep` and x array<long> of the rows with a whole finite vector. Built-in functions only."""
    entries = F.col(vector).cast("array<double>")
    sound = embeddings.select(*keep, entries.alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = lambda c: F.greatest(F.least(F.floor(c * F.lit(float(scale))), F.lit(_MOST)), F.lit(-_MOST)) + F.lit(offset)
    return sound.select(*keep, F.transform("_v", whole).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, d: int, product: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows' x of product(block), a matrix of `width` columns: one a task, added entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch, d)
            for k in range(0, len(x), BLOCK):
                part = product(x[k : k + BLOCK])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], ["i", "row"])

    parts = rows.select("x").mapInArrow(run, "i int, row array<double>")
    found = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max((r.i for r in found), default=-1) + 1, width))
    for r in found:
        out[r.i, r.j] = r.v
    return out


def _whole_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each entry, as sums of high and low halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch, d)
            n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & _LOW).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["j", "n", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "j int, n long, high long, low long")
    found = {r.j: r for r in parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    return (found[0].n, [(found[j].high << 26) + found[j].low for j in range(d)]) if found else (0, [0] * d)


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """The whitening of the distinct grid vectors; None where no row has a sound vector."""
    rows = grid(embeddings, vector, scale, offset, [])
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths.d
    with scratch(embeddings.sparkSession) as keep:
        distinct = keep(rows.where(F.size("x") == d).distinct())
        n, sums = _whole_sums(distinct, d)
        found = Whitening(scale, offset, n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
        covariance = _summed(distinct, d, lambda x: (y := found.centred(x)).T @ y, d) / n
        found.trace = float(np.trace(covariance))
        values, vectors = leading_components((covariance + covariance.T) / 2, components)
        whole = int((values > 1e-13 * max(found.trace, np.finfo(float).tiny)).sum())
        found.values, found.components = values[:whole], vectors[:, :whole]
        if whole:
            # Second moments and, as the last row, the sums of the projected fit list.
            moments = _summed(distinct, d, lambda x: np.vstack([(z := found.projected(found.centred(x))).T @ z, z.sum(0)]), whole) / n
            error = moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(whole)
            found.identity_error = float(np.abs(error).max())
    return found


def whiten(embeddings: DataFrame, model: Whitening | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened array<double>) of each row that has a vector of the model's dimension. No shuffle."""
    kind = embeddings.schema[key].dataType.simpleString()
    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"{key} {kind}, deviation long, whitened array<double>")
    d = len(model.sums)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)  # of a size that depends on the dimension alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(k, BLOCK)
                x = _matrix(batch, d)
                z = own.projected(own.centred(x))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], [key, "deviation", "whitened"])

    return grid(embeddings, vector, model.scale, model.offset, [key]).where(F.size("x") == d).mapInArrow(run, f"{key} {kind}, deviation long, whitened array<double>")


def long_form(whitened: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """One row for each row and component: key, component from 1, n, deviation, whitened, explained, identity_error."""
    explained = F.array(*[F.lit(v) for v in (model.explained if model else [])]).cast("array<double>")
    each = whitened.select(key, "deviation", F.posexplode("whitened").alias("_p", "whitened"))
    n, error = (model.n, model.identity_error) if model else (None, None)
    return each.select(key, (F.col("_p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_p")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
