"""Whitening of vectors: an exact distributed covariance, and eigenvectors in mixed precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bound_batches
from .vectors import fit_vectors, whole

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: An eigenvalue of less than this share of their sum is none.
LEAST = 1e-13
_HALF = 32


def _lanes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as high * 2^32 + low, so that sums of many never overflow."""
    return x >> _HALF, x & ((1 << _HALF) - 1)


def _add_up(rows: DataFrame, parts: DataFrame) -> dict[int, list[int]]:
    """Sums over all tasks of rows (i, high, low), which hold whole numbers as blocks of bytes;
    they are added in Spark, one i after the other."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                mine = [np.frombuffer(r[c], np.int64) for c in ("high", "low")]
                carry = [x + y for x, y in zip(total[r["i"]], mine)] if r["i"] in total else mine
                total[r["i"]] = [carry[0] + (carry[1] >> _HALF), carry[1] & ((1 << _HALF) - 1)]
        yield pa.record_batch([pa.array(list(total), pa.int32()), *(pa.array([v[k].tobytes() for v in total.values()], pa.binary()) for k in (0, 1))], ["i", "high", "low"])

    found = parts.repartition("i").mapInArrow(add, "i int, high binary, low binary").collect()  # a row for each dimension
    return {r.i: [(int(a) << _HALF) + int(b) for a, b in zip(np.frombuffer(r.high, np.int64), np.frombuffer(r.low, np.int64))] for r in found}


def _parts(rows: DataFrame, d: int, each) -> DataFrame:
    """each(vectors) gives a d-column block of whole numbers of a batch; their sums of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        for batch in batches:
            for at in range(0, len(batch), 4096):
                block = each(whole(batch.column("vector").slice(at, 4096), d, SCALE).astype(np.int64))
                h, x = _lanes(block) if block.dtype != object else ((block // (1 << _HALF)).astype(np.int64), (block % (1 << _HALF)).astype(np.int64))
                high, low = (h, x) if high is None else (high + h, low + x)
        if high is not None:
            yield pa.record_batch([pa.array(np.arange(len(high)), pa.int32()), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (high, low))], ["i", "high", "low"])

    return rows.select("vector").mapInArrow(run, "i int, high binary, low binary")


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension of floor(SCALE * c)."""
    found = _add_up(rows, _parts(rows, d, lambda y: np.concatenate([y.sum(0), [len(y)]])[None]))[0]
    return found[d], found[:d]


def _gram(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers. Products of doubles are exact while sums stay below 2^53."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(1, len(y)) < 1 << 53:
        x = y.astype(np.float64)
        return (x.T @ x).astype(np.int64)
    x = y.astype(object)
    return x.T @ x


def covariance(rows: DataFrame, d: int, n: int, s: list[int]) -> tuple[np.ndarray, int]:
    """n^2 times the covariance (divisor n) as Python's whole numbers, exactly, and n.

    Vectors are centred at the whole number next to the mean before they are multiplied; what is
    left of the mean is taken off exactly. A task sends d rows of sums."""
    centre = np.array([(2 * x + n) // (2 * n) for x in s], np.int64)
    products = _add_up(rows, _parts(rows, d, lambda y: _gram(y - centre)))
    left = np.array([x - n * int(c) for x, c in zip(s, centre)], object)
    return n * np.array([products[i] for i in range(d)], object) - np.outer(left, left), n


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the symmetric matrix a, from approximate eigenvectors x.

    Ogita and Aishima's iteration in the precision of `a`, matrix products only: R = I - X'X says
    how far X is from orthogonal, S = X'AX how far from eigenvectors; X becomes X + XE, where
    E_ij = (S_ij + l_j R_ij) / (l_j - l_i), and R_ij / 2 where the eigenvalues are too close to
    be told apart, for which X only becomes orthogonal. Such a cluster of eigenvectors spans its
    space well but is turned within it: the eigenvectors of its own small S, shifted by the
    cluster's mean and scaled so that its gaps are no longer small, turn it back."""
    n, eye = len(a), np.eye(len(a), dtype=a.dtype)
    scale = np.abs(a).sum(1).max()
    eps = np.finfo(a.dtype).eps
    least, best = np.inf, x
    for _ in range(rounds if n and scale else 0):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        lam = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(lam)
        wrong = max(np.abs(r).max(), np.abs(off).max() / scale)
        if wrong < least:
            least, best = wrong, x
        if wrong <= 4 * eps:
            break
        delta = 2 * (np.sqrt((off**2).sum()) + scale * np.sqrt((r**2).sum()))
        gap = lam[None, :] - lam[:, None]
        near = np.abs(gap) <= delta
        e = np.where(near, r / 2, (s + lam[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        order = np.argsort(-lam)
        x, lam = x[:, order], lam[order]
        for lo, hi in _clusters(lam, delta):
            part = x[:, lo:hi]
            small = part.T @ (a @ part)
            small = small - np.eye(hi - lo, dtype=a.dtype) * (np.trace(small) / (hi - lo))
            size = np.abs(small).max()
            if size > n * eps * scale:
                _, turn = np.linalg.eigh((small / size).astype(np.float64))
                turn = turn[:, ::-1].astype(a.dtype)
                turn = turn + turn @ (np.eye(hi - lo, dtype=a.dtype) - turn.T @ turn) / 2  # orthogonal in a's precision
                x[:, lo:hi] = part @ turn
    x = best + best @ (eye - best.T @ best) / 2
    r = eye - x.T @ x
    lam = np.diag(x.T @ (a @ x)) / (1 - np.diag(r)) if n else np.zeros(0, a.dtype)
    order = np.argsort(-lam, kind="stable")
    x = x[:, order]
    return lam[order], x / np.sqrt((x * x).sum(0))


def _clusters(lam: np.ndarray, delta: float) -> list[tuple[int, int]]:
    """Runs of falling eigenvalues with gaps of at most delta."""
    cut = np.concatenate(([0], np.flatnonzero(lam[:-1] - lam[1:] > delta) + 1, [len(lam)]))
    return [(int(a), int(b)) for a, b in zip(cut, cut[1:]) if b - a > 1]


def eigen(scaled: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of scaled / n^2, to double precision:
    float32's eigenvectors, refined in the longest floating point number of this machine."""
    wide = np.longdouble
    high = lambda v: wide(float(v)) + wide(float(v - int(float(v))))
    a = np.array([[high(v) for v in row] for row in scaled], wide).reshape(scaled.shape) / (wide(n) * wide(n))
    top = np.abs(a).max(initial=0) or wide(1)
    _, x = np.linalg.eigh((a / top).astype(np.float32))
    lam, x = refine(a / top, x[:, ::-1].astype(wide))
    return np.maximum(lam * top, 0).astype(np.float64), x.astype(np.float64)


def whitened(rows: DataFrame, vector: str = "vector", components: int = COMPONENTS) -> DataFrame:
    """Project vectors on the principal components of their covariance, each of variance 1.

    An entry c counts as x = floor(SCALE * c) + SHIFT. Returns the columns of `rows` but the vector,
    with n (vectors in the fit), deviation (sum over dimensions of (n x - S)^2, exact),
    component (from 1, by falling eigenvalue), whitened, explained (share of the variance) and
    identity_error (largest entry of the whitened rows' covariance minus the identity, measured).

    Rows whose vector fit_vectors leaves out (null, empty, a null or not finite entry, another
    length than most) give no row. A component without variance (all of them, if all vectors are
    equal) has whitened null and takes no part in identity_error. Repeated rows count each; an
    empty table gives an empty one; other columns of any name but the new ones' are handed on. A
    deviation that doesn't fit a long is an error. Three passes over the vectors; the driver holds
    matrices of the vectors' length only."""
    bound_batches(rows.sparkSession, "2m")
    kept = [c for c in rows.columns if c != vector]
    rows, d = fit_vectors(rows.select(*kept, F.col(vector).alias("vector")), "vector")
    n, s = sums(rows, d) if d else (0, [])
    lam, x = eigen(*covariance(rows, d, n, s)) if n else (np.zeros(0), np.zeros((0, 0)))
    trace = float(lam.sum())
    m = min(components, d)
    there = lam[:m] > LEAST * trace
    turn = np.where(there, x[:, :m] / np.sqrt(np.where(there, lam[:m], 1)), 0)
    centre = np.array([v // n for v in s], np.int64)
    left = np.array([(v - n * int(c)) / n for v, c in zip(s, centre)])
    rest = np.array([v - n * int(c) for v, c in zip(s, centre)], object)

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        y = whole(column, d, SCALE).astype(np.int64) - centre
        return y, (y - left) @ turn

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m + 1))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                _, w = project(batch.column("vector").slice(at, 4096))
                w = np.column_stack([w, np.ones(len(w))])
                total += w.T @ w
        yield pa.record_batch([pa.array(np.arange((m + 1) ** 2), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    error = 0.0
    if m and there.any():
        moments = rows.select("vector").mapInArrow(outer, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # (m + 1)^2 rows
        total = np.zeros((m + 1) ** 2)
        for r in moments:
            total[r.i] = r.v
        total = total.reshape(m + 1, m + 1)[np.ix_([*np.flatnonzero(there), m], [*np.flatnonzero(there), m])] / n
        error = float(np.abs(total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1]) - np.eye(int(there.sum()))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                y, w = project(part.column("vector"))
                top = n * int(np.abs(y).max(initial=0)) + n
                far = y * n - rest.astype(np.int64) if top * top * d < 1 << 63 else y.astype(object) * n - rest
                far = (far * far).sum(1)
                w = pa.array(w.ravel(), mask=np.tile(~there, len(part)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * m, pa.int32()), w)
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array([int(v) for v in far], pa.int64()), lists], [*kept, "deviation", "_whitened"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("deviation", T.LongType()), T.StructField("_whitened", T.ArrayType(T.DoubleType()))])
    explained = F.array(*[F.lit(float(v)) for v in lam[:m] / (trace or 1.0)]).cast("array<double>")
    out = rows.select(*kept, "vector").mapInArrow(run, schema).select(*kept, F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("_whitened").alias("_at", "whitened"))
    value: Column = F.get(explained, F.col("_at"))
    return out.select(*kept, "n", "deviation", (F.col("_at") + 1).alias("component"), "whitened", value.alias("explained"), F.lit(error).alias("identity_error"))
