"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X (n rows, d columns) stay where they are. A step takes a direction v on the
driver and makes, in one pass of Spark over the rows, u = Xv less what earlier steps hold of it,
and w = Xᵀu; only d + k sums come back. v is made orthogonal to all earlier v (driver, d numbers
each) and u to all earlier u. Earlier u are not stored: with V the directions so far and R the
triangle of their coefficients XV = UR, so a task works its rows' part of U out of XV by the
same subtractions that made it, and the reorthogonalisation of u asks for no pass of its own.
R is bidiagonal but for the rounding that reorthogonalisation takes out. Its small SVD gives the
components and deviations: X = U R Vᵀ, so V times R's right singular vectors are eigenvectors of
XᵀX, whose eigenvalues are the squared singular values.

Where a step finds nothing left (a direction in the null space, or an invariant space) it goes
on with a new direction, so equal eigenvalues all come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written

#: Up to so many dimensions all steps are taken; beyond, as many as the asked components need to converge.
ALL_STEPS = 512
#: A residual of this share of the largest singular value is none.
TOLERANCE = 1e-13
#: An eigenvalue below this share of the trace is none: its component would be noise.
LEAST_SHARE = 1e-13
#: Rows of a task that are worked on at a time.
BLOCK = 4096
#: Sums of a pass that come to the driver.
MOST_PARTS = 1000


@dataclass(frozen=True)
class Whitening:
    """A fit over n distinct vectors: base + offset / n is their mean, with base and offset integers."""

    n: int
    base: np.ndarray
    offset: np.ndarray
    #: A component a column, by falling eigenvalue.
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int


def steps_of(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry c of a vector, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift)


def sound(vector: Column) -> Column:
    """Whether a vector has entries, and all are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as an int64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column("x"))


def centred(x: np.ndarray, n: int, base: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """x less the mean: n * x - S is an integer, so each entry is rounded once."""
    return (n * (x - base) - offset).astype(np.float64) / n


def _sums(df: DataFrame, work: Callable[[np.ndarray], np.ndarray], size: int, whole: bool = False) -> np.ndarray:
    """work(matrix of a block), size numbers, summed over all blocks: in the tasks first, then by at most MOST_PARTS tasks, then here. whole: of integers, exactly."""
    kind, listed = (np.int64, pa.list_(pa.int64())) if whole else (np.float64, pa.list_(pa.float64()))
    schema = f"sums array<{'long' if whole else 'double'}>"
    out = lambda total: pa.RecordBatch.from_arrays([pa.array([total.tolist()], listed)], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for _, x in _blocks(batches):
            total += work(x)
        yield out(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            total += batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).sum(axis=0)
        yield out(total)

    parts = df.select("x").mapInArrow(add, schema)
    if df.rdd.getNumPartitions() > MOST_PARTS:
        parts = parts.repartition(MOST_PARTS).mapInArrow(again, schema)
    total = np.zeros(size, object if whole else kind)
    for row in parts.collect():
        total += np.array(row.sums, object if whole else kind)
    return total


def _basis(x: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows' part of U in XV = UR: by forward substitution, as the steps made it."""
    u = x @ v
    for k in range(u.shape[1]):
        u[:, k] = (u[:, k] - u[:, :k] @ r[:k, k]) / r[k, k] if r[k, k] else 0.0
    return u


def bidiagonalise(df: DataFrame, n: int, base: np.ndarray, offset: np.ndarray, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(V, R) with XV = UR for the centred rows of df (a column x of longs): all d directions, or as many as the wanted singular vectors need."""
    d, rng = len(base), np.random.default_rng(seed)
    v, r, xtu = np.zeros((d, 0)), np.zeros((0, 0)), np.zeros((d, 0))
    follow, scale = rng.standard_normal(d), 0.0
    while v.shape[1] < d:
        k = v.shape[1]
        direction = _orthogonal(follow, v)
        if np.linalg.norm(direction) <= TOLERANCE * scale:  # nothing left on this way
            direction = _orthogonal(rng.standard_normal(d), v)
        direction = _orthogonal(direction / np.linalg.norm(direction), v)
        direction /= np.linalg.norm(direction)

        def products(x: np.ndarray, held: np.ndarray, v=v, r=r, direction=direction) -> np.ndarray:
            """Of u = Xv less U held: its square, Uᵀu and Xᵀu."""
            c = centred(x, n, base, offset)
            old = _basis(c, v, r)
            u = c @ direction - old @ held
            return np.concatenate([[u @ u], old.T @ u, c.T @ u])

        held, left = np.zeros(k), 0.0
        for _ in range(3):
            sums = _sums(df, lambda x: products(x, held), 1 + k + d)  # noqa: B023
            more = sums[1 : 1 + k]
            scale = max(scale, np.sqrt(sums[0]))
            held, left = held + more, sums[0] - more @ more
            # if u was mostly in U, what is left is the difference of large numbers: once more from what is left
            if left >= 0.1 * sums[0] or sums[0] <= (TOLERANCE * scale) ** 2:
                break
        alpha = np.sqrt(max(left, 0.0)) if sums[0] > (TOLERANCE * scale) ** 2 else 0.0
        v, r = np.column_stack([v, direction]), np.block([[r, held[:, None]], [np.zeros((1, k)), np.array([[alpha]])]])
        xtu = np.column_stack([xtu, (sums[1 + k :] - xtu @ more) / alpha if alpha else np.zeros(d)])
        follow = xtu[:, k] - alpha * direction
        if d > ALL_STEPS and k + 1 >= wanted:
            beta = np.linalg.norm(_orthogonal(follow, v))
            if (beta * np.abs(np.linalg.svd(r)[0][-1, :wanted]) <= TOLERANCE * scale).all():
                break
    return v, r


def _orthogonal(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """w less its part in the columns of v; twice, as once leaves some."""
    for _ in range(2):
        w = w - v @ (v.T @ w)
    return w


def fit(distinct: DataFrame, wanted: int = 16) -> Whitening | None:
    """The whitening of a table of distinct vectors (a column x: arrays of longs of one length), which is read once a step; None of an empty one.

    Vectors of different lengths are an error. Covariances have divisor n.
    """
    known = distinct.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    least, d, n, low, high = known
    if not n:
        return None
    if least != d:
        raise ValueError(f"vectors of {least} and of {d} entries")
    if (high - low) * n >= 2**62:
        raise OverflowError("n * x - S is beyond a long")
    total = _sums(distinct, lambda x: (x - low).sum(axis=0), d, whole=True)
    base = np.array([low + int(s) // n for s in total], dtype=np.int64)
    offset = np.array([int(s) % n for s in total], dtype=np.int64)
    v, r = bidiagonalise(distinct, n, base, offset, min(wanted, d))
    _, sigma, right = np.linalg.svd(r)
    e = sigma**2 / n
    trace = float(_sums(distinct, lambda x: np.array([np.square(centred(x, n, base, offset)).sum()]), 1)[0]) / n
    keep = np.flatnonzero(e[:wanted] > LEAST_SHARE * trace)
    components = (v @ right.T)[:, keep]
    return Whitening(n, base, offset, components / np.linalg.norm(components, axis=0), e[keep], trace, v.shape[1])


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened distinct vectors' covariance less the identity: a pass over the rows."""
    m = fitted.components.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, fitted.n, fitted.base, fitted.offset) @ (fitted.components / np.sqrt(fitted.eigenvalues))
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    if not m:
        return 0.0
    sums = _sums(distinct, moments, m + m * m)
    mean = sums[:m] / fitted.n
    return float(np.abs(sums[m:].reshape(m, m) / fitted.n - np.outer(mean, mean) - np.eye(m)).max())


def whitened(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """key, component (from 1), deviation and whitened of each row of vectors (key, x) and each component.

    deviation is the sum of (n * x - S)² over the dimensions, exact; one beyond a long is an error.
    """
    n, base, offset, turn = fitted.n, fitted.base, fitted.offset, fitted.components / np.sqrt(fitted.eigenvalues)
    m = turn.shape[1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            off = n * (x - base) - offset
            if np.square(off.astype(np.float64)).sum(axis=1).max(initial=0) >= 2.0**62:
                raise OverflowError("a deviation is beyond a long")
            w = (off.astype(np.float64) / n) @ turn
            keys = part.column("key").take(pa.array(np.repeat(np.arange(len(x)), m)))
            columns = [keys, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.repeat(np.square(off).sum(axis=1), m)), pa.array(w.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "deviation", "whitened"])

    return vectors.select("key", "x").mapInArrow(put, f"key {vectors.schema['key'].dataType.simpleString()}, component int, deviation long, whitened double")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, wanted: int = 16) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for each row with a sound vector and each component.

    Entries c become floor(scale * c) + shift; the fit takes each distinct vector once, and every
    row is whitened. Rows whose vector is null, empty or has an entry that is null or not finite
    are left out; rows that are repeated come as often as they are there, null keys with a null.
    Vectors of different lengths are an error. There are as many components as have a variance
    over 1e-13 of the trace, at most ``wanted``: of one distinct vector none. Where eigenvalues
    are equal, any directions of their space may come. An empty table gives no rows. Other columns
    of df are not looked at.
    """
    vectors = df.where(sound(F.col(vector))).select(F.col(key).alias("key"), steps_of(F.col(vector), scale, shift).alias("x"))
    distinct = written(vectors.select("x").distinct())
    fitted = fit(distinct, wanted)
    if fitted is None or not fitted.components.size:
        kind = vectors.schema["key"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(distinct, fitted)
    share = F.element_at(F.array(*[F.lit(float(x / fitted.trace)) for x in fitted.eigenvalues]), F.col("component"))
    return whitened(vectors, fitted).select(F.col("key").alias(key), "component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
