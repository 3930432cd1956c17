"""Whitening of embeddings by eigenvectors that are refined in higher precision.

Entries become whole numbers, x = floor(1024 * c) + 100000. Three passes over the vectors, each of which
sends one small row of sums a batch of rows, added up by position:

1. the sums S and the count n;
2. the products of x less its mean. The mean's nearest whole number is taken off before multiplying, so
   products are small whole numbers and their sums exact, however the rows are dealt out; what that number
   leaves of the mean is taken off exactly afterwards: n^2 V = n * sum(y y') - (sum y)(sum y)';
3. the covariance of what was whitened, for the identity error.

V is as large as the dimension squared, whatever the rows, and its eigenvectors are found on the driver:
single-precision ones first, then Ogita-Aishima steps, which are matrix products in extended precision
(numpy's longdouble): with R = I - X'X and T = X'VX, the eigenvalues are T_ii / (1 - R_ii) and X grows by X E,
E_ij = (T_ij + l_j R_ij) / (l_j - l_i). Where two eigenvalues are closer than the error that T and R show, that
quotient means nothing, and E_ij = R_ij / 2 only makes them orthogonal; such clusters are solved by
themselves: V less the cluster's mean eigenvalue, projected on their columns, gives a small problem whose
double-precision eigenvectors turn the columns. Errors square at each step, so four or five suffice.

Defined cases: rows whose vector is null, empty, or holds null, NaN or infinite entries are dropped, and so
are vectors of another length than most have (ties: the longer). Entries beyond 2^40 / 1024 count as that.
Repeated rows each count and are returned; a null vec_id is kept; an empty table gives an empty result;
further columns are not read. A vector shorter than ``components`` gives as many rows as it has entries. A
component without variance (e at most 1e-14 of the trace) has whitened 0, so its identity error is 1; with
no variance at all explained is 0. A deviation beyond a long is null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SCALE, SHIFT, LARGEST = 1024.0, 100_000, 1 << 40
EXACT = 1 << 20  # products of numbers up to this, 4,096 at a time, are exact in doubles
ROWS = 4096
COMPONENTS, STEPS, NO_VARIANCE = 8, 12, 1e-14


def whole_numbers(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, x array<long> of the vectors that count."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size(c) > 0)
    near = F.transform(c, lambda e: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), e * SCALE))) + SHIFT)
    rows = df.select(F.col(key), F.when(sound, near).alias("x")).filter("x is not null")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == sizes[0]) if sizes else rows


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _parts(m: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(m), ROWS):
        yield m[at : at + ROWS]


def products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers, exact."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for part in _parts(y):
        high = part >> 20
        low = (part - (high << 20)).astype(np.float64)
        whole = lambda m: m.astype(np.int64).astype(object)
        if np.abs(part).max() <= EXACT:
            y64 = part.astype(np.float64)
            total += whole(y64.T @ y64)
        else:
            high = high.astype(np.float64)
            mixed = whole(high.T @ low)
            total += whole(high.T @ high) * (1 << 40) + (mixed + mixed.T) * (1 << 20) + whole(low.T @ low)
    return total


def _summed(rows: DataFrame, of_batch) -> list[int]:
    """Sums by position of the whole numbers that ``of_batch`` makes of each batch's matrix. As many
    results as it makes, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = of_batch(matrix(batch.column(0)))
                total = made if total is None else [a + b for a, b in zip(total, made)]
        if total is not None:
            from decimal import Context, Decimal

            exact = Context(prec=60)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([exact.create_decimal(Decimal(int(v))) for v in total], pa.decimal128(38, 0))], names=["at", "v"])

    found = rows.select("x").mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    return [int(r[1]) for r in found]


def covariance(n: int, sums: list[int], gram: list[int]) -> np.ndarray:
    """From the sums and products of whole numbers: the covariance, each entry rounded once."""
    d = len(sums)
    out = np.zeros((d, d), np.longdouble)
    for i in range(d):
        for j in range(i, d):
            top = n * gram[i * d + j] - sums[i] * sums[j]
            whole, rest = divmod(top, n * n)
            out[i, j] = out[j, i] = np.longdouble(whole) + np.longdouble(rest) / np.longdouble(n * n)
    return out


def sub_solve(v: np.ndarray, x: np.ndarray, clusters: list[np.ndarray]) -> np.ndarray:
    """Turn the columns of each cluster to the eigenvectors of V projected on them."""
    x = x.copy()
    for c in clusters:
        part = x[:, c]
        # Orthonormal first, as the small problem assumes.
        part = part @ (1.5 * np.eye(len(c), dtype=x.dtype) - 0.5 * (part.T @ part))
        inner = part.T @ (v @ part)
        mean = np.trace(inner) / len(c)
        spread = inner - mean * np.eye(len(c), dtype=x.dtype)
        size = np.abs(spread).max()
        if size > 0:
            _, turn = np.linalg.eigh(((spread + spread.T) / (2 * size)).astype(np.float64))
            part = part @ turn.astype(x.dtype)
        x[:, c] = part
    return x


def eigenvectors(v: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix, to double precision: from
    single-precision ones by Ogita-Aishima steps in the precision of ``v``."""
    d = len(v)
    norm = np.abs(v).max()
    if d == 0 or norm == 0:
        return np.zeros(d), np.eye(d)
    a = v / norm
    _, x = np.linalg.eigh(a.astype(np.float32))
    x, eye = x.astype(v.dtype), np.eye(d, dtype=v.dtype)
    least = 1e4 * d * float(np.finfo(v.dtype).eps)  # what rounding alone can make of a gap
    for _ in range(steps):
        r = eye - x.T @ x
        t = x.T @ (a @ x)
        r, t = (r + r.T) / 2, (t + t.T) / 2  # rounding must not tell i, j from j, i: E would not be a turn
        values = np.diag(t) / (1 - np.diag(r))
        off = t - np.diag(values)
        error = 2 * (np.linalg.norm(off.astype(np.float64), 2) + np.linalg.norm(r.astype(np.float64), 2) * float(np.abs(values).max()))
        error = max(error, least)
        apart = values[None, :] - values[:, None]
        close = np.abs(apart) <= error
        e = np.where(close, r / 2, (t + values[None, :] * r) / np.where(close, 1, apart))
        x = x + x @ e
        order = np.argsort(values)
        near = np.flatnonzero(np.diff(values[order]) <= error)
        runs = np.split(near, np.flatnonzero(np.diff(near) > 1) + 1) if len(near) else []
        x = sub_solve(a, x, [order[run[0] : run[-1] + 2] for run in runs])
        if float(np.abs(e).max()) < 1e-17:
            break
    t = x.T @ (a @ x)
    values = np.diag(t) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * norm).astype(np.float64), x.astype(np.float64)


OUT = "component int, n long, deviation long, whitened double, explained double"


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error: a row for each vector that
    counts and each of the first components."""
    rows = whole_numbers(df, key, vector)
    head = _summed(rows, lambda m: [len(m), *m.astype(object).sum(axis=0)])
    kind = df.schema[key].dataType.simpleString()
    if not head:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, {OUT}, identity_error double")
    n, totals = head[0], head[1:]
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    rest = [s - n * int(c) for s, c in zip(totals, centre)]  # n times what the whole number leaves of the mean
    v = covariance(n, rest, _summed(rows, lambda m: list(products(m - centre).ravel())))
    values, vectors = eigenvectors(v)
    some = min(components, len(values))
    trace = float(np.trace(v))
    sound = [trace > 0 and values[k] > NO_VARIANCE * trace for k in range(some)]
    onto = np.stack([vectors[:, k] / np.sqrt(values[k]) if sound[k] else np.zeros(len(values)) for k in range(some)], axis=1)
    left = np.array([r / n for r in rest])
    explained = [float(values[k] / trace) if trace > 0 else 0.0 for k in range(some)]

    def project(m: np.ndarray) -> np.ndarray:
        return ((m - centre).astype(np.float64) - left) @ onto

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((some + 1, some))
        for batch in batches:
            if batch.num_rows:
                w = project(matrix(batch.column(0)))
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    found = rows.select("x").mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    total = np.array([r[1] for r in found]).reshape(some + 1, some) / n
    # The projections are of centred rows, so their means are next to nothing.
    identity_error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(some)).max())

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column(1))
            w = project(m)
            far = n * int(np.abs(m - centre).max()) + n
            if far * far * m.shape[1] < 1 << 62:
                deviation = pa.array(((n * (m - centre) - np.array(rest, np.int64)) ** 2).sum(axis=1))
            else:
                exact = [sum((n * (int(e) - int(c)) - r) ** 2 for e, c, r in zip(row, centre, rest)) for row in m]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            size = len(m)
            take = pa.array(np.repeat(np.arange(size), some))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), size)), pa.array(np.full(size * some, n, np.int64)), deviation.take(take),
                pa.array(w.ravel()), pa.array(np.tile(explained, size)),
            ], names=["key", *[x.split()[0] for x in OUT.split(", ")]])

    out = rows.select(key, "x").mapInArrow(whitened, f"key {kind}, {OUT}")
    return out.withColumnRenamed("key", key).withColumn("identity_error", F.lit(identity_error))


def op13_mixed_precision(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
