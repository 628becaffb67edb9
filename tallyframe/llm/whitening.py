"""Whitening of embeddings by shifted CholeskyQR.

The rows are integers (a fixed-point form of the vectors) and are centred exactly before anything is multiplied. Every
pass sums the Gram matrix of the rows, orthogonalised so far, over all tasks; the driver, which sees only
that matrix of dimension x dimension numbers, factorises it, and the next pass solves one triangle more in
front of each row. The first factor is shifted so that it exists for rows of any condition; further passes
remove the shift's effect. The product of the factors is the rows' R, and its singular vectors are the
components. Squared condition numbers never arise, as they would in an eigendecomposition of the covariance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, written

#: Entries become whole numbers of this scale. A constant added to them all changes no centred row, so none is.
SCALE = 64
#: Entries beyond this are taken as this.
LARGEST = float(1 << 52)
PASSES = 10
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fixed_point(df: DataFrame) -> DataFrame:
    """``vec_id`` and ``x array<bigint>``, the whole number below 64 times each entry, of rows whose vector is there and finite.

    Vectors of another length than most rows have (of equally frequent ones, the longer) are dropped, as are empty ones.
    """
    rows = columns(df, vec_id="bigint", embedding="array<double>")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(SCALE * c, F.lit(LARGEST)), F.lit(-LARGEST))))
    rows = rows.where(F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0)).select("vec_id", x.alias("x"))
    rows = written(rows, "whitening-rows")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == most.d) if most else rows


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of every dimension, as whole numbers of any size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                # Halves of 26 bits cannot overflow within a batch.
                own = (x >> 26).sum(0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(0).astype(object)
                n, total = n + len(x), own if total is None else total + own
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]])], ["n", "s"])
    parts = rows.select("x").mapInArrow(run, "n long, s array<string>")
    sums = (parts.select("n", F.posexplode("s").alias("i", "s")).groupBy("i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect())
    return (sums[0].n if sums else 0), [int(r.s) for r in sums]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """Rows minus the mean, and the exact sum of the squares of ``n * x - sums`` (null beyond 64 bits)."""
    largest = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if largest ** 2 * x.shape[1] < 2.0 ** 62:
        d = n * x - np.array(sums, np.int64)
        return d / n, (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    squares = (d * d).sum(1).tolist()
    return (d / n).astype(np.float64), [s if s < 1 << 63 else None for s in squares]


def gram(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of the outer product of ``of(row)`` with itself. One upper triangle leaves each task."""
    at = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                y = of(matrix(batch.slice(k, 4096)))
                total += y.T @ y
        yield pa.record_batch([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["i", "j", "v"])
    out = np.zeros((size, size))
    for r in rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``y`` times the inverses of upper triangles, one after another, by substitution."""
    for r in factors:
        q = np.empty_like(y)
        for j in range(y.shape[1]):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


def triangle(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted if asked for or if it has none of its own."""
    d = len(g)
    if not shift:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    share = min(11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2, 1e-8)
    return np.linalg.cholesky(g + share * np.linalg.norm(g, 2) * np.eye(d)).T


def r_factor(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray | None:
    """R of the centred rows; none if all rows are equal."""
    factors: list[np.ndarray] = []
    for _ in range(PASSES):
        g = gram(rows, lambda x: solved(centred(x, n, sums)[0], factors), len(sums))
        if not factors and not g.any():
            return None
        live = np.diag(g) > 0  # a dimension without variance stays zero
        if factors and np.abs((g - np.eye(len(g)))[np.ix_(live, live)]).max(initial=0) < 1e-12:
            break
        factors.append(triangle(g, n, not factors))
    r = np.eye(len(sums))
    for f in factors:
        r = f @ r
    return r


def components(rows: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit components as columns, eigenvalues falling, their shares of the total variance), of
    directions that have variance. Each component's largest entry is positive."""
    d = len(sums)
    r = r_factor(rows, n, sums) if n else None
    if r is None:
        return np.zeros((d, 0)), np.zeros(0), np.zeros(0)
    _, s, vt = np.linalg.svd(r)
    keep = s > s[0] * d * 1e-13
    v = vt[keep].T
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v, s[keep] ** 2 / n, s[keep] ** 2 / (s ** 2).sum()


def whiten(df: DataFrame, top: int = 32) -> DataFrame:
    """Rows (vec_id, component) with the whitened coordinate of up to ``top`` components, numbered from 1.

    Vectors that are null or hold null or non-finite entries are dropped; repeated rows and null ids stay. No rows, or rows
    all alike, give the empty table; dimensions without variance give fewer components. ``deviation`` is null where it does not fit
    into 64 bits. ``identity_error`` is measured on the whitened rows themselves, in one more pass.
    """
    rows = fixed_point(df)
    n, sums = exact_sums(rows)
    v, e, share = components(rows, n, sums)
    v, e, share = v[:, :top], e[:top], share[:top]
    k = len(e)
    if k == 0:
        return df.sparkSession.createDataFrame([], OUT)
    to = v / np.sqrt(e)
    g = gram(rows, lambda x: np.column_stack([centred(x, n, sums)[0] @ to, np.ones(len(x))]), k + 1)
    mean = g[:k, k] / n
    error = float(np.abs(g[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                y, deviation = centred(matrix(batch), n, sums)
                m = batch.num_rows
                yield pa.record_batch([
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array((y @ to).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, OUT)
