"""Embedding whitening: leading principal components by a block Jacobi-Davidson method.

The covariance is never formed. A product with it is a Spark job over blocks of distinct vectors: each
task centres its vectors and multiplies twice; its small partial result is summed in a fixed order. The
driver holds only the search space, some dozens of vectors of the embeddings' dimension: Rayleigh-Ritz
gives Ritz pairs, the leading ones that reach double precision are locked and projected out, the
others' correction equations are solved in part by MINRES, all at once, so that an inner step is one job
for all of them. Sums of the whole numbers and their squares are exact.

Every stage of it reads a written table, so lost executors cost one product's tasks at most.

Defined results: vectors null, empty or holding null or non-finite components take no part, nor do
those of another length than the most frequent (of ties the larger); rows without vec_id are kept;
repeated rows are one vector of the fit and have rows of their own; components whose variance is nothing but rounding
have no rows, so a table of one distinct vector, as an empty one, gives none; a deviation beyond 64 bits is null;
components beyond 64-bit integers after scaling saturate; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, scope, table, written

COMPONENTS, SCALE = 4, 256
#: Vectors of a block, rows that partial sums are folded into before the driver adds them.
BLOCK, FOLDS = 2048, 32
#: Vectors of the first search space, of the largest one, and of one restarted; steps of MINRES; rounds.
START, MOST, KEPT, INNER, ROUNDS = 16, 48, 16, 4, 150
EPS = float(np.finfo(np.float64).eps)


def usable(vector: str = "embedding") -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector).cast("array<double>"), finite)


def whole_rows(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows of the most frequent length, and that length (0 if there are none)."""
    rows = df.where(usable(vector)).select("vec_id", F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale)).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    return rows.where(F.size("x") == d), d


def blocks_of(rows: DataFrame, d: int) -> DataFrame:
    """(block, x): the distinct vectors, BLOCK of them as one matrix of 64-bit whole numbers."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [np.concatenate(batch["x"].to_numpy()).astype("<i8").tobytes()]})

    with arrow_rows(rows.sparkSession, BLOCK):
        packed = rows.select("x").distinct().mapInPandas(work, "x binary")
        return written(packed.select(F.monotonically_increasing_id().alias("block"), "x"), "blocks")


@dataclass
class Fit:
    """What is known of the distinct vectors: how many, sums by dimension, the covariance's trace."""

    blocks: DataFrame
    n: int
    d: int
    sums: list[int]
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / max(self.n, 1) for s in self.sums])


def fit_of(rows: DataFrame, d: int) -> Fit:
    blocks = blocks_of(rows, d)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, [0] * d, [0] * d
        for batch in batches:
            for x in batch["x"]:
                x = np.frombuffer(x, dtype="<i8").reshape(-1, d)
                high = int(np.abs(x.astype(float)).max()) + 1
                x = x if high * high * len(x) < 2**62 else x.astype(object)
                n += len(x)
                s = [a + int(b) for a, b in zip(s, x.sum(axis=0), strict=True)]
                ss = [a + int(b) for a, b in zip(ss, (x * x).sum(axis=0), strict=True)]
        yield pd.DataFrame({"dim": range(d), "n": n, "s": [str(v) for v in s], "ss": [str(v) for v in ss]})

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("s", "ss")]
    found = blocks.mapInPandas(work, "dim int, n long, s string, ss string").groupBy("dim").agg(F.sum("n").alias("n"), *wide).orderBy("dim").collect()
    n = found[0]["n"] if found else 0
    sums, squares = [int(r["s"]) for r in found], [int(r["ss"]) for r in found]
    exact = sum(n * ss - s * s for s, ss in zip(sums, squares, strict=True))
    return Fit(blocks, n, d, sums, exact / (n * n) if n else 0.0)


def summed(fit: Fit, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(centred block) over all blocks, in an order that doesn't depend on the tasks' timing."""
    mean, d = fit.mean, fit.d

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, total = None, None
        for batch in batches:
            for block, x in zip(batch["block"], batch["x"], strict=True):
                value = part(np.frombuffer(x, dtype="<i8").reshape(-1, d) - mean)
                first, total = (block, value) if total is None else (first, total + value)
        if total is not None:
            yield pd.DataFrame({"first": [first], "value": [total.tobytes()]})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        return pd.DataFrame({"first": [group["first"].iloc[0]], "value": [np.sum([np.frombuffer(v) for v in group["value"]], axis=0).tobytes()]})

    parts = fit.blocks.mapInPandas(work, "first long, value binary")
    rows = parts.groupBy(F.pmod(F.xxhash64("first"), F.lit(FOLDS))).applyInPandas(fold, "first long, value binary").collect()
    shape = part(np.zeros((1, d))).shape
    return np.sum([np.frombuffer(r["value"]) for r in sorted(rows, key=lambda r: r["first"])], axis=0).reshape(shape)


def product(fit: Fit) -> Callable[[np.ndarray], np.ndarray]:
    """z to the covariance times z, for some vectors at once (d, k)."""
    return lambda z: summed(fit, lambda x: x.T @ (x @ z)) / fit.n


def columns_norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=0))


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Some steps of MINRES for each column of b by itself, started at nothing; apply takes all columns at once."""
    norm = columns_norm(b)
    t, w0, w1, v_old = (np.zeros_like(b) for _ in range(4))
    v, beta, eta = b / np.where(norm > 0, norm, 1), norm.copy(), norm.copy()
    gamma0 = gamma1 = np.ones_like(norm)
    sigma0 = sigma1 = np.zeros_like(norm)
    for _ in range(steps):
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        new = av - alpha * v - beta * v_old
        beta_new = columns_norm(new)
        delta = gamma1 * alpha - gamma0 * sigma1 * beta
        rho1 = np.sqrt(delta**2 + beta_new**2)
        live = rho1 > EPS * np.abs(norm)
        rho1 = np.where(live, rho1, 1)
        rho2, rho3 = sigma1 * alpha + gamma0 * gamma1 * beta, sigma0 * beta
        gamma0, gamma1, sigma0, sigma1 = gamma1, delta / rho1, sigma1, beta_new / rho1
        w0, w1 = w1, np.where(live, (v - rho3 * w0 - rho2 * w1) / rho1, 0)
        t = t + gamma1 * eta * w1
        eta = -sigma1 * eta
        v_old, v, beta = v, new / np.where(beta_new > 0, beta_new, 1), beta_new
        if not (np.abs(eta) > 1e-3 * norm).any():
            break
    return t


def orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The directions of t that are new beside the orthonormal columns of against, orthonormal themselves."""
    out = np.zeros((len(t), 0))
    for c in t.T:
        size = np.linalg.norm(c)
        if not size > 0:
            continue
        c = c / size
        for _ in range(3):
            for q in (against, out):
                c = c - q @ (q.T @ c)
            size = np.linalg.norm(c)
            if size < 1e-10:
                break
            c = c / size
        if size >= 1e-10:
            out = np.column_stack([out, c])
    return out


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (d, k) of the symmetric operator apply.

    A pair is locked when its residual is within some units of rounding of the largest eigenvalue.
    """
    v = orthonormal(np.random.default_rng(7).standard_normal((d, min(d, START))), np.zeros((d, 0)))
    v = orthonormal(apply(v), np.zeros((d, 0))) if d > START else v
    if v.shape[1] == 0:  # nothing varies
        v = np.eye(d, min(d, START))
    w = apply(v)
    locked, values, best = np.zeros((d, 0)), [], np.inf
    for _ in range(ROUNDS):
        h = v.T @ w
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        v, w = v @ s, w @ s  # Ritz vectors, and their products
        while v.shape[1] and locked.shape[1] < k:
            residual = w[:, :1] - theta[0] * v[:, :1]
            residual = residual - locked @ (locked.T @ residual)
            top = max(values + [theta[0]])
            if np.linalg.norm(residual) > 8 * EPS * np.sqrt(d) * max(top, 0) and locked.shape[1] + v.shape[1] < d:
                break
            locked, values = np.column_stack([locked, v[:, 0]]), values + [float(theta[0])]
            v, w, theta = v[:, 1:], w[:, 1:], theta[1:]
        left = k - locked.shape[1]
        if left <= 0:
            break
        if v.shape[1] > MOST:
            v, w, theta = v[:, :KEPT], w[:, :KEPT], theta[:KEPT]
        # corrections for the pairs still wanted, each with its own shift, orthogonal to all of these and the locked
        u, shift = v[:, :left], theta[:left]
        out = np.column_stack([locked, u])
        project = lambda x, q=out: x - q @ (q.T @ x)
        residual = project(w[:, :left] - shift * u)
        best = min(best, float(columns_norm(residual).max()))
        t = minres(lambda x, p=project, e=shift: p(apply(p(x)) - e * p(x)), -residual, INNER)
        new = orthonormal(np.column_stack([project(t), residual]), np.column_stack([locked, v]))[:, : 2 * left]
        if new.shape[1] == 0:
            new = orthonormal(np.random.default_rng(v.shape[1]).standard_normal((d, 1)), np.column_stack([locked, v]))
        v, w = np.column_stack([v, new]), np.column_stack([w, apply(new)])
    else:
        raise RuntimeError(f"jacobi_davidson: {locked.shape[1]} of {k} pairs after {ROUNDS} rounds, residual {best:g}")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


@dataclass
class Components:
    """Leading components of a fit: eigenvalues, falling, unit vectors (d, k), how far the whitened covariance is from the identity."""

    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float


def components_of(fit: Fit, k: int = COMPONENTS) -> Components:
    values, vectors = jacobi_davidson(product(fit), fit.d, min(k, fit.d)) if fit.n > 1 and fit.trace > 0 else (np.zeros(0), np.zeros((fit.d, 0)))
    real = values > fit.d * EPS * fit.trace * 4
    values, vectors = values[real], vectors[:, real]
    # either sign will do: the largest entry is positive
    vectors = vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    if not len(values):
        return Components(fit, values, vectors, 0.0)
    scaled = vectors / np.sqrt(values)
    moments = summed(fit, lambda x: np.vstack([(x @ scaled).T @ (x @ scaled), (x @ scaled).sum(axis=0)])) / fit.n
    covariance = moments[:-1] - np.outer(moments[-1], moments[-1])
    return Components(fit, values, vectors, float(np.abs(covariance - np.eye(len(values))).max()))


def whiten(rows: DataFrame, found: Components) -> DataFrame:
    """rows (vec_id, x) to a row for each component."""
    fit, values = found.fit, found.values
    n, sums, mean, error = fit.n, np.array(fit.sums, dtype=object), fit.mean, found.identity_error
    scaled, explained = found.vectors / np.sqrt(values), values / fit.trace
    k, high = len(values), max((abs(s) for s in fit.sums), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * (int(np.abs(x.astype(float)).max()) + 1) + high
        if most * most * x.shape[1] < 2**63:
            return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy()).astype(np.int64)
            out = pd.DataFrame({"vec_id": batch["vec_id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))})
            deviation = pd.array(deviations(x), dtype="Int64")
            yield out.assign(n=n, deviation=deviation.repeat(k), whitened=((x - mean) @ scaled).ravel(), explained=np.tile(explained, len(x)), identity_error=error)

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with arrow_rows(rows.sparkSession, 10_000):
        return written(rows.mapInPandas(work, schema), "whitened", result=True)


def whitened(df: DataFrame, k: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    with scope(df.sparkSession):
        rows, d = whole_rows(df, vector)
        rows = written(rows, "vectors")
        return whiten(rows, components_of(fit_of(rows, max(d, 1)), k))


def op13_jacobi_davidson(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
