"""Whitening of embeddings by a matrix-free Jacobi-Davidson solver.

An entry c becomes the whole number x = floor(1024 c) + 100000.  The leading components of the covariance V of x are
found without forming V: every product of V with a few directions is one pass over the vectors, in which each task
centres its rows (exactly, from the integer sums) before it multiplies them, and Spark adds the partial products up.

The solver works on a small subspace at the driver (dimension x ``basis`` numbers, whatever the number of vectors):

* Rayleigh-Ritz on the subspace gives approximate pairs and their residuals;
* each leading pair that isn't settled gets a correction from Jacobi-Davidson's projected equation
  (I - UU')(V - theta I)(I - UU') t = -r, solved by a few MINRES steps; the equations of all pairs run side by side,
  so one pass serves a step of each;
* a pair whose residual reaches double precision (``TOL`` times the largest eigenvalue) is locked, and all later work is
  orthogonal to it.  The end is when all wanted pairs are locked.

Defined cases: rows whose vector is null or holds a null or a non-finite entry are dropped; so are vectors of another
length than the most frequent one (of equally frequent lengths, the longer).  Rows that repeat count as often as they
occur, a null id stays null, other columns are ignored.  Components are only those of positive variance (over
``RANK_TOL`` times the largest), so fewer than asked come back where the vectors span less; no vectors, one vector and
equal vectors give no rows.  The order of equal eigenvalues, and the components within their space, are arbitrary.
An entry too large for a long, or a deviation too large for one, is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import written

COMPONENTS, GUARD, INNER, MAX_OUTER = 8, 2, 6, 60
#: Residuals relative to the largest eigenvalue; and variance that counts as none.
TOL, RANK_TOL = 2e-14, 1e-12
SCALE, SHIFT = 1024, 100_000
TASK_BYTES = 4 << 20


def finite(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the rows that stay, their entries as whole numbers; written, in tasks of bounded size."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.where(good).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return written(rows, "whitening-x")
    rows = rows.where(F.size("x") == lengths["d"])
    return written(rows.repartition(max(1, lengths["n"] * lengths["d"] * 8 // TASK_BYTES)), "whitening-x")


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centred:
    """The vectors of a written table (id, x), centred by their exact mean."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        entry = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
            F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = sorted(entry.collect())  # a row for each dimension
        self.d, self.n = len(found), found[0]["n"] if found else 0
        self.sums = [int(r["s"]) for r in found]
        self.floor = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.sums], dtype=np.float64)
        self.reach = max((max(r["hi"] - s // self.n, s // self.n - r["lo"]) + 1 for r, s in zip(found, self.sums)), default=0)

    def total(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all batches of ``f`` (centred rows) -> a fixed number of doubles: one pass."""
        d, floor, rest = self.d, self.floor, self.rest

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                if b.num_rows:
                    y = f((_matrix(b.column(0), d) - floor) - rest).ravel()
                    out = y if out is None else out + y
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["i", "y"])

        got = self.rows.select("x").mapInArrow(partial, "i int, y double").groupBy("i").agg(F.sum("y").alias("y")).collect()
        flat = np.zeros(len(got))
        for i, y in got:
            flat[i] = y
        return flat

    def product(self, u: np.ndarray) -> np.ndarray:
        """V u for the columns of ``u``, V being the covariance (divisor n)."""
        u = np.ascontiguousarray(u)
        return self.total(lambda c: c.T @ (c @ u)).reshape(u.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda c: np.array([np.einsum("ij,ij->", c, c)]))[0]) / self.n


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The columns of ``new`` made orthonormal to ``against`` and each other; dependent ones go."""
    kept = []
    for v in new.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(3):  # again, so that rounding leaves nothing
            v = v - against @ (against.T @ v)
            for k in kept:
                v = v - k * (k @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            kept.append(v)
    return np.column_stack(kept) if kept else np.zeros((len(new), 0))


def _minres(product: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, theta: np.ndarray, fixed: list[np.ndarray], steps: int) -> np.ndarray:
    """Approximate solutions of (I-UU')(V - theta I)(I-UU') t = rhs, one column each, U = ``fixed`` of the
    column: ``steps`` of MINRES, side by side; a step is one product with all columns."""
    def away(x: np.ndarray) -> np.ndarray:
        return np.column_stack([c - u @ (u.T @ c) for c, u in zip(x.T, fixed)])

    def safe(a: np.ndarray) -> np.ndarray:
        return np.where(a == 0, 1.0, a)

    v_old, v = np.zeros_like(rhs), away(rhs)
    beta = np.linalg.norm(v, axis=0)
    v = v / safe(beta)
    eta = beta.copy()
    first = safe(beta)
    c_old = c = np.ones(rhs.shape[1])
    s_old = s = np.zeros(rhs.shape[1])
    w_old = w = np.zeros_like(rhs)
    x = np.zeros_like(rhs)
    for _ in range(steps):
        live = beta > 1e-13 * first
        if not live.any():
            break
        y = away(product(v) - v * theta)
        alpha = np.einsum("ij,ij->j", v, y)
        v_new = y - v * alpha - v_old * beta if _ else y - v * alpha
        v_new = away(v_new)
        beta_new = np.linalg.norm(v_new, axis=0)
        # the last two rotations on the new column of the tridiagonal matrix, then one that clears its foot
        lower = beta if _ else np.zeros_like(beta)
        delta = c * alpha - c_old * s * lower
        rho = safe(np.hypot(delta, beta_new))
        mid, top = s * alpha + c_old * c * lower, s_old * lower
        c_new, s_new = delta / rho, beta_new / rho
        w_new = np.where(live, (v - w_old * top - w * mid) / rho, 0.0)
        x = x + w_new * (c_new * eta)
        eta = -s_new * eta
        v_old, v, beta = v, v_new / safe(beta_new), beta_new
        w_old, w, c_old, c, s_old, s = w, w_new, c, c_new, s, s_new
    return x


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, count: int, inner: int = INNER, tol: float = TOL,
            seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(eigenvalues falling, unit eigenvectors as columns, relative residuals) of the ``count`` largest
    pairs of a symmetric matrix given by its product with a block of columns."""
    count = min(count, d)
    width = min(d, count + GUARD)
    basis = min(d, max(4 * width, 24))
    locked, values, residuals = np.zeros((d, 0)), [], []
    q = _orthonormal(np.random.default_rng(seed).standard_normal((d, width)), locked)
    aq = product(q)
    for _ in range(MAX_OUTER):
        theta, y = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = q @ y, aq @ y  # Ritz vectors and their images: no product needed
        r = au - u * theta
        top = max([*values, theta[0], 0.0]) if len(theta) else 0.0
        size = np.linalg.norm(r, axis=0)
        done, whole = 0, q.shape[1] + locked.shape[1] >= d
        while done < len(theta) and len(values) < count and (size[done] <= tol * top or top == 0 or whole):
            values.append(theta[done])
            residuals.append(size[done] / top if top else 0.0)
            done += 1
        locked = np.hstack([locked, u[:, :done]])
        if len(values) == count:
            break
        q, aq, theta, r = u[:, done:], au[:, done:], theta[done:], r[:, done:]
        if q.shape[1] + width > basis:  # restart with the best of the subspace
            q, aq = q[:, :2 * width], aq[:, :2 * width]
        todo = min(width - min(width - 1, len(values)), q.shape[1])
        t = _minres(product, -r[:, :todo], theta[:todo], [np.hstack([locked, q[:, :todo]])] * todo, inner)
        new = _orthonormal(t, np.hstack([locked, q]))
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + 1 + _).standard_normal((d, 1)), np.hstack([locked, q]))
        # what is locked is exact only to rounding: keep its share out of the products too
        image = product(new)
        q, aq = np.hstack([q, new]), np.hstack([aq, image])
        aq = aq - locked @ (locked.T @ aq)
    else:
        raise RuntimeError(f"residuals did not reach {tol} of the largest eigenvalue in {MAX_OUTER} rounds: {size[:count]}")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order], [residuals[i] for i in order]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per kept vector and component: id, component (from 1), n, deviation (exact), whitened, explained, and
    identity_error, the largest absolute entry of whitened's covariance minus the identity."""
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = finite(vectors, id_col, vector_col)
    centred = Centred(rows) if not rows.isEmpty() else None
    trace = centred.trace() if centred and centred.n > 1 else 0.0
    if trace <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    e, u, _ = leading(centred.product, centred.d, components)
    keep = e > RANK_TOL * e[0]
    e, u = e[keep], u[:, keep]
    p = len(e)
    to = u / np.sqrt(e)
    mean = centred.total(lambda c: (c @ to).sum(axis=0)) / centred.n
    cov = centred.total(lambda c: (z := c @ to - mean).T @ z).reshape(p, p) / centred.n
    error = float(np.abs(cov - np.eye(p)).max())
    explained = e / trace
    d, n, floor, rest, sums = centred.d, centred.n, centred.floor, centred.rest, centred.sums
    narrow = (centred.reach * n) ** 2 * d < 1 << 62  # else whole numbers of any size
    offset = [s % n for s in sums]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.array(offset, dtype=np.int64 if narrow else object)
        for b in batches:
            k = b.num_rows
            if not k:
                continue
            step = _matrix(b.column("x"), d) - floor
            whole = step.astype(low.dtype) * n - low
            deviation = (whole * whole).sum(axis=1)
            if not narrow and max(deviation) >= 1 << 63:
                raise OverflowError("a deviation doesn't fit a long")
            z = (step - rest) @ to
            ids = b.column("id").take(pa.array(np.repeat(np.arange(k), p)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, p + 1, dtype=np.int32), k)), pa.array(np.full(k * p, n)),
                 pa.array(np.repeat(deviation.astype(np.int64), p)), pa.array(z.ravel()), pa.array(np.tile(explained, k)),
                 pa.array(np.full(k * p, error))], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
