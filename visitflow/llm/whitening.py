"""Whitening of embeddings by their leading principal components, found by a block Jacobi-Davidson method.

Entries become long integers, so that the sums over the fitted vectors, and a vector's deviation from them, are exact.
The covariance V is never formed. A product of V with a few columns is one pass over the stored vectors: each task adds
up its centred rows times their projections, Spark adds up the tasks' sums, and the driver gets one number per dimension
and column. Around these products, small dense algebra runs in the driver:

- Rayleigh-Ritz on an orthonormal basis gives Ritz pairs and residuals from images that are already there.
- A pair whose residual is down to rounding is locked: it stays in the basis but needs no further correction.
- For each other pair the correction equation, projected off all wanted Ritz vectors, is solved roughly by MINRES; one
  pass serves the current MINRES step of all pairs. The corrections widen the basis; a full basis restarts from its best.

It ends when all residuals are at double precision. What the driver holds is (dimensions x columns), never rows.

Results in special cases: rows whose vector is NULL or holds NULL or non-finite entries have no result; entries beyond
+-2**40 count as +-2**40; where lengths differ, the most frequent length is fitted (ties: the longer one) and rows of
other lengths have no result; repeated rows count each; directions without variance are no components, so equal vectors,
a single one, or empty vectors give an empty result, like an empty table; a deviation beyond the range of long is NULL;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import stored

EPS = np.finfo(float).eps
LARGEST = float(1 << 40)
SLICE_ROWS = 8192
OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Centre:
    """Number of vectors and their sums S, as whole parts and rests of S / n: x - S/n is (x - whole) - rest/n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)**2 over the dimensions of every row, in exact arithmetic."""
        moved = x - self.whole
        furthest = self.n * (int(np.abs(moved).max(initial=0)) + 1)
        if furthest * furthest * x.shape[1] >= 1 << 63:
            exact = ((moved.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
            return [int(v) if v < 1 << 63 else None for v in exact]
        return ((moved * self.n - self.rest) ** 2).sum(axis=1).tolist()


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part, part.column("x").flatten().to_numpy().reshape(-1, size)


def _added(fit: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sums over all tasks of ``part(x)``, flat; ``kind`` is long or double. One number per entry reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _slices(batches, size):
            found = part(x).ravel()
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

    value = F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v"))
    rows = fit.select("x").mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(value.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def integer_vectors(embeddings: DataFrame, vector: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that are fitted, in the shared folder, and the length of their vectors."""
    v = F.col("v")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    near = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    whole = rows.filter(v.isNotNull() & ~odd).select(
        "vec_id", F.transform(v, lambda c: F.floor(near(c) * scale) + F.lit(shift).cast("long")).alias("x"))
    fit = stored(whole, "integer-vectors")
    sizes = fit.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    size = size.size if size else 0
    return fit.filter(F.size("x") == size), size


def centre_of(fit: DataFrame, size: int) -> Centre | None:
    sums = _added(fit, size, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "long")
    if not sums:
        return None
    n, *whole = map(int, sums)
    return Centre(n, np.array([s // n for s in whole], np.int64), np.array([s % n for s in whole], np.int64))


def covariance_product(fit: DataFrame, size: int, centre: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """The function that multiplies V, the covariance with divisor n, by columns: one pass over the vectors."""

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ columns)

        return np.array(_added(fit, size, part, "double")).reshape(columns.shape) / centre.n

    return product


def minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Rough solutions of A x = b for every column by itself; ``product`` applies each column's own symmetric A.

    Ends after ``steps`` products or when all residuals are below ``least`` of their start.
    """
    x, before, now = np.zeros_like(b), np.zeros_like(b), b.copy()
    w_before, w = np.zeros_like(b), np.zeros_like(b)
    gamma = np.linalg.norm(b, axis=0)
    eta, start = gamma.copy(), gamma.copy()
    c_before, c = np.ones_like(gamma), np.ones_like(gamma)
    s_before, s = np.zeros_like(gamma), np.zeros_like(gamma)
    for _ in range(steps):
        open_ = (gamma > EPS * start) & (np.abs(eta) > least * start)
        if not open_.any():
            break
        now = now / np.where(gamma > 0, gamma, 1)
        image = product(now)
        delta = (image * now).sum(axis=0)
        following = image - delta * now - gamma * before
        gamma_next = np.linalg.norm(following, axis=0)
        diagonal = c * delta - c_before * s * gamma
        length = np.hypot(diagonal, gamma_next)
        length = np.where(length > 0, length, 1)
        direction = (now - s_before * gamma * w_before - (s * delta + c_before * c * gamma) * w) / length
        c_before, c, s_before, s = c, diagonal / length, s, gamma_next / length
        x = x + np.where(open_, c * eta, 0) * direction
        eta = np.where(open_, -s * eta, eta)
        before, now, w_before, w, gamma = now, following, w, direction, gamma_next
    return x


def widen(basis: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``columns`` add to the orthonormal ``basis``."""
    for _ in range(2):
        columns = columns - basis @ (basis.T @ columns)
        sizes = np.linalg.norm(columns, axis=0)
        columns = columns[:, sizes > 0] / sizes[sizes > 0]
        if not columns.shape[1]:
            return columns
        q, r, _ = _pivoted(columns)
        columns = q[:, np.abs(r) > 1e-8]
    return columns


def _pivoted(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram-Schmidt that takes the longest rest first: orthonormal columns, the lengths of the rests, their order."""
    rest, taken, sizes, order = columns.copy(), [], [], []
    for _ in range(min(columns.shape)):
        lengths = np.linalg.norm(rest, axis=0)
        best = int(lengths.argmax())
        if lengths[best] == 0:
            break
        q = rest[:, best] / lengths[best]
        taken.append(q)
        sizes.append(lengths[best])
        order.append(best)
        rest = rest - np.outer(q, q @ rest)
    return np.array(taken).T.reshape(len(columns), -1), np.array(sizes), np.array(order)


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, steps: int = 3, rounds: int = 200, seed: int = 11
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator without negative ones, falling; eigenvectors; residuals."""
    wanted = min(wanted, size)
    fewest = min(size, 2 * wanted)
    most = min(size, 10 * wanted)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, fewest)))[0]
    image = product(basis)
    best, idle = np.inf, 0
    for _ in range(rounds):
        projected = basis.T @ image
        values, inner = np.linalg.eigh((projected + projected.T) / 2)
        values, inner = values[::-1][:fewest], inner[:, ::-1][:, :fewest]
        ritz, ritz_image = basis @ inner, image @ inner
        theta, u = values[:wanted], ritz[:, :wanted]
        residual = ritz_image[:, :wanted] - u * theta
        sizes = np.linalg.norm(residual, axis=0)
        rounding = 4 * EPS * np.sqrt(size) * max(theta[0], 0)
        locked = sizes <= rounding
        # Rounding in the sums over rows may keep residuals a little above; then they no longer fall.
        idle = 0 if sizes.max() < best / 2 else idle + 1
        best = min(best, sizes.max())
        if locked.all() or (idle >= 3 and best <= 1e3 * rounding):
            return theta, u, sizes
        open_ = np.flatnonzero(~locked)
        if basis.shape[1] + len(open_) > most and basis.shape[1] > fewest:
            basis, image = ritz, ritz_image

        def projected_product(columns: np.ndarray, u: np.ndarray = u, shift: np.ndarray = theta[open_]) -> np.ndarray:
            columns = columns - u @ (u.T @ columns)
            found = product(columns) - columns * shift
            return found - u @ (u.T @ found)

        right = -(residual[:, open_] - u @ (u.T @ residual[:, open_]))
        more = widen(basis, minres(projected_product, right, steps, 0.05))[:, :max(size - basis.shape[1], 0)]
        if not more.shape[1]:
            # Nothing new can be added: the images are computed afresh, on an orthonormal basis.
            basis = np.linalg.qr(basis)[0]
            image = product(basis)
            continue
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    raise ArithmeticError(f"residuals stay at {best:.3g}")


def whiten(
    embeddings: DataFrame, components: int = 8, vector: str = "embedding", scale: int = 1024, shift: int = 100_000
) -> DataFrame:
    """A row per fitted vector of ``embeddings`` (vec_id, ``vector``) and component; see ``OUTPUT`` for the columns."""
    fit, size = integer_vectors(embeddings, vector, scale, shift)
    nothing = embeddings.sparkSession.createDataFrame([], OUTPUT)
    centre = centre_of(fit, size) if size else None
    if centre is None:
        return nothing
    trace = sum(_added(fit, size, lambda x: (centre.centred(x) ** 2).sum(axis=0), "double")) / centre.n
    if trace == 0:
        return nothing
    values, vectors, _ = jacobi_davidson(covariance_product(fit, size, centre), size, components)
    real = values > 16 * EPS * size * values[0]
    values, vectors = values[real], vectors[:, real]
    scaled = vectors / np.sqrt(values)
    means = np.array(_added(fit, size, lambda x: (centre.centred(x) @ scaled).sum(axis=0), "double")) / centre.n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ scaled - means
        return w.T @ w

    k = len(values)
    covariance = np.array(_added(fit, size, spread, "double")).reshape(k, k) / centre.n
    error, shares = float(np.abs(covariance - np.eye(k)).max()), values / trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, size):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(each), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                "n": np.full(m * k, centre.n), "deviation": pa.array(centre.deviations(x), pa.int64()).take(each),
                "whitened": (centre.centred(x) @ scaled).ravel(), "explained": np.tile(shares, m),
                "identity_error": np.full(m * k, error),
            })

    return fit.mapInArrow(rows, OUTPUT)
