"""Embedding whitening by block Jacobi-Davidson.

The covariance is never formed: it acts on a block of vectors through one distributed pass over the fit list (centred
rows times the block, and back), whose tasks each return one sum. On the driver there are only tall matrices of a few
dozen columns. The search space grows by corrections that MINRES finds for all open Ritz vectors side by side, one pass
a step; pairs whose residual is at rounding level are locked, the leading ones first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.stages import materialize
from engram.llm.textbatch import map_batches

_SCALE, _SHIFT = 64, 1_000_000
#: Entries beyond this count as not finite, so that every x and its sums fit.
_LARGEST = 2.0**40
#: Bytes of x-vectors in one row of the fit list.
_BLOCK = 1 << 20
_LOW = 24
#: Inner MINRES steps, and by how much they lower a residual.
_INNER, _INNER_GAIN = 12, 1e-3
_ROUNDS = 300

Product = Callable[[np.ndarray], np.ndarray]


def _integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that count, and their x as a matrix of longs."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    whole = np.flatnonzero((lengths == dim) & ~np.asarray(column.is_null()))
    values = column.values
    fine = np.asarray(values.is_valid())
    numbers = values.fill_null(0.0).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy(zero_copy_only=False)
    fine &= np.abs(numbers) < _LARGEST  # false for NaN and infinities
    at = offsets[whole][:, None] + np.arange(dim)
    good = fine[at].all(axis=1)
    return whole[good], np.floor(_SCALE * numbers[at[good]]).astype(np.int64) + _SHIFT


def _binary(x: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix of longs."""
    width = 8 * x.shape[1]
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _matrix(value: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.int64).reshape(-1, dim)


def _widths(embeddings: DataFrame) -> int:
    """The most frequent number of entries, the largest of several; 0 if there are none."""
    size = F.size("embedding").alias("size")
    first = embeddings.select("embedding").filter("embedding is not null").groupBy(size).count().filter("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def fit_list(embeddings: DataFrame, dim: int) -> DataFrame:
    """Each distinct x-vector once, many to a row: block holds their longs one after another."""
    def pack(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield pa.table({"x": _binary(_integers(batch.column("embedding"), dim)[1])})

    per_row = max(1, _BLOCK // (8 * dim))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            for a in range(0, len(x), per_row):
                part = x.slice(a, per_row)
                block = pa.array([b"".join(v.as_buffer().to_pybytes() for v in part)], pa.binary())
                yield pa.record_batch({"block": block})

    distinct = map_batches(embeddings.select("embedding"), pack, "x binary").distinct()
    return materialize(distinct.mapInArrow(gather, "block binary"), "fit-list")


def _summed(fit: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray], dtype: type) -> np.ndarray:
    """The sum over all blocks of what work makes of each, a fixed number of values whatever the data."""
    kind = "double" if dtype is np.float64 else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("block"):
                one = work(_matrix(value, dim)).ravel()
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch({"slot": np.arange(len(total)), "value": total.astype(dtype)})

    rows = fit.mapInArrow(run, f"slot long, value {kind}").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), dtype=dtype)
    for r in rows:
        out[r["slot"]] = r["value"]
    return out


@dataclass(frozen=True)
class Centre:
    """Mean of the fit list as whole numbers and the rest, so that centred entries are right to the last digit."""

    n: int
    sums: tuple[int, ...]

    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    def rest(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole()).astype(np.float64) - self.rest()

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 in exact integers; None where a long can't hold it."""
        near = x - self.whole()
        rest = np.array([s % self.n for s in self.sums], dtype=object)
        most = (int(np.abs(near).max()) + 1) * self.n if near.size else 0
        if most**2 * x.shape[1] < 2**63:
            return ((near * self.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((near.astype(object) * self.n - rest) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def centre_of(fit: DataFrame, dim: int) -> Centre | None:
    """n and the exact sums; None for an empty list. Sums travel as two halves, which no number of rows lets overflow."""
    mask = (1 << _LOW) - 1
    halves = _summed(fit, dim, lambda x: np.concatenate([[len(x)], (x >> _LOW).sum(axis=0), (x & mask).sum(axis=0)]), np.int64)
    if not len(halves):
        return None
    high, low = halves[1 : dim + 1], halves[dim + 1 :]
    return Centre(int(halves[0]), tuple((int(h) << _LOW) + int(l) for h, l in zip(high, low, strict=True)))


def covariance_product(fit: DataFrame, dim: int, centre: Centre) -> Product:
    """The covariance times a block of vectors, in one pass."""
    def product(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            y = centre.centred(x)
            return y.T @ (y @ q)

        return _summed(fit, dim, work, np.float64).reshape(q.shape) / centre.n

    return product


def _orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of t made orthonormal to the bases and to each other; what vanishes is left out."""
    norms = np.linalg.norm(t, axis=0)
    t = t[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for b in bases:
            t = t - b @ (b.T @ t)
        if t.shape[1]:
            u, s, _ = np.linalg.svd(t, full_matrices=False)
            t = u[:, s > 1e-10]
    for b in bases:
        t = t - b @ (b.T @ t)
    return np.linalg.qr(t)[0] if t.shape[1] else t


def _minres(product: Product, theta: np.ndarray, basis: np.ndarray, rhs: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """t with (I - BB')(V - theta_i I)(I - BB') t_i = rhs_i roughly, a column each, all of them in one pass a step."""
    project = lambda v: v - basis @ (basis.T @ v)
    x, v_old, w_old, w = (np.zeros_like(rhs) for _ in range(4))
    v = project(rhs)
    beta = np.linalg.norm(v, axis=0)
    start = beta.copy()
    live = beta > 0
    v = np.divide(v, beta, out=np.zeros_like(v), where=beta > 0)
    eta, c_old, c, s_old, s = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = np.zeros_like(v)
        p[:, live] = product(v[:, live])
        p = project(p - theta * v)
        alpha = np.einsum("ij,ij->j", v, p)
        p = project(p - alpha * v - beta * v_old)
        grown = np.linalg.norm(p, axis=0)
        # rotate the new column of the tridiagonal matrix
        delta = c * alpha - c_old * s * beta
        over = s * alpha + c_old * c * beta
        far = s_old * beta
        rho = np.hypot(delta, grown)
        live &= rho > 0
        safe = np.where(live, rho, 1.0)
        c_old, s_old = c, s
        c, s = np.where(live, delta / safe, 1.0), np.where(live, grown / safe, 0.0)
        w_old, w = w, np.where(live, (v - far * w_old - over * w) / safe, 0.0)
        x = x + np.where(live, c * eta * w, 0.0)
        eta = np.where(live, -s * eta, eta)
        v_old, beta = v, grown
        v = np.divide(p, grown, out=np.zeros_like(p), where=grown > 0)
        live &= (grown > 1e-14 * np.maximum(np.abs(theta), 1e-300)) & (np.abs(eta) > gain * start)
    return x


def jacobi_davidson(product: Product, dim: int, k: int, most: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix and their unit vectors, residuals at rounding level.

    `most` bounds the columns of the search space beside the locked vectors; it restarts from the leading Ritz vectors.
    """
    most = min(dim, most or 4 * k)
    rng = np.random.default_rng(seed)
    locked = np.zeros((dim, 0))
    values: list[float] = []
    u = _orthonormal(rng.standard_normal((dim, min(dim, k + 4))))
    au = product(u)
    top = 0.0
    for _ in range(_ROUNDS):
        # Rayleigh-Ritz
        h = u.T @ au
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = u @ s, au @ s
        top = max(top, float(theta[0]), *values) if values else max(top, float(theta[0]))
        open_ = min(k - len(values), u.shape[1])
        r = au[:, :open_] - theta[:open_] * u[:, :open_]
        r -= locked @ (locked.T @ r)
        norms = np.linalg.norm(r, axis=0)
        fine = norms <= max(64, dim) * np.finfo(float).eps * top
        n = int(np.argmin(fine)) if not fine.all() else open_
        if n:  # lock the leading pairs
            locked = np.hstack([locked, u[:, :n]])
            values += theta[:n].tolist()
            u, au, theta, r, fine, open_ = u[:, n:], au[:, n:], theta[n:], r[:, n:], fine[n:], open_ - n
        if len(values) >= k:
            break
        if u.shape[1] >= most - 1:  # restart
            stay = max(open_ + 2, min(most // 2, dim - locked.shape[1]))
            u, au, theta = u[:, :stay], au[:, :stay], theta[:stay]
        if open_:
            bad = np.flatnonzero(~fine)
            basis = np.hstack([locked, u[:, :open_]])
            t = _minres(product, theta[bad], basis, -r[:, bad], _INNER, _INNER_GAIN)
        else:
            t = rng.standard_normal((dim, k - len(values)))
        room = max(1, most - u.shape[1])
        t = _orthonormal(t[:, :room], locked, u)
        if not t.shape[1] and locked.shape[1] + u.shape[1] < dim:
            t = _orthonormal(rng.standard_normal((dim, 1)), locked, u)
        if not t.shape[1]:  # the space is full: what is left are products of before, made anew
            au = product(u)
            continue
        u, au = np.hstack([u, t]), np.hstack([au, product(t)])
    else:
        raise RuntimeError("Jacobi-Davidson hasn't settled")
    order = np.argsort(values, kind="stable")[::-1]
    return np.array(values)[order], locked[:, order]


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(embeddings: DataFrame, dim: int, components: int = 16) -> Whitening | None:
    """The whitening of a table's fit list; None if no vector is left."""
    rows = fit_list(embeddings, dim)
    centre = centre_of(rows, dim)
    if centre is None:
        return None
    trace = float(_summed(rows, dim, lambda x: np.array([(centre.centred(x) ** 2).sum()]), np.float64)[0]) / centre.n
    k = min(components, dim, centre.n - 1)
    if k == 0 or trace == 0:
        return Whitening(centre, np.zeros(0), np.zeros((dim, 0)), trace, 0.0)
    values, vectors = jacobi_davidson(covariance_product(rows, dim, centre), dim, k)
    real = values > max(64, dim) * 16 * np.finfo(float).eps * values[0]
    values, vectors = values[real], vectors[:, real]
    shape = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ vectors / np.sqrt(values)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _summed(rows, dim, moments, np.float64) / centre.n
    mean, second = got[:shape], got[shape:].reshape(shape, shape)
    error = np.abs(second - np.outer(mean, mean) - np.eye(shape)).max()
    return Whitening(centre, values, vectors, trace, float(error))


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def embedding_whitening(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """Every vector on the leading principal components, each brought to variance one.

    Returns vec_id, component (from 1, by falling eigenvalue), n (vectors of the fit list), deviation (squared distance
    from the mean times n * n, exact), whitened, explained and identity_error, a row per vector and component.

    Rows whose vector is null, empty, of another length than most (the longer of equally many) or holds an entry that is
    null, not finite or 2**40 and beyond are left out. Equal vectors count once in the fit and each have their rows, as
    have rows that repeat an id and rows without one. Components are at most 16, and no more than have variance: a fit
    list of one vector gives no rows, nor does an empty table. Equal eigenvalues give some basis of their space. A
    deviation that a long can't hold is null. Other columns are ignored.
    """
    embeddings = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("embedding"))
    dim = _widths(embeddings)
    model = fit(embeddings, dim, components) if dim else None
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _SCHEMA)
    kept = len(model.values)
    explained = model.values / model.trace if model.trace else model.values

    def work(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        at, x = _integers(batch.column("embedding"), dim)
        if not len(at) or not kept:
            return
        again = np.repeat(np.arange(len(at)), kept)
        yield pa.table({
            "vec_id": batch.column("vec_id").take(pa.array(at[again])),
            "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), len(at)),
            "n": np.full(len(again), model.centre.n, dtype=np.int64),
            "deviation": pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(again)),
            "whitened": model.whitened(x).ravel(),
            "explained": np.tile(explained, len(at)),
            "identity_error": np.full(len(again), model.identity_error),
        })

    return map_batches(embeddings, work, _SCHEMA)
