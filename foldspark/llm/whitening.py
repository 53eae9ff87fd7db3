"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

Vectors become integers, and each distinct one is a row of the fit list X, with means m and n rows. The bidiagonalisation of
A = X - m alternates products A v and A' u: u_j = (A v_j - beta_j-1 u_j-1) / alpha_j and v_j+1 = (A' u_j - alpha_j v_j) / beta_j,
each made orthogonal to all earlier ones. A row's entries of the u's follow from the row itself, since u_j = A p_j with p_j =
(v_j - beta_j-1 p_j-1) / alpha_j; so no u is stored, one job a step makes both products over the rows that it holds, and the
driver holds vectors of as many numbers as there are dimensions. The singular value decomposition of the small
bidiagonal matrix gives components and deviations.

Up to COMPLETE dimensions the whole space is spanned, so equal eigenvalues can't hide; beyond, steps go on until the wanted
components' residuals vanish.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import map_arrow, materialise, release
from foldspark.llm.exact_topk import integers, packed, unpacked

COMPONENTS = 4
#: Up to so many dimensions all are spanned.
COMPLETE = 64
#: Residuals below this share of the largest deviation count as none; so do deviations that are themselves so small a share.
TOLERANCE = 1e-13
NOTHING = 1e-9
SEED = 29


class Whitening(NamedTuple):
    """A fitted whitening; `components` has a column for each component, by falling variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total_variance: float
    identity_error: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers as whitened coordinates."""
        return (x - self.sums / self.n) @ self.components / np.sqrt(self.variances)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed vectors that take part, each once a batch."""
    for batch in batches:
        x, ok = integers(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array({packed(x[i]) for i in np.flatnonzero(ok).tolist()}, pa.binary())], names=["x"])


def _entries(values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (kind, place, value) of some arrays of sums."""
    kinds = [k for k, v in values.items() for _ in range(v.size)]
    places = [np.arange(v.size) for v in values.values()]
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate([v.ravel() for v in values.values()]).astype(float), pa.float64())], names=["kind", "place", "value"])


def _summed(batches: Iterator[pa.RecordBatch], sums, dim: int) -> Iterator[pa.RecordBatch]:
    """One row for each number in the sums over a task's rows."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            for kind, v in sums(unpacked(batch.column(0), dim)).items():
                total[kind] = total[kind] + v if kind in total else v
    if total:
        yield _entries(total)


def _over_rows(rows: DataFrame, sums, dim: int) -> dict[str, np.ndarray]:
    """Sums of arrays over all rows; `sums` gives them for a matrix of rows. The driver gets each number once."""
    parts = map_arrow(rows.select("x"), partial(_summed, sums=sums, dim=dim), "kind string, place long, value double")
    out: dict[str, list] = {}
    for kind, _, value in parts.groupBy("kind", "place").agg(F.sum("value")).sort("kind", "place").collect():
        out.setdefault(kind, []).append(value)
    return {k: np.array(v) for k, v in out.items()}


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of each dimension over a task's rows."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        x = unpacked(batch.column(0), len(total)).astype(np.int64)
        total = np.pad(total, (0, x.shape[1] - len(total))) + x.sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])


def _products(x: np.ndarray, mean: np.ndarray, p: np.ndarray, earlier: np.ndarray) -> dict[str, np.ndarray]:
    """u = A p for these rows, and from it A' u, its square and its products with the earlier u's."""
    a = x - mean
    u = a @ p
    return {"back": a.T @ u, "square": np.array([u @ u]), "earlier": (a @ earlier).T @ u}


def _variances(x: np.ndarray, mean: np.ndarray) -> dict[str, np.ndarray]:
    return {"square": np.array([((x - mean) ** 2).sum()])}


def _moments(x: np.ndarray, model: Whitening) -> dict[str, np.ndarray]:
    w = model.whiten(x)
    return {"sum": w.sum(0), "product": w.T @ w}


def _orthogonal(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """v without what it shares with the columns of `to`; twice, so that rounding leaves nothing."""
    for _ in range(2):
        v = v - to @ (to.T @ v)
    return v


def bidiagonalise(product, dim: int, wanted: int, scale: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values) of A, the `wanted` largest ones at least where there are so many.

    product(p, P) gives A'A p, |A p|^2 and (A P)'(A p); scale is the root of all squares in A, against which nothing is
    told from rounding.
    """
    rng = np.random.default_rng(seed)

    def start(v: np.ndarray) -> np.ndarray:
        fresh = _orthogonal(rng.standard_normal(dim), v)
        return fresh / np.linalg.norm(fresh)

    v, p, back = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))  # back: A'u of each u
    matrix = np.zeros((0, 0))  # U'AV: a row for each u, a column for each v
    new, beta = start(v), 0.0
    while True:
        v = np.column_stack([v, new])
        matrix = np.column_stack([matrix, np.zeros(len(matrix))])
        q = new
        if beta:
            matrix[-1, -1] = beta
            q = new - beta * p[:, -1]
        got = product(q, p)
        share = got["earlier"]
        alpha = float(np.sqrt(max(got["square"][0] - share @ share, 0.0)))
        beta = 0.0
        if alpha > NOTHING * scale:  # else A takes this direction to nothing new
            u_back = (got["back"] - back @ share) / alpha
            p, back = np.column_stack([p, (q - p @ share) / alpha]), np.column_stack([back, u_back])
            matrix = np.vstack([matrix, np.zeros(matrix.shape[1])])
            matrix[-1, -1] = alpha
            rest = _orthogonal(u_back - alpha * new, v)
            beta = float(np.linalg.norm(rest))
        if v.shape[1] >= dim:
            break
        if v.shape[1] >= COMPLETE and len(matrix) >= wanted and beta > 0:
            left, s, _ = np.linalg.svd(matrix, full_matrices=False)
            if np.all(beta * np.abs(left[-1, :wanted]) <= TOLERANCE * s[0]):
                break
        if beta > NOTHING * scale:
            new = rest / beta
        else:
            beta, new = 0.0, start(v)
    _, s, right = np.linalg.svd(matrix, full_matrices=False)
    return v @ right.T, s


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct integer vectors; None if no vector takes part.

    Components are those of positive variance, at most `components`. Vectors as in `whiten`.
    """
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(map_arrow(rows, _distinct, "x binary").distinct(), "fit-vectors").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = map_arrow(rows, _totals, "place long, value long").groupBy("place").agg(F.sum("value")).sort("place").collect()
        n, sums = rows.count(), np.array([r[1] for r in totals], np.int64)
        dim = len(sums)
        if not n:
            return None
        if not dim:
            return Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
        mean = sums / n
        squares = float(_over_rows(rows, partial(_variances, mean=mean), dim)["square"][0])
        empty = Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), squares / n, 0.0)
        if not squares:
            return empty
        context = vectors.sparkSession.sparkContext

        def product(p: np.ndarray, earlier: np.ndarray) -> dict[str, np.ndarray]:
            sent = context.broadcast((mean, p, earlier))
            try:
                return {"earlier": np.zeros(0)} | _over_rows(rows, lambda x: _products(x, *sent.value), dim)
            finally:
                sent.unpersist()

        basis, deviations = bidiagonalise(product, dim, components + 1, squares**0.5)
        real = deviations > NOTHING * squares**0.5
        basis, deviations = basis[:, real][:, :components], deviations[real][:components]
        if not len(deviations):
            return empty
        model = Whitening(n, sums, basis / np.linalg.norm(basis, axis=0), deviations**2 / n, squares / n, 0.0)
        got = _over_rows(rows, partial(_moments, model=model), dim)
        k, means = len(deviations), got["sum"] / n
        covariance = got["product"].reshape(k, k) / n - np.outer(means, means)  # the means are nothing but rounding
        return model._replace(identity_error=float(np.abs(covariance - np.eye(k)).max()))
    finally:
        rows.unpersist()
        release(rows)


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _apply(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k, dim = len(model.variances), len(model.sums)
    for batch in batches:
        each, ok = integers(batch.column(1))
        keep = np.flatnonzero(ok)
        x = np.zeros((len(keep), dim), np.int64)
        for row, i in enumerate(keep.tolist()):
            x[row, : len(each[i])] = each[i]
        largest = model.n * int(np.abs(x).max(initial=0)) + int(np.abs(model.sums).max(initial=0))
        if largest * largest * max(dim, 1) < 1 << 63:
            deviation = ((model.n * x - model.sums) ** 2).sum(1).tolist()
        else:
            deviation = [d if d < 1 << 63 else None for d in (((x.astype(object) * model.n - model.sums.astype(object)) ** 2).sum(1)).tolist()]
        white = model.whiten(x)
        columns = [
            batch.column(0).take(pa.array(np.repeat(keep, k))),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(keep))),
            pa.array(np.full(k * len(keep), model.n)),
            pa.array([d for d in deviation for _ in range(k)], pa.int64()),
            pa.array(white.ravel()),
            pa.array(np.tile(model.variances / model.total_variance, len(keep))),
            pa.array(np.full(k * len(keep), model.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector that takes part and component.

    A component x counts as floor(256 * x); a vector that is null or holds a null, a non-finite or a component of more than 2^16
    in magnitude is dropped. Vectors of different length are taken as if shorter ones ended in zeros. The fit list holds
    each distinct vector once. deviation is exact, and null where a long can't hold it. Components have positive variance, so a
    table whose vectors have fewer such components gets fewer rows for each, and none if all are equal; which of equal variance come first is
    undefined. Repeated rows repeat their results, and a row without vec_id keeps its null; an empty table gives no rows. Only vec_id
    and embedding are read.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    model = fit(vectors, components)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    return map_arrow(rows, partial(_apply, model=model), _SCHEMA)
