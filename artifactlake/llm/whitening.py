"""Whitening of embedding vectors by Golub-Kahan-Lanczos bidiagonalisation.

An entry c becomes the whole number ``floor(scale * c) + shift``; sums of whole numbers are exact and do not
depend on their order, so the centre is exact. The centred rows A are written once, in blocks of some
megabytes. Each step then makes one distributed product Av and one Aᵀu over the blocks, in one pass: with
``p = v - beta * w`` a block yields ``Ap``, its part of ``AᵀAp``, and the inner products of ``Ap`` with all earlier
left vectors for the full reorthogonalisation. A left vector has as many entries as the table has rows and is
never stored: ``u = Aw`` for a short vector w. What the driver holds is d numbers a step, whatever the number of
rows. The singular values and right vectors of the small bidiagonal matrix give the components.

The steps go on until the right vectors span the whole space, d at most, so close and equal eigenvalues are
found as well; where the Krylov space ends early, the next step starts with a new direction.

Definitions. Left out: null vectors, vectors with a null or non-finite entry, vectors with an entry beyond
2**52 / scale (its whole number would not be exact), empty vectors, and vectors of another length than the
commonest one (of two equally common ones the longer stays). Components without variance (below ``rank_limit``
of the greatest deviation) can't be scaled and are left out; a table with fewer than two different vectors has
no component and gives no rows. Equal vectors, repeated and null ids give a result each. Components are numbered
by falling variance, their largest entry is positive; tied ones are any basis of their plane.
``deviation`` is null where it does not fit 64 bits. Other columns of the table play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf

BLOCK_BYTES = 4 << 20
#: rows of a result batch
OUT_ROWS = 1 << 16
#: directions whose image is below this share of the whole table's norm count as images of zero
NOTHING = 1e-13


@dataclass(frozen=True)
class Whitening:
    """Centre (``sums`` over ``n`` rows), components (one a row), their deviations and shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: int
    shift: int


def _cells(vectors: pa.Array, scale: int, shift: int, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole numbers of the usable vectors of a batch, by length (or of one length)."""
    at = np.asarray(vectors.offsets).astype(np.int64)
    flat = vectors.values.slice(at[0], at[-1] - at[0])
    entries = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, dtype=np.float64)
    size = np.diff(at)
    entries = entries * scale
    with np.errstate(invalid="ignore"):
        poor = np.concatenate([[0], np.cumsum(~(np.abs(entries) < 2.0**52))])
    good = (poor[at[1:] - at[0]] == poor[at[:-1] - at[0]]) & (size > 0) & np.asarray(vectors.is_valid())
    for d in np.unique(size[good]) if length is None else [length]:
        rows = np.flatnonzero(good & (size == d))
        if len(rows):
            cells = entries[(at[rows] - at[0])[:, None] + np.arange(d)]
            yield rows, np.floor(cells).astype(np.int64) + shift


def _source(vectors: DataFrame, vec_col: str, *first: str) -> DataFrame:
    return vectors.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(first)], F.col(vec_col).cast("array<double>").alias("v"))


def _centre(vectors: DataFrame, vec_col: str, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors and sum of their whole numbers in each dimension, for the commonest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # whole numbers are below 2**53, so 1,024 of them add up within 64 bits
            made = [x[i : i + 1024] for _, x in _cells(batch.column(0), scale, shift) for i in range(0, len(x), 1024)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.shape[1] for x in made], pa.int32()), pa.array([len(x) for x in made], pa.int64()), pa.array([x.sum(0) for x in made], pa.list_(pa.int64()))],
                names=["d", "n", "s"],
            )

    parts = _source(vectors, vec_col).mapInArrow(run, "d int, n long, s array<long>").select("d", "n", F.posexplode("s").alias("i", "s"))
    sums = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    best = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").limit(1)
    rows = sums.join(F.broadcast(best.select("d")), "d").orderBy("i").collect()  # one row a dimension
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def _wrapped(x: int) -> int:
    """``x`` modulo 2**64, as a signed number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


class _Centring:
    """``n * x - S`` of blocks of whole numbers: exact where it fits 64 bits, and as doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.low = n, np.array([_wrapped(s) for s in sums], np.int64)
        self.whole = np.array([_wrapped(s // n) for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """``x - S / n`` and the sums of the squares of ``n * x - S``."""
        rough = (x - self.whole) - self.rest
        fits = np.abs(rough).max(1) * self.n < 2.0**62
        exact = x * np.int64(_wrapped(self.n)) - self.low
        centred = np.where(fits[:, None], exact / self.n, rough)
        large = ((rough * self.n) ** 2).sum(1) >= 2.0**62
        squares = pa.array((exact * exact).sum(1), mask=large | ~fits)
        return centred, squares


def _total(parts: DataFrame) -> np.ndarray:
    """Sum of the partitions' vectors, entry by entry; as many numbers as a vector has come to the driver."""
    rows = parts.select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r.s for r in rows])


def _over(blocks: DataFrame, d: int, make, size: int) -> np.ndarray:
    """Sum of ``make(A)`` over all blocks A of centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for z in batch.column(0):
                total += make(np.frombuffer(z.as_buffer(), np.float64).reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    return _total(blocks.mapInArrow(run, "s array<double>"))


def _norm(v: np.ndarray) -> float:
    return float(np.sqrt(v @ v))


def _apart(v: np.ndarray, base: np.ndarray) -> np.ndarray:
    """``v`` without its part in the space of the orthonormal columns of ``base``; twice, against rounding."""
    for _ in range(2):
        v = v - base @ (base.T @ v)
    return v


def _bidiagonalise(blocks: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Right vectors V (columns), upper bidiagonal B with ``A V = U B``, and the squared norm of A."""
    draw = np.random.default_rng(1)
    v, w, z = (np.zeros((d, 0)) for _ in range(3))
    small = np.zeros((d, d))
    total, beta, fresh = 0.0, 0.0, True
    right = draw.standard_normal(d)
    right /= _norm(right)
    while v.shape[1] < d:
        j = v.shape[1]
        p = right - (beta * w[:, -1] if j else 0.0)

        def products(a: np.ndarray, p=p, w=w, first=j == 0) -> np.ndarray:
            left = a @ p
            return np.concatenate([[left @ left, (a * a).sum() if first else 0.0], (a @ w).T @ left, a.T @ left])

        got = _over(blocks, d, products, 2 + j + d)
        if j == 0:
            total = got[1]
        nothing = NOTHING * np.sqrt(total)
        overlap, image = got[2 : 2 + j], got[2 + j :]
        alpha = float(np.sqrt(max(got[0] - overlap @ overlap, 0.0)))
        if fresh and alpha <= nothing:
            break  # a new direction without an image: the rest of the space has none
        v = np.column_stack([v, right])
        if alpha <= nothing:
            alpha = 0.0
            w, z = np.column_stack([w, np.zeros(d)]), np.column_stack([z, np.zeros(d)])
        else:
            w = np.column_stack([w, (p - w @ overlap) / alpha])
            z = np.column_stack([z, (image - z @ overlap) / alpha])
        small[j, j] = alpha
        right = _apart(z[:, -1], v)
        beta = _norm(right)
        fresh = beta <= nothing
        if fresh and j + 1 < d:
            beta, right = 0.0, _apart(draw.standard_normal(d), v)
        right = right / (_norm(right) or 1.0)
        if j + 1 < d:
            small[j, j + 1] = beta
            right = _apart(right, v)
            right /= _norm(right) or 1.0
    k = v.shape[1]
    return v, small[:k, :k], float(total)


def fit(
    vectors: DataFrame, vec_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000, rank_limit: float = 1e-9
) -> Whitening:
    """Centre, components and deviations of all usable vectors; ``identity_error`` is measured on the whitened rows."""
    n, sums = _centre(vectors, vec_col, scale, shift)
    d = len(sums)
    none = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0), 0.0, scale, shift)
    if n < 2:
        return none
    shelf = Shelf(vectors.sparkSession)
    try:
        blocks = shelf.put(_blocks(_source(vectors, vec_col), n, sums, scale, shift))
        v, small, total = _bidiagonalise(blocks, d)
        if total == 0.0 or not small.size:
            return none
        _, values, turned = np.linalg.svd(small)
        kept = min(components, int((values > rank_limit * values[0]).sum()))
        found = turned[:kept] @ v.T
        found *= np.sign(found[np.arange(kept), np.abs(found).argmax(1)])[:, None]
        deviations = values[:kept] / np.sqrt(n)

        def spread(a: np.ndarray) -> np.ndarray:
            y = a @ (found / deviations[:, None]).T
            return np.concatenate([(y.T @ y).ravel(), y.sum(0)])

        got = _over(blocks, d, spread, kept * kept + kept)
        mean = got[kept * kept :] / n
        cov = got[: kept * kept].reshape(kept, kept) / n - np.outer(mean, mean)
        return Whitening(n, sums, found, deviations, values[:kept] ** 2 / total, float(np.abs(cov - np.eye(kept)).max()), scale, shift)
    finally:
        shelf.clear()


def _blocks(source: DataFrame, n: int, sums: list[int], scale: int, shift: int) -> DataFrame:
    """Centred rows as blocks of doubles, row after row."""
    d = len(sums)
    most = max(1, BLOCK_BYTES // (8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centring = _Centring(n, sums)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                for _, x in _cells(batch.column(0).slice(at, most), scale, shift, d):
                    yield pa.RecordBatch.from_arrays([pa.array([centring.rows(x)[0].tobytes()], pa.binary())], names=["z"])

    return source.mapInArrow(run, "z binary")


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    ident = vectors.schema[id_col]
    schema = T.StructType(
        [
            T.StructField(id_col, ident.dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    n, d, k = model.n, len(model.sums), len(model.components)
    turn = (model.components / model.deviations[:, None]).T if k else None
    most = max(1, OUT_ROWS // max(k, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not k:
            return
        centring = _Centring(n, model.sums)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                for rows, x in _cells(part.column(1), model.scale, model.shift, d):
                    centred, squares = centring.rows(x)
                    each = pa.array(np.repeat(np.arange(len(rows)), k))
                    size = len(rows) * k
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                            pa.array(np.full(size, n)), squares.take(each), pa.array((centred @ turn).ravel()),
                            pa.array(np.tile(model.explained, len(rows))), pa.array(np.full(size, model.identity_error)),
                        ],
                        names=schema.names,
                    )

    return _source(vectors, vec_col, id_col).mapInArrow(run, schema)
