"""Whitening of embeddings by the leading components of their covariance, found by LOBPCG.

Entries are put on a grid of 1/256, so sums over rows are exact whole numbers.
Each distinct row counts once.  The covariance is never formed: a round of
LOBPCG needs its product with a block of at most three times ``block`` columns,
which the partitions compute over centred rows and Spark adds up by dimension.
The driver holds blocks of dimensions x columns only, whatever the number of
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch

GRID, COMPONENTS, BLOCK = 256, 4, 12
#: Largest residual, as a share of the largest eigenvalue, that ends the rounds, and the one that is certified where rounding stops them before.
TOLERANCE, CERTIFIED, ROUNDS, PATIENCE = 1e-14, 1e-11, 300, 4
#: Entries of 2**62 grid steps or more don't fit the grid.
LARGEST = float(1 << 62)


def on_grid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): rows whose entries are all finite, as arrays of whole grid steps; see ``whiten`` for those left out."""
    fits = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * GRID) < LARGEST))
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * GRID).cast("long"))
    return df.filter(F.col(vector_col).isNotNull() & fits & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension, as Python's whole numbers; what comes to the driver is one row a dimension."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column("x"))
            # halves of 32 bits don't overflow
            halves = np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(object)
            n, total = n + len(x), halves if total is None else total + halves
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.shape[1]), pa.int32()), pa.array([n] * total.shape[1], pa.int64()), pa.array(list(total[0]), pa.int64()), pa.array(list(total[1]), pa.int64())], ["dim", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = fit.select("x").mapInArrow(f, "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low")).orderBy("dim").collect()
    return (found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found]) if found else (0, [])


def _added(partials: DataFrame, columns: int) -> np.ndarray:
    """Sum by dimension of the partitions' blocks (dim, c0, c1, ...)."""
    found = partials.groupBy("dim").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(columns)]).toArrow().sort_by("dim")
    return np.column_stack([found[f"c{j}"].to_numpy() for j in range(columns)]) if found.num_rows else np.zeros((0, columns))


def _blocks(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], ["dim", *[f"c{j}" for j in range(total.shape[1])]])


def covariance_product(fit: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) times a block of columns: each partition sums c (c' block) over its centred rows c."""
    columns = block.shape[1]
    sent = fit.sparkSession.sparkContext.broadcast((mean, block))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, block = sent.value
        total = None
        for batch in batches:
            c = _matrix(batch.column("x")).astype(np.float64) - mean
            part = c.T @ (c @ block)
            total = part if total is None else total + part
        if total is not None:
            yield _blocks(total)

    try:
        return _added(fit.select("x").mapInArrow(f, "dim int, " + ", ".join(f"c{j} double" for j in range(columns))), columns) / n
    finally:
        sent.unpersist()


def _trace(fit: DataFrame, mean: np.ndarray, n: int) -> float:
    sent = fit.sparkSession.sparkContext.broadcast(mean)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"t": [float(((_matrix(batch.column("x")) - sent.value) ** 2).sum())]})

    return (fit.select("x").mapInArrow(f, "t double").agg(F.sum("t")).first()[0] or 0.0) / n


def _orthonormal(against: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``against`` followed by an orthonormal basis of what ``new`` adds to it."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - against @ (against.T @ new)
        if not new.size:
            return against
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8]
    return np.hstack([against, new])[:, : len(against)]


@dataclass
class Whitening:
    """What is learnt: rows fitted, exact sums, unit components as columns, their eigenvalues, trace, largest residual and rounds."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    rounds: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def lobpcg(fit: DataFrame, n: int, sums: list[int], components: int = COMPONENTS, block: int = BLOCK, seed: int = 11, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> Whitening:
    """Leading eigenpairs of the covariance of distinct rows (x).

    Each round is one pass over the rows: the covariance times an orthonormal
    basis of the iterate, its residuals and the directions of the round before,
    then Rayleigh-Ritz in that basis.  It ends when the residual of every
    component asked for is below ``tolerance`` of the largest eigenvalue, or
    when rounding lets it fall no further; a last pass over the rows measures
    the residuals of the components returned and certifies them.
    """
    d = len(sums)
    mean = np.array([s / n for s in sums])
    m, wanted = min(d, block), min(d, components)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))
    best, since, kept, number = np.inf, 0, None, 0
    for number in range(1, rounds + 1):
        product = covariance_product(fit, mean, n, basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        iterate, image = basis @ turn, product @ turn
        residuals = image - iterate * values
        largest = np.linalg.norm(residuals[:, :wanted], axis=0).max()
        since = 0 if largest < best / 2 else since + 1
        if largest <= best:
            best, kept = largest, iterate[:, :wanted]
        scale = max(values[0], 0.0)
        if largest <= tolerance * scale or basis.shape[1] == d or since >= PATIENCE and best <= CERTIFIED * scale:
            break
        # directions of this round: the iterate without its part along the one before
        direction = basis[:, m:] @ turn[m:]
        x, _ = np.linalg.qr(iterate)
        basis = _orthonormal(_orthonormal(x, residuals), direction)
    kept, _ = np.linalg.qr(kept)
    image = covariance_product(fit, mean, n, kept)
    values, turn = np.linalg.eigh((kept.T @ image + image.T @ kept) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    kept, image = kept @ turn, image @ turn
    residual = float(np.linalg.norm(image - kept * values, axis=0).max())
    trace = _trace(fit, mean, n)
    if residual > CERTIFIED * max(values[0], 0.0) and residual > 1e-300:
        raise ArithmeticError(f"residual {residual} of eigenvalue {values[0]} after {number} rounds")
    # directions in which the rows don't differ can't be brought to length 1
    held = values > max(1e-12 * trace, 0.0)
    kept, values = kept[:, held], values[held]
    signs = np.sign(kept[np.abs(kept).argmax(axis=0), np.arange(kept.shape[1])])
    return Whitening(n, sums, kept * signs, values, trace, residual, number)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit rows minus the identity, by a pass over the rows."""
    k = len(model.values)
    sent = fit.sparkSession.sparkContext.broadcast((model.mean, model.components / np.sqrt(model.values)))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = sent.value
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_matrix(batch.column("x")) - mean) @ projection
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield _blocks(total)

    total = _added(fit.select("x").mapInArrow(f, "dim int, " + ", ".join(f"c{j} double" for j in range(k))), k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def train_whitening(x: DataFrame, components: int = COMPONENTS, scratch: Scratch | None = None) -> Whitening | None:
    """Fits the components on each distinct row (x) once; none without rows."""
    scratch = scratch or Scratch(x.sparkSession)
    fit = scratch.cut(x.select("x").distinct())
    n, sums = exact_sums(fit)
    if not n:
        return None
    model = lobpcg(fit, n, sums, components)
    if len(model.values):
        model.identity_error = identity_error(fit, model)
    return model


def project(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """A row for each row (id, x) and component: id_col, component, n, deviation, whitened, explained, identity_error."""
    k, limit = len(model.values), 1 << 63
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        projection, mean = m.components / np.sqrt(m.values), m.mean
        furthest = max(map(abs, m.sums))
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            most = m.n * max(abs(int(x.max())), abs(int(x.min()))) + furthest
            if most * most * x.shape[1] < limit:
                deviation = ((m.n * x - np.array(m.sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [sum((m.n * c - s) ** 2 for c, s in zip(row, m.sums)) for row in x.tolist()]
                deviation = [v if v < limit else None for v in deviation]
            white = (x - mean) @ projection
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), m.n)), pa.array(deviation, pa.int64()).take(at), pa.array(white.reshape(-1)), pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(len(at), m.identity_error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "x").mapInArrow(f, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitens rows by the leading components of their covariance.

    Returns for each row and component, from 1 by falling eigenvalue: ``id_col``,
    ``component``, ``n`` (distinct rows fitted), ``deviation`` (sum over
    dimensions of (n x - sums) squared, exact; null if it doesn't fit in a
    long), ``whitened``, ``explained`` and ``identity_error``.

    Rows are left out whose vector is null, empty, holds a null or non-finite
    entry or one of 2**62 grid steps or more; so are those of another length
    than most have (of lengths as common, the shorter stays).  Rows that share
    an id, or have none, are each whitened; equal rows count once in the fit.
    Components along which the rows don't differ are left out, so one distinct
    row, like an empty table, gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.cut(on_grid(df, id_col, vector_col))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    model = None
    if lengths:
        rows = rows.filter(F.size("x") == lengths["d"])
        model = train_whitening(rows, components, scratch)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], f"`{id_col}` {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return project(rows, model, id_col)
