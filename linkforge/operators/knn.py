"""Nearest-neighbour joins between tables of vectors, exact and by inverted lists, and edge lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.operators.cells import file_by_cell, probe_join
from linkforge.operators.grid import grid
from linkforge.plans.strategy import EXACT_BYTES, IvfShape, choose

METRICS = ("l2", "l2sq", "cosine")
#: Distances that a task has in memory at a time.
DISTANCES = 1 << 21


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    x = x.astype(np.float64)
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return x


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def block_neighbours(asked: pa.Table, held: pa.Table, k: int, metric: str) -> pa.Table:
    """(orig_idxs, match_idxs, distance) of the k nearest held rows (id, vector) of each asked row, ties by id."""

    def distances(q: np.ndarray, y: np.ndarray, square: np.ndarray) -> np.ndarray:
        d = 1 - np.einsum("qd,qkd->qk", q, y) if metric == "cosine" else np.sqrt(square) if metric == "l2" else square
        return np.round(d, 6)

    out = [pa.RecordBatch.from_arrays([asked["id"].combine_chunks()[:0], held["id"].combine_chunks()[:0], pa.array([], pa.float64())], ["orig_idxs", "match_idxs", "distance"])]
    if not len(asked) or not len(held):
        return pa.Table.from_batches(out)
    held = held.sort_by("id")
    ids, x = held["id"].to_numpy(), _prepared(_matrix(held["vector"]), metric)
    norms = (x**2).sum(axis=1)
    q, own = _prepared(_matrix(asked["vector"]), metric), asked["id"].combine_chunks()
    # so many queries at a time as keep the table of distances small, however many rows are held
    step = max(1, min(256, DISTANCES // len(ids)))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        rough = part @ x.T
        rough *= -2
        rough += (part**2).sum(axis=1)[:, None]
        rough += norms
        top = min(len(ids), k + 16)
        near = np.argpartition(rough, top - 1, axis=1)[:, :top]
        # differences again for the near ones: the expanded form loses digits
        square = ((part[:, None, :] - x[near]) ** 2).sum(axis=2)
        d = distances(part, x[near], square)
        order = np.lexsort((ids[near], d), axis=1)[:, :k]
        d, match = np.take_along_axis(d, order, axis=1), np.take_along_axis(ids[near], order, axis=1)
        if top < len(ids):
            # rows left out may tie with the last one kept, by six places and the digits lost
            last = np.partition(square, k - 1, axis=1)[:, k - 1]
            last = last + 4e-6 * (1 + np.sqrt(last)) + 1e-12 * ((part**2).sum(axis=1) + norms.max())
            for r in np.flatnonzero(np.take_along_axis(rough, near, axis=1).max(axis=1) <= last):
                all_near = np.flatnonzero(rough[r] <= last[r])
                y = x[all_near][None]
                own_d = distances(part[r : r + 1], y, ((part[r] - y) ** 2).sum(axis=2))[0]
                order = np.lexsort((ids[all_near], own_d))[:k]
                d[r], match[r] = own_d[order], ids[all_near][order]
        of = own.slice(a, len(part)).take(pa.array(np.repeat(np.arange(len(part)), d.shape[1])))
        out.append(pa.RecordBatch.from_arrays([of, pa.array(match.reshape(-1)), pa.array(d.reshape(-1))], ["orig_idxs", "match_idxs", "distance"]))
    return pa.Table.from_batches(out)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query's matches, ties by id."""
    rank = F.row_number().over(Window.partitionBy("orig_idxs").orderBy("distance", "match_idxs"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def exact_knn(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq", block_bytes: int = EXACT_BYTES) -> DataFrame:
    """(orig_idxs, match_idxs, distance): the k nearest index rows (id, vector) of each query row (id, vector), ties by id.

    Blocks of queries meet blocks of the index, of ``block_bytes`` at most, in
    NumPy, and the blocks' best are merged.  Rows as near as the last one kept
    are all compared, however many.
    """
    dim = index.select(F.max(F.size("vector"))).first()[0] or 1
    kinds = dict(queries.dtypes)["id"], dict(index.dtypes)["id"]
    best = grid(queries.select("id", "vector"), index.select("id", "vector"), lambda asked, held: block_neighbours(asked, held, k, metric), f"orig_idxs {kinds[0]}, match_idxs {kinds[1]}, distance double", max(1, block_bytes // (8 * dim)))
    return merged(best, k)


def kmeans(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds on a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)
    return centres


def ivf_shape(x: np.ndarray, rows: int, k: int, recall: float, asked: int = 200, seed: int = 0) -> tuple[np.ndarray, int]:
    """Cell centres fitted on a sample, about one for each hundred of ``rows``, and as many probes as reach the recall on it.

    The recall is that of ``asked`` rows of the sample among the others, against
    all distances.  It carries over to all rows, since a neighbour's cell lies
    as near whether or not the cell is fuller.
    """
    centres = kmeans(x, int(min(max(16, rows // 100), len(x) // 4 or 1, 4096)), seed=seed)
    q = x[np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)]
    d = (q**2).sum(axis=1)[:, None] - 2 * q @ x.T + (x**2).sum(axis=1)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]  # without the row itself
    cell = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
    rank = ((centres**2).sum(axis=1) - 2 * q @ centres.T).argsort(axis=1).argsort(axis=1)
    at = np.sort(np.take_along_axis(rank, cell[near], axis=1), axis=None)
    return centres, int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else 1


def ivf_knn(index: DataFrame, queries: DataFrame, k: int, shape: IvfShape | None = None, metric: str = "l2sq", sample: int = 20_000, recall: float = 0.95) -> DataFrame:
    """The same, approximately: rows meet in the cells nearest to the query and exact distances rank them.

    Cell centres are fitted on a bounded sample; every index row is filed.
    Without a ``shape`` the number of cells follows that of the rows, and as
    many are looked into as reach ``recall`` on the sample.
    """
    if metric not in ("l2", "l2sq"):
        raise ValueError(f"no inverted lists for {metric}")
    rows = index.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = _matrix(rows.column("vector"))
    if not len(x):
        return exact_knn(index, queries, k, metric)
    if shape is None:
        centres, probes = ivf_shape(x, index.count(), k, recall)
    else:
        centres, probes = kmeans(x, shape.cells), shape.probes
    near = file_by_cell(index, centres, 1)
    kinds = dict(queries.dtypes)["id"], dict(index.dtypes)["id"]
    found = probe_join(queries, near, centres, probes, lambda q, x, _: block_neighbours(q, x, k, metric), f"orig_idxs {kinds[0]}, match_idxs {kinds[1]}, distance double", k, any_cell=True)
    return merged(found, k)


def knn(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq", strategy: str = "auto") -> DataFrame:
    """Exact up to the planner's number of rows, by inverted lists beyond it (with the cosine always exact)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if strategy == "auto":
        strategy = "exact" if metric == "cosine" else choose(index.count())
    return exact_knn(index, queries, k, metric) if strategy == "exact" else ivf_knn(index, queries, k, metric=metric)


def edges(neighbours: DataFrame, cutoff: float | None = None, symmetric: bool = False) -> DataFrame:
    """An edge list: without rows that match themselves, and of the rest those with orig < match.

    A pair that only the later row found is therefore not listed, unless
    ``symmetric``: then each pair that either row found is listed once.
    """
    if symmetric:
        pairs = neighbours.filter("orig_idxs <> match_idxs").select(F.least("orig_idxs", "match_idxs").alias("orig_idxs"), F.greatest("orig_idxs", "match_idxs").alias("match_idxs"), "distance")
        out = pairs.groupBy("orig_idxs", "match_idxs").agg(F.min("distance").alias("distance"))
    else:
        out = neighbours.filter("orig_idxs < match_idxs")
    return out.filter(F.col("distance") < cutoff) if cutoff is not None else out
