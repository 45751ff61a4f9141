"""Inverted lists of product codes: a vector is filed as one byte for each part of it, and exact distances rank the nearest by codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.operators.cells import finite, nearest_of, probe_join, rows_of, squares
from linkforge.operators.knn import DISTANCES, ivf_shape, kmeans, merged
from linkforge.operators.scratch import Tables
from linkforge.plans.strategy import EXACT_BYTES, IvfShape

CODES, SAMPLE = 256, 20_000


@dataclass
class Quantiser:
    """``centres`` of the cells and, for each part of what is left of a vector after its centre, its codes' ``books``."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    @property
    def code_bytes(self) -> int:
        return len(self.books)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        at = np.cumsum([0, *(b.shape[1] for b in self.books)])
        return [x[:, a:b] for a, b in zip(at[:-1], at[1:])]

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Zeros up to a length that the parts divide."""
        return np.pad(x, ((0, 0), (0, self.centres.shape[1] - x.shape[1])))

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.stack([squares(part, book).argmin(axis=1).astype(np.uint8) for part, book in zip(self.parts(self.padded(x) - self.centres[cell]), self.books)], axis=1)

    def decode(self, cell: int | np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes of rows of a cell, or of each its own, stand for."""
        return self.centres[cell] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)

    def estimate(self, q: np.ndarray, cell: int | np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to what the codes of rows of a cell, or of each its own, stand for."""
        return squares(self.padded(q), self.decode(cell, codes))


def fit_quantiser(index: DataFrame, parts: int, shape: IvfShape | None = None, k: int = 10, recall: float = 0.97, sample: int = SAMPLE, seed: int = 0) -> Quantiser | None:
    """Cells and codebooks from a sample of ``sample`` rows at most, drawn by hash; cells and probes by the recall on it unless a shape is given."""
    rows = index.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not len(rows):
        return None
    x = rows_of(rows["vector"])
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    centres, probes = (kmeans(x, shape.cells, seed=seed), shape.probes) if shape else ivf_shape(x, index.count(), k, recall, seed=seed)
    left = x - centres[squares(x, centres).argmin(axis=1)]
    books = [kmeans(part, CODES, seed=seed + 1 + j) for j, part in enumerate(np.split(left, parts, axis=1))]
    return Quantiser(centres, books, min(probes, len(centres)))


def encode_index(index: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(cell, id, code): every row under its nearest cell, with one byte for each part."""
    sent, kind = index.sparkSession.sparkContext.broadcast(quantiser), dict(index.dtypes)["id"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if len(batch):
                x = own.padded(rows_of(batch.column("vector")))
                cell = squares(x, own.centres).argmin(axis=1)
                codes = own.encode(x, cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "code"])

    return index.select("id", "vector").mapInArrow(f, f"cell int, id {kind}, code binary")


def ivf_pq_knn(index: DataFrame, queries: DataFrame, k: int, parts: int = 8, shape: IvfShape | None = None, depth: int = 20, recall: float = 0.97, quantiser: Quantiser | None = None, codes: DataFrame | None = None) -> DataFrame:
    """(orig_idxs, match_idxs, distance): approximately the k nearest rows (id, vector) of each query, squared distances, ties by id.

    The ``depth`` x k nearest by codes of ``parts`` bytes, of each block of
    cells that a query looks into, are ranked by their exact distances where
    they are found, so k of a block are sent on and no vector follows a pair.  A
    fitted ``quantiser`` and the table of its ``codes`` can be kept and given again.
    """
    tables = Tables(index.sparkSession)
    index, queries = (finite(df.select("id", "vector")) for df in (index, queries))
    kinds = dict(queries.dtypes)["id"], dict(index.dtypes)["id"]
    schema = f"orig_idxs {kinds[0]}, match_idxs {kinds[1]}, distance double"
    quantiser = quantiser or fit_quantiser(index, parts, shape, k, recall)
    if quantiser is None:
        return index.sparkSession.createDataFrame([], schema)
    codes = tables.written(encode_index(index, quantiser)) if codes is None else codes
    sent, most = index.sparkSession.sparkContext.broadcast(quantiser), depth * k
    width = quantiser.centres.shape[1]
    padded = width - (index.select(F.size("vector")).first() or [width])[0]
    zero = F.lit(0).cast(dict(queries.dtypes)["vector"].removeprefix("array<").removesuffix(">"))
    asked = queries.select("id", F.concat("vector", F.array_repeat(zero, padded)).alias("vector"))

    def f(asked: pa.Table, held: pa.Table, cell: int) -> pa.Table:
        none = np.zeros(0, np.int64)
        left, right, far = [none], [none], [np.zeros(0)]
        if len(asked) and len(held):
            table = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(len(held), -1)
            stood = sent.value.decode(held["own"].to_numpy(), table)
            q, top = rows_of(asked["vector"]), min(most, len(held))
            # so many queries at a time as keep the table of distances small
            step = max(1, min(256, DISTANCES // len(held)))
            for a in range(0, len(q), step):
                d = squares(q[a : a + step], stood)
                near = np.argpartition(d, top - 1, axis=1)[:, :top]
                left.append(np.repeat(np.arange(a, a + len(d)), top))
                right.append(near.reshape(-1))
                far.append(np.take_along_axis(d, near, axis=1).reshape(-1))
        left, right = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
        return pa.Table.from_arrays([asked["id"].take(left).combine_chunks(), held["id"].take(right).combine_chunks(), pa.array(np.concatenate(far))], ["orig_idxs", "match_idxs", "distance"])

    def exact(asked: pa.Table, held: pa.Table, near: pa.Table) -> pa.Table:
        x, y = rows_of(asked["vector"]), rows_of(held["vector"])
        left, right = (pc.index_in(near[c].combine_chunks(), t["id"].combine_chunks()).to_numpy() for c, t in (("orig_idxs", asked), ("match_idxs", held)))
        x, out = x[:, : y.shape[1]], []
        step = max(1, DISTANCES // y.shape[1])
        for a in range(0, len(near), step):
            out.append(((x[left[a : a + step]] - y[right[a : a + step]]) ** 2).sum(axis=1))
        return nearest_of(near.set_column(2, "distance", pa.array(np.round(np.concatenate([np.zeros(0), *out]), 6))), k)

    held = codes.select("cell", "id", "code").join(index, "id")
    return merged(probe_join(asked, held, quantiser.centres, quantiser.probes, f, schema, most, max(1, EXACT_BYTES // (8 * width)), any_cell=True, last=exact), k)
