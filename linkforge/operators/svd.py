"""Truncated singular value decomposition of sparse (id, term, weight) tables by randomised subspace iteration."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_dim(n_terms: int) -> int:
    return min(256, int(n_terms**0.5))


@dataclass
class SvdModel:
    """``basis``: one column for each of the leading right singular vectors, a row for each of ``terms``."""

    terms: dict[str, int]
    basis: np.ndarray
    values: np.ndarray
    shared: int = 0  # rows that terms share by hash; 0 if each has its own

    def transform(self, weights: DataFrame) -> DataFrame:
        """(id, vector): the rows times the basis, that is U S for the rows fitted; new rows get the same basis."""
        rows = _grouped(_folded(weights, self.shared))
        model = weights.sparkSession.sparkContext.broadcast(self)

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for batch in batches:
                out = [m.project(t, w) for t, w in zip(batch.column("terms").to_pylist(), batch.column("weights").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.astype(np.float32) for x in out], pa.list_(pa.float32()))], ["id", "vector"])

        return rows.mapInArrow(f, f"id {dict(rows.dtypes)['id']}, vector array<float>")

    def project(self, terms: list[str], weights: list[float]) -> np.ndarray:
        known = [(self.terms[t], w) for t, w in zip(terms, weights) if t in self.terms]
        if not known:
            return np.zeros(self.basis.shape[1])
        at, w = zip(*known)
        return np.array(w) @ self.basis[list(at)]


def _folded(weights: DataFrame, shared: int) -> DataFrame:
    """Terms by the row that they share."""
    if not shared:
        return weights
    row = F.concat(F.lit("#"), F.pmod(F.xxhash64("term"), F.lit(shared)).cast("string"))
    return weights.withColumn("term", row).groupBy("id", "term").agg(F.sum("weight").alias("weight"))


def _grouped(weights: DataFrame) -> DataFrame:
    pairs = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("x"))
    return pairs.select("id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))


#: Rows of a partition at least, unless there are fewer than cores: each sends a whole block in every pass.
PART_ROWS = 2048
#: Bytes of a stretch of the block's rows that is added up in one place.
CHUNK_BYTES = 1 << 20


def _products(rows: DataFrame, block: np.ndarray, terms: dict[str, int]) -> DataFrame:
    """(chunk, s): the matrix and its transpose times a block, a row for each stretch of the block's rows.

    Partitions' sums meet by stretch and are added in the partitions' order, so
    however many there are, the driver gets one block.
    """
    sent = rows.sparkSession.sparkContext.broadcast((block, terms))
    step = max(1, CHUNK_BYTES // max(1, 8 * block.shape[1]))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index = sent.value
        total, part = np.zeros_like(own), TaskContext.get().partitionId()
        for batch in batches:
            for t, w in zip(batch.column("terms").to_pylist(), batch.column("weights").to_pylist()):
                at, w = [index[x] for x in t], np.array(w)
                total[at] += np.outer(w, w @ own[at])
        for c, a in enumerate(range(0, len(total), step)):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "part": pa.array([part], pa.int32()), "s": pa.array([total[a : a + step].tobytes()], pa.binary())})

    def added(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")
        total = sum(np.frombuffer(x) for x in parts["s"].to_pylist())
        return pa.table({"chunk": parts["chunk"].slice(0, 1), "s": pa.array([total.tobytes()], pa.binary())})

    return rows.mapInArrow(f, "chunk int, part int, s binary").groupBy("chunk").applyInArrow(added, "chunk int, s binary")


def fit(weights: DataFrame, dim: int | None = None, passes: int = 7, extra: int = 10, most_terms: int = 2_000_000) -> SvdModel:
    """Leading right singular vectors of the matrix of weights.

    Each pass multiplies a block of terms x (dim + extra) by the matrix and its
    transpose; partitions' sums are added up in Spark, and one block returns.  The block is broadcast, and its
    rows are the vocabulary.  Beyond ``most_terms`` terms they share rows by
    hash, so the block is bounded; weights of terms that share a row are summed.
    Signs are fixed by the largest component.
    """
    every = weights.select("term").distinct()
    n_terms = every.count()
    shared = most_terms if n_terms > most_terms else 0
    weights = _folded(weights, shared)
    every = weights.select("term").distinct() if shared else every
    found = sorted(r[0] for r in every.toLocalIterator())
    terms = {t: i for i, t in enumerate(found)}
    rows = _grouped(weights).cache()
    n_rows = rows.count()
    dim = min(dim or default_dim(len(terms)), len(terms), max(1, n_rows))
    few = rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // PART_ROWS)))
    width = min(len(terms), dim + extra)
    seeds = [int(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) for t in found]
    q = np.stack([np.random.default_rng(s).standard_normal(width) for s in seeds]) if found else np.zeros((0, width))
    q, _ = np.linalg.qr(q)
    basis, values = q, np.zeros(0)
    for _ in range(passes):
        got = _products(few, q, terms).toArrow().sort_by("chunk")
        sums = np.concatenate([np.zeros(0), *[np.frombuffer(x) for x in got["s"].to_pylist()]]).reshape(q.shape)
        # Rayleigh-Ritz on this pass's block, then the next block
        small = q.T @ sums
        squares, turn = np.linalg.eigh((small + small.T) / 2)
        basis, values = q @ turn[:, ::-1], np.sqrt(np.maximum(0, squares[::-1]))
        q, _ = np.linalg.qr(sums)
    basis = basis[:, :dim]
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    rows.unpersist()
    return SvdModel(terms, basis * np.where(signs == 0, 1, signs), values[:dim], shared)
