"""Truncated singular value decomposition whose blocks are tables: for vocabularies that no machine holds.

The matrix of weights is dealt into tiles of term blocks by row blocks, and the
iterate is a table with a row for each term.  A pass multiplies tiles by the
terms' rows, adds up by row, multiplies back and adds up by term; the new
iterate is made orthonormal by a tall-skinny QR, in which partitions factor
their own rows and what comes to the driver are triangles of columns x columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.operators.cells import lists_of, rows_of
from linkforge.operators.scratch import Tables
from linkforge.operators.svd import default_dim

#: Bytes of a block of terms or rows, and entries of a tile.
BLOCK_BYTES, TILE_ENTRIES = 32 << 20, 2_000_000


def _uniform(keys: np.ndarray, columns: int) -> np.ndarray:
    """Numbers from -1 to 1 for each key and column, the same for a key on every run."""
    x = keys.view(np.uint64)[:, None] + np.arange(1, columns + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / 2**52 - 1


def _summed(rows: DataFrame, keys: list[str], columns: int) -> DataFrame:
    """Sums of the arrays ``x`` by keys; partitions add up their own first."""
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col("x")[j]).alias(f"c{j}") for j in range(columns)])
    return sums.select(*keys, F.array(*[f"c{j}" for j in range(columns)]).alias("x"))


def _triangle(rows: DataFrame, columns: int) -> np.ndarray:
    """The triangle of a QR of all rows ``x``: of each partition's, then of a few tasks' triangles, then of these."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, columns))
        for batch in batches:
            if len(batch):
                r = np.linalg.qr(np.vstack([r, rows_of(batch.column("x"))]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([lists_of(r, pa.float64())], ["x"])

    few = rows.select("x").mapInArrow(f, "x array<double>").repartition(16).mapInArrow(f, "x array<double>").toArrow()
    return np.linalg.qr(rows_of(few["x"]), mode="r") if len(few) else np.zeros((0, columns))


def _times(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """Each row ``x`` times a small matrix."""
    sent = rows.sparkSession.sparkContext.broadcast(turn)
    others = [c for c in rows.columns if c != "x"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], lists_of(rows_of(batch.column("x")) @ sent.value, pa.float64())], [*others, "x"])

    kinds = dict(rows.dtypes)
    return rows.select(*others, "x").mapInArrow(f, ", ".join([*[f"{c} {kinds[c]}" for c in others], "x array<double>"]))


@dataclass
class BlockSvd:
    """``basis``: (tb, t, x), a row of the leading right singular vectors for each term's hash; ``values``; ``term_blocks``."""

    basis: DataFrame
    values: np.ndarray
    term_blocks: int

    def transform(self, weights: DataFrame) -> DataFrame:
        """(id, vector): rows (id, term, weight) times the basis; terms that weren't fitted count for nothing."""
        tables = Tables(weights.sparkSession)
        ids = weights.select("id").distinct()
        row_blocks = max(1, -(-ids.count() * len(self.values) * 8 // BLOCK_BYTES), -(-weights.count() // (TILE_ENTRIES * self.term_blocks)))
        rows = _by_row(_tiles(weights, self.term_blocks, row_blocks, tables), self.basis, row_blocks, len(self.values))
        none = F.array_repeat(F.lit(0.0), len(self.values))
        return ids.join(rows, "id", "left").select("id", F.coalesce("x", none).cast("array<float>").alias("vector"))


def _tiles(weights: DataFrame, term_blocks: int, row_blocks: int, tables: Tables) -> DataFrame:
    """(tb, rb, id, t, w)"""
    t = F.xxhash64("term")
    return tables.written(weights.select(F.pmod(t, F.lit(term_blocks)).cast("int").alias("tb"), F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("rb"), "id", t.alias("t"), F.col("weight").cast("double").alias("w")))


def _multiplied(tiles: DataFrame, block: DataFrame, key: str, copies: tuple[str, int], to: str, columns: int, schema: str) -> DataFrame:
    """Tiles times the block's rows by ``key``, added up by ``to`` within each tile; the block goes to each of the other side's blocks."""
    sent = block.withColumn(copies[0], F.explode(F.sequence(F.lit(0), F.lit(copies[1] - 1))))

    def f(tile: pa.Table, rows: pa.Table) -> pa.Table:
        out = [tile[to].combine_chunks()[:0], pa.array([], pa.list_(pa.float64()))]
        if len(tile) and len(rows):
            import pyarrow.compute as pc

            at = pc.index_in(tile[key], rows[key]).combine_chunks()
            keep = at.is_valid()
            at, w, own = at.filter(keep).to_numpy(), tile["w"].combine_chunks().filter(keep).to_numpy(), tile[to].combine_chunks().filter(keep)
            x, known = rows_of(rows["x"]), own.dictionary_encode()
            order = np.argsort(known.indices.to_numpy(), kind="stable")
            of = known.indices.to_numpy()[order]
            total, first = np.zeros((len(known.dictionary), columns)), 0
            while first < len(of):  # a stretch of entries at a time, whole keys of it
                last = min(len(of), first + 100_000)
                begin = np.flatnonzero(np.append(True, of[first + 1 : last] != of[first : last - 1]))
                np.add.at(total, of[first:last][begin], np.add.reduceat(x[at[order[first:last]]] * w[order[first:last], None], begin))
                first = last
            out = [known.dictionary, lists_of(total, pa.float64())]
        columns_ = [pa.array(np.full(len(out[0]), tile["tb"][0].as_py() if len(tile) else 0, np.int32)), *out] if to == "t" else out
        return pa.Table.from_arrays(columns_, ["tb", "t", "x"] if to == "t" else ["id", "x"])

    return tiles.groupBy("tb", "rb").cogroup(sent.groupBy("tb", "rb")).applyInArrow(f, schema)


def _by_row(tiles: DataFrame, block: DataFrame, row_blocks: int, columns: int) -> DataFrame:
    kind = dict(tiles.dtypes)["id"]
    return _summed(_multiplied(tiles, block, "t", ("rb", row_blocks), "id", columns, f"id {kind}, x array<double>"), ["id"], columns)


def fit_blocks(weights: DataFrame, dim: int | None = None, passes: int = 7, extra: int = 10, block_bytes: int = BLOCK_BYTES) -> BlockSvd:
    """Leading right singular vectors of the matrix of a table (id, term, weight), by subspace iteration.

    No object on the driver or in a task is larger than a block and a tile,
    whatever the numbers of terms and rows; terms go by 64-bit hashes.  Signs
    are fixed by the largest component.  Without weights there are no values.
    """
    spark = weights.sparkSession
    tables = Tables(spark)
    n_terms, n_rows, n = weights.agg(F.countDistinct("term"), F.countDistinct("id"), F.count("*")).first()
    dim = min(dim or default_dim(n_terms), n_terms, max(1, n_rows))
    columns = min(n_terms, dim + extra)
    blocks = lambda rows: max(1, -(-rows * max(1, columns) * 8 // block_bytes))
    term_blocks = blocks(n_terms)
    row_blocks = max(blocks(n_rows), -(-n // (TILE_ENTRIES * term_blocks)))
    tiles = _tiles(weights, term_blocks, row_blocks, tables)
    if not n_terms:
        return BlockSvd(spark.createDataFrame([], "tb int, t long, x array<double>"), np.zeros(0), 1)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("tb"), batch.column("t"), lists_of(_uniform(batch.column("t").to_numpy(), columns), pa.float64())], ["tb", "t", "x"])

    def orthonormal(rows: DataFrame) -> DataFrame:
        """Twice, since the first triangle is as exact as the columns are apart."""
        for _ in range(2):
            u, s, v = np.linalg.svd(_triangle(rows, columns))
            rows = tables.written(_times(rows, v.T / np.maximum(s, s.max() * 1e-300 or 1.0)))
        return rows

    own_by_row: Callable[[DataFrame], DataFrame] = lambda block: _by_row(tiles, block, row_blocks, columns)
    iterate = orthonormal(tables.written(tiles.select("tb", "t").distinct().mapInArrow(begun, "tb int, t long, x array<double>")))
    for number in range(passes):
        by_row = tables.written(own_by_row(iterate).withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")))
        if number == passes - 1:
            break
        back = _multiplied(tiles, by_row, "id", ("tb", term_blocks), "t", columns, "tb int, t long, x array<double>")
        iterate = orthonormal(tables.written(_summed(back, ["tb", "t"], columns)))
    _, values, turn = np.linalg.svd(_triangle(by_row, columns))
    basis = tables.written(_times(iterate, turn.T[:, :dim]))
    largest = basis.agg(*[F.max_by(F.col("x")[j], F.struct(F.abs(F.col("x")[j]), F.col("t"))).alias(f"c{j}") for j in range(dim)]).first()
    signs = np.array([-1.0 if c < 0 else 1.0 for c in largest])
    return BlockSvd(tables.written(_times(basis, np.diag(signs))), values[:dim], term_blocks)
