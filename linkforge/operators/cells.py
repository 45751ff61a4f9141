"""Rows filed under cells of space, and joins of queries and rows that share a cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of either side of a cell that one task compares.
BLOCK_ROWS = 8192
#: Rows that a block's cells find before each query's nearest are kept.
FOUND_ROWS = 2_000_000
#: From this share of a block's cells on that queries look into, they are compared with the whole block.
WHOLE_SHARE = 0.2


def rows_of(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def finite(df: DataFrame) -> DataFrame:
    """Rows with a vector all of whose components are numbers and finite."""
    return df.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))


def lists_of(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of a matrix's rows."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), kind))


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, as near as the expanded form gets."""
    return np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1))


#: Distances to centres that a task has in memory at a time.
CENTRE_DISTANCES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], centres: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows as keep the table of their distances to the centres small, however many centres there are."""
    step = max(1, CENTRE_DISTANCES // max(1, centres))
    for batch in batches:
        for a in range(0, len(batch), step):
            yield batch.slice(a, step)


def file_by_cell(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(cell, id, vector) of (id, vector): a row for each of the nearest centres."""
    sent, kinds = df.sparkSession.sparkContext.broadcast(centres), dict(df.dtypes)
    m = min(probes, len(centres))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(sent.value)):
            if len(batch):
                d = squares(rows_of(batch.column("vector")), sent.value)
                near = np.argpartition(d, m - 1, axis=1)[:, :m].astype(np.int32)
                of = pa.array(np.repeat(np.arange(len(batch)), m))
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1)), batch.column("id").take(of), batch.column("vector").take(of)], ["cell", "id", "vector"])

    return df.select("id", "vector").mapInArrow(f, f"cell int, id {kinds['id']}, vector {kinds['vector']}")


def cell_join(queries: DataFrame, index: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``f`` of the queries and the index rows of each cell, by the columns ``cell`` and ``id``.

    A cell that either side fills is dealt into blocks of about ``block_rows``,
    each of which meets each of the other side's in a task of its own, so a cell
    with a third of all rows is many tasks.  Only the cells' sizes are broadcast,
    a row for each cell, and cells are bounded by whoever fitted them.
    """
    size = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    sizes = F.broadcast(size(queries, "_nq").join(size(index, "_ni"), "cell"))

    def dealt(df: DataFrame, own: str, n: str, other: str, m: str) -> DataFrame:
        return df.join(sizes, "cell").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_nq", "_ni")

    left, right = dealt(queries.toDF(*queries.columns), "_q", "_nq", "_i", "_ni"), dealt(index.toDF(*index.columns), "_i", "_ni", "_q", "_nq")
    return left.groupBy("cell", "_q", "_i").cogroup(right.groupBy("cell", "_q", "_i")).applyInArrow(f, schema)


def block_of_cells(centres: np.ndarray, count: np.ndarray, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """A block for each cell: cells along the direction in which their centres differ most, cut by their rows."""
    axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    order = np.argsort(centres @ axis, kind="stable")
    block = np.empty(len(centres), np.int64)
    block[order] = (np.cumsum(count[order]) - count[order]) // block_rows
    return block


def probe_join(queries: DataFrame, filed: DataFrame, centres: np.ndarray, probes: int, f: Callable[[pa.Table, pa.Table, int], pa.Table], schema: str, keep: int, block_rows: int = BLOCK_ROWS, any_cell: bool = False, last: Callable[[pa.Table, pa.Table, pa.Table], pa.Table] | None = None) -> DataFrame:
    """``f`` of queries (id, vector) and the rows of each of their nearest cells, from ``filed`` (cell, id, ...).

    Small cells that lie together are one block, to which a query goes once
    with the cells it looks into, so what is moved grows with the blocks and
    not with the cells.  Of what ``f`` returns (orig_idxs, match_idxs,
    distance) a block sends each query's ``keep`` nearest on.  With ``any_cell``
    ``f`` takes rows of any cells together: queries that look into much of a
    block meet all of it at once, which finds no less and costs less than many
    small comparisons, and go without a list of its cells.  ``last`` of some
    queries, the block's rows and what is kept of their finds is sent on instead.
    """
    spark, kinds, m = queries.sparkSession, dict(queries.dtypes), min(probes, len(centres))
    count = np.zeros(len(centres), np.int64)
    for r in filed.groupBy("cell").count().collect():
        count[r["cell"]] = r["count"]
    block = block_of_cells(centres, count, block_rows)
    sent = spark.sparkContext.broadcast((centres, block, np.bincount(block[count > 0], minlength=block.max() + 1)))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_centres, own_block, filled = sent.value
        for batch in slices(batches, len(own_centres)):
            if len(batch):
                d = squares(rows_of(batch.column("vector")), own_centres)
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                row, cell = np.repeat(np.arange(len(batch)), m), near.reshape(-1)
                order = np.lexsort((cell, own_block[cell], row))
                row, cell = row[order], cell[order]
                at = own_block[cell]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])))
                length = np.diff(np.append(first, len(row)))
                if any_cell:
                    # an empty list stands for all cells
                    listed = length <= WHOLE_SHARE * filled[at[first]]
                    cell, length = cell[np.repeat(listed, length)], length * listed
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(cell.astype(np.int32)))
                of = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), batch.column("id").take(of), batch.column("vector").take(of), lists], ["cell", "id", "vector", "cells"])

    asked = queries.select("id", "vector").mapInArrow(probed, f"cell int, id {kinds['id']}, vector {kinds['vector']}, cells array<int>")
    blocks = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(block)], "own int, _block int"))
    held = filed.withColumnRenamed("cell", "own").join(blocks, "own").withColumnRenamed("_block", "cell")

    def g(some: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(some) or not len(rows):
            return f(some, rows, 0)
        out = [f(some.slice(0, 0), rows, 0)]
        then = (lambda part, found: found) if last is None else lambda part, found: last(part, rows, found)
        if any_cell:
            length = some["cells"].combine_chunks().value_lengths().to_numpy()
            whole, some = some.filter(pa.array(length == 0)).drop_columns(["cells"]), some.filter(pa.array(length > 0))
            step = max(1, FOUND_ROWS // keep)
            out += [then(part, f(part, rows, 0)) for a in range(0, len(whole), step) for part in [whole.slice(a, step)]]
            if not len(some):
                return pa.concat_tables(out)
        own = rows["own"].to_numpy()
        of_cell = {c: rows.filter(pa.array(own == c)) for c in np.unique(own).tolist()}
        # so many queries at a time as keep what the cells find for them bounded
        step = max(1, FOUND_ROWS // (keep * int(some["cells"].combine_chunks().value_lengths().to_numpy().max())))
        for a in range(0, len(some), step):
            part = some.slice(a, step).combine_chunks()
            lists = part["cells"].combine_chunks()
            query, cell = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            found = [f(part.take(pa.array(query[cell == c])), held, c) for c, held in of_cell.items() if (cell == c).any()]
            if found:
                out.append(then(part, nearest_of(pa.concat_tables(found), keep)))
        return pa.concat_tables(out)

    return cell_join(asked, held, g, schema, block_rows)


def nearest_of(found: pa.Table, k: int) -> pa.Table:
    """The k rows of least distance of each query, ties by match."""
    found = found.sort_by([("orig_idxs", "ascending"), ("distance", "ascending"), ("match_idxs", "ascending")])
    if not len(found):
        return found
    of = found["orig_idxs"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return found.filter(pa.array(np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) < k))
