"""Exact nearest neighbours that leave out cells the triangle inequality rules out.

Index rows are filed under the nearest of a set of pivots, with their distance
to it.  A query is compared with its own cell first; the k-th distance found
there bounds what it is looking for, and of the other cells only those go on
whose rows can be as near: by the ring of distances around their pivot, or by
the plane between their pivot and the query's.  Small cells that lie together
are sent as one block, to which a query goes once, so where nothing can be left
out no more is moved than by comparing all with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.operators.cells import block_of_cells, cell_join, file_by_cell, finite, nearest_of, rows_of, slices, squares
from linkforge.operators.knn import _prepared, block_neighbours, kmeans, merged
from linkforge.operators.scratch import Tables

#: Most pivots, and rows that they are fitted on.
PIVOTS, SAMPLE = 1024, 20_000
#: From this share of a block's pairs on it is compared whole.
WHOLE_SHARE = 0.3
#: Queries whose bounds to all cells a task has in memory at a time.
BOUNDED_ROWS = 512


@dataclass
class PrunedNeighbours:
    """``rows``: (orig_idxs, match_idxs, distance); ``compared``: (pairs) of each query and block looked into; ``all_pairs``: what a join without pruning compares."""

    rows: DataFrame
    compared: DataFrame
    all_pairs: int

    def share(self) -> float:
        """Pairs compared by pairs there are."""
        return (self.compared.agg(F.sum("pairs")).first()[0] or 0) / max(1, self.all_pairs)


def pruned_neighbours(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq", pivots: int | None = None, seed: int = 0) -> PrunedNeighbours:
    """The k nearest index rows (id, vector) of each query (id, vector), the same as ``exact_knn`` gives, ties by id.

    As many pivots as the root of the rows, 1024 at most, are fitted on a sample
    of 20,000 rows at most; which they are changes what is compared, not what is
    found.  Vectors must have one length.  Rows without a vector, or with one that
    holds a null or a component that isn't finite, are left out.
    """
    spark = index.sparkSession
    tables = Tables(spark)
    index, queries = (finite(df.select("id", "vector")) for df in (index, queries))
    kinds = dict(queries.dtypes)["id"], dict(index.dtypes)["id"]
    schema = f"orig_idxs {kinds[0]}, match_idxs {kinds[1]}, distance double"
    n_rows, n_queries = index.count(), queries.count()
    sample = index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not len(sample):
        none = spark.createDataFrame([], schema)
        return PrunedNeighbours(none, spark.createDataFrame([], "pairs long"), 0)
    x = _prepared(rows_of(sample["vector"]), metric)
    centres = kmeans(x, min(len(x), pivots or max(1, min(PIVOTS, int(n_rows**0.5)))), seed=seed)

    def unit(df: DataFrame) -> DataFrame:
        """The vectors in the space in which the triangle inequality holds."""
        if metric != "cosine":
            return df
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
        return df.withColumn("_l", length).select("id", F.transform("vector", lambda c: c.cast("double") / F.greatest("_l", F.lit(1e-300))).alias("vector"))

    filed = tables.written(file_by_cell(unit(index), centres, 1))
    sent = spark.sparkContext.broadcast(centres)

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cell").to_numpy()
            d = np.sqrt(((rows_of(batch.column("vector")) - sent.value[own]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(d)], ["cell", "d"])

    rings = {r["cell"]: r for r in filed.select("cell", "vector").mapInArrow(away, "cell int, d double").groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most")).collect()}
    cells = np.array(sorted(rings))
    count, least, most = (np.array([rings[c][name] for c in cells], float) for name in ("n", "least", "most"))
    block = block_of_cells(centres[cells], count)
    held = spark.sparkContext.broadcast((cells, centres[cells], count, least, most, block))
    full = np.flatnonzero(count >= k)
    # what is far less than six places at these lengths, for the digits that distances lose
    slack = 1e-9 * (1 + float(np.abs(centres).max()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest cell that has k rows, or the nearest."""
        own_cells, own_centres = held.value[:2]
        for batch in slices(batches, len(own_centres)):
            if len(batch):
                d = squares(rows_of(batch.column("vector")), own_centres)
                some = full if len(full) else np.arange(len(own_cells))
                yield pa.RecordBatch.from_arrays([pa.array(own_cells[some[d[:, some].argmin(axis=1)]].astype(np.int32)), batch.column("id"), batch.column("vector")], ["cell", "id", "vector"])

    asked = tables.written(unit(queries).mapInArrow(first, f"cell int, id {kinds[0]}, vector {dict(unit(queries).dtypes)['vector']}"))
    compare = lambda q, rows: block_neighbours(q, rows, k, metric)
    home = tables.written(merged(cell_join(asked, filed, compare, schema), k))
    bound = home.groupBy("orig_idxs").agg(F.max("distance").alias("bound"), F.count("*").alias("_n"))
    bounded = asked.join(bound, asked["id"] == bound["orig_idxs"], "left").select("cell", "id", "vector", F.when(F.col("_n") >= k, F.col("bound")).alias("bound"))

    def lowest(q: np.ndarray, some: np.ndarray) -> np.ndarray:
        """What no row of some cells is nearer to each query than."""
        _, own_centres, _, inner, outer, _ = held.value
        square = squares(q, own_centres)
        d = np.sqrt(square[:, some])
        nearest = square.argmin(axis=1)
        apart = np.sqrt(squares(own_centres[nearest], own_centres[some]))
        plane = np.where(apart > 0, (square[:, some] - np.take_along_axis(square, nearest[:, None], axis=1)) / np.maximum(2 * apart, 1e-300), 0)
        return np.maximum(np.maximum(d - outer[some], inner[some] - d), plane) - slack - 1e-7 * d

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cells, own_centres, own_count, inner, outer, block = held.value
        blocks = np.unique(block)
        by_block = np.argsort(block, kind="stable")
        starts = np.searchsorted(block[by_block], blocks)
        for batch in batches:
            for a in range(0, len(batch), BOUNDED_ROWS):
                part = batch.slice(a, BOUNDED_ROWS)
                q, home_cell = rows_of(part.column("vector")), part.column("cell").to_numpy()
                d = np.sqrt(squares(q, own_centres))
                bound = part.column("bound").to_numpy(zero_copy_only=False).astype(float)
                # a rounded distance, made one that none as near goes beyond
                square_bound = (bound + 2e-6) ** 2 if metric == "l2" else (bound + 2e-6) * (2 if metric == "cosine" else 1)
                reach = np.sqrt(square_bound)
                for r in np.flatnonzero(np.isnan(bound)):  # k rows of the nearest cells are no farther than their rings' outer ends
                    order = np.argsort(d[r] + outer)
                    enough = int(np.searchsorted(np.cumsum(own_count[order]), k))
                    reach[r] = np.inf if enough == len(order) else (d[r] + outer)[order[enough]] + 1e-6
                open_ = (lowest(q, np.arange(len(own_cells))) <= reach[:, None]) & (own_cells[None, :] != home_cell[:, None])
                pairs = np.add.reduceat((open_ * own_count)[:, by_block], starts, axis=1)
                row, at = np.nonzero(pairs)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(blocks[at].astype(np.int32)), part.column("id").take(of), part.column("vector").take(of), part.column("cell").take(of), pa.array(reach[row]), part.column("bound").take(of), pa.array(pairs[row, at].astype(np.int64))], ["cell", "id", "vector", "home", "reach", "bound", "pairs"])

    def nearer(found: pa.Table, asked: pa.Table) -> pa.Table:
        """Without the rows that are farther than the k-th known already."""
        bound = asked["bound"].take(pc.index_in(found["orig_idxs"], asked["id"])).combine_chunks()
        return found.filter(pc.fill_null(pc.less_equal(found["distance"].combine_chunks(), bound), True))

    def in_block(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The rows of each cell of a block for the queries that they can be near to; the whole block if that is most of it."""
        if not len(asked) or not len(rows):
            return compare(asked, rows)
        own_cells = held.value[0]
        here, q = np.unique(rows["own"].to_numpy()), rows_of(asked["vector"])
        some, reach = np.searchsorted(own_cells, here), asked["reach"].to_numpy()
        open_ = np.concatenate([lowest(q[a : a + BOUNDED_ROWS], some) <= reach[a : a + BOUNDED_ROWS, None] for a in range(0, len(q), BOUNDED_ROWS)])
        open_ &= here[None, :] != asked["home"].to_numpy()[:, None]
        if open_.mean() > WHOLE_SHARE:
            return nearer(compare(asked, rows), asked)
        out = [compare(asked.filter(pa.array(open_[:, j])), rows.filter(pa.array(rows["own"].to_numpy() == c))) for j, c in enumerate(here.tolist()) if open_[:, j].any()]
        if not out:
            return compare(asked.slice(0, 0), rows)
        return nearest_of(nearer(pa.concat_tables(out), asked), k)

    blocks_of = F.broadcast(spark.createDataFrame([(int(c), int(g)) for c, g in zip(cells, block)], "own int, block int"))
    in_blocks = filed.withColumnRenamed("cell", "own").join(blocks_of, "own").select(F.col("block").alias("cell"), "id", "vector", "own")
    rest = tables.written(bounded.mapInArrow(further, f"cell int, id {kinds[0]}, vector {dict(asked.dtypes)['vector']}, home int, reach double, bound double, pairs long"))
    # a block compared whole gives a query's own cell again
    found = home.unionByName(cell_join(rest, in_blocks, in_block, schema)).distinct()
    per = filed.groupBy("cell").agg(F.count("*").alias("pairs"))
    compared = asked.select("cell").join(F.broadcast(per), "cell").select("pairs").unionByName(rest.select("pairs"))
    return PrunedNeighbours(merged(found, k), compared, n_rows * n_queries)


def pruned_knn(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq", pivots: int | None = None) -> DataFrame:
    return pruned_neighbours(index, queries, k, metric, pivots).rows
