"""The k largest sums of products by upper bounds of blocks of rows.

Index rows are put in the order of their heaviest terms, so that rows of a
block are alike, and cut into cells of a few thousand rows and blocks of a few
dozen.  The largest weight that a term has in a cell, or in a block, bounds what
any of its rows can score.  A query is scored in the cell of its highest bound
first; the k-th score found there is the threshold that the bounds of all other
cells, and of the blocks in them, must reach for their rows to be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.operators.cells import cell_join
from linkforge.operators.scratch import Tables

CELL_ROWS, BLOCK_ROWS = 2048, 32
#: Scores are compared with six places.
PLACES = 1e-6


@dataclass
class TopProducts:
    """``rows``: (orig_idxs, match_idxs, score); ``scored``: (orig_idxs, scored) of each query and cell; ``all_pairs``: what scoring every row takes."""

    rows: DataFrame
    scored: DataFrame
    all_pairs: int

    def share(self) -> float:
        """Rows scored by rows there are, over all queries."""
        return (self.scored.agg(F.sum("scored")).first()[0] or 0) / max(1, self.all_pairs)


def _grouped(weights: DataFrame) -> DataFrame:
    """(id, terms, weights), the heaviest first; terms go by 64-bit hashes."""
    pairs = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("weight").cast("double").alias("w"), F.xxhash64("term").alias("t"))), False).alias("x"))
    return pairs.select("id", F.col("x.t").alias("terms"), F.col("x.w").alias("weights"))


def _lists(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's terms begin and the last ones end, the terms and the weights."""
    terms = rows["terms"].combine_chunks()
    return np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64), terms.flatten().to_numpy(), rows["weights"].combine_chunks().flatten().to_numpy()


def _ranges(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several ranges, one after another, and how many each has."""
    sizes = ends - begins
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), sizes


class Cell:
    """The rows of a cell with their lists by term and the bounds of its blocks."""

    def __init__(self, held: pa.Table, block_rows: int):
        terms = held["terms"].combine_chunks()
        heaviest = [terms.take(pa.array(range(len(held)))).flatten().to_numpy()[terms.offsets.to_numpy()[:-1] - terms.offsets.to_numpy()[0]]]
        held = held.take(pa.array(np.lexsort((held["id"].to_numpy(), *heaviest))))
        self.ids = held["id"].to_numpy()
        self.starts, terms, self.weights = _lists(held)
        self.known, self.term = np.unique(terms, return_inverse=True)
        self.block_rows, self.first_row = block_rows, np.arange(0, len(self.ids), block_rows)
        block = np.repeat(np.arange(len(self.ids)) // block_rows, np.diff(self.starts))
        order = np.lexsort((block, self.term))
        t, b, w = self.term[order], block[order], self.weights[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (b[1:] != b[:-1])]))
        #: For each term its blocks and the largest weight it has in each.
        self.most, self.in_block = np.maximum.reduceat(w, new), b[new]
        self.lists = np.searchsorted(t[new], np.arange(len(self.known) + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no row of each block exceeds; negative where none shares a term."""
        at, sizes = _ranges(self.lists[terms], self.lists[terms + 1])
        block = self.in_block[at]
        out = np.bincount(block, np.repeat(weights, sizes) * self.most[at], len(self.first_row))
        return np.where(np.bincount(block, minlength=len(self.first_row)) > 0, out, -1.0)

    def scores(self, blocks: np.ndarray, of_query: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of some blocks that share a term with the query, and their scores with six places."""
        begin = self.first_row[blocks]
        rows, _ = _ranges(begin, np.minimum(begin + self.block_rows, len(self.ids)))
        at, sizes = _ranges(self.starts[rows], self.starts[rows + 1])
        begin, term = np.cumsum(sizes) - sizes, self.term[at]
        total = np.add.reduceat(of_query[term] * self.weights[at], begin)
        some = np.logical_or.reduceat(shared[term], begin)
        return rows[some], np.round(total[some], 6)


def _best(cell: Cell, terms: np.ndarray, weights: np.ndarray, k: int, threshold: float, leave: object) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows, scores, rows scored: the k best of a cell for one query, block by block from the highest bound until it falls below the k-th score."""
    of_query, shared = np.zeros(len(cell.known)), np.zeros(len(cell.known), bool)
    of_query[terms], shared[terms] = weights, True
    bounds = cell.bounds(terms, weights)
    order = np.argsort(-bounds, kind="stable")
    rows, scores, scored, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 0, 2
    while at < len(order):
        # as many blocks as may still hold one of the k best, a few at first
        ahead = order[at : at + step]
        ahead = ahead[(bounds[ahead] >= threshold - PLACES) & (bounds[ahead] >= 0)]
        if not len(ahead):
            break
        more, s = cell.scores(ahead, of_query, shared)
        scored += int(np.minimum(cell.first_row[ahead] + cell.block_rows, len(cell.ids)).sum() - cell.first_row[ahead].sum())
        if leave is not None:
            other = cell.ids[more] != leave
            more, s = more[other], s[other]
        rows, scores = np.concatenate([rows, more]), np.concatenate([scores, s])
        if len(rows) > k:
            best = np.lexsort((cell.ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
        if len(rows) == k:
            threshold = max(threshold, float(scores.min()))
        at, step = at + step, step * 4
    return rows, scores, scored


def top_products(queries: DataFrame, index: DataFrame, k: int, others: bool, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> TopProducts:
    """For each query the k index rows of the largest sums of products of weights, ties by id; both tables have (id, term, weight).

    Weights must not be negative.  With ``others`` a row isn't its own match.
    Rows without a common term are no match; rows that a query's k-th score
    rules out are not scored, and no other is left out.
    """
    spark = index.sparkSession
    tables = Tables(spark)
    asked, held = tables.written(_grouped(queries)), _grouped(index)
    kinds = dict(asked.dtypes)["id"], dict(held.dtypes)["id"]
    # in the order of the heaviest terms; rows of the same order go by id, so a term that very many have is many cells
    n, spot = index.select("id").distinct().count(), [F.element_at("terms", 1), F.try_element_at("terms", F.lit(2)), F.col("id")]
    ordered = held.withColumns({f"_o{i}": c for i, c in enumerate(spot)})
    ordered = ordered.repartitionByRange(max(1, -(-n // (16 * cell_rows))), "_o0", "_o1", "_o2").sortWithinPartitions("_o0", "_o1", "_o2")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            cell = part * 1_000_000 + (at + np.arange(len(batch))) // cell_rows
            at += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *[batch.column(c) for c in ("id", "terms", "weights")]], ["cell", "id", "terms", "weights"])

    filed = tables.written(ordered.select("id", "terms", "weights").mapInArrow(numbered, f"cell long, id {kinds[1]}, terms array<long>, weights array<double>"))
    each = lambda df, *keep: df.select(*keep, F.explode(F.arrays_zip("terms", "weights")).alias("_e")).select(*keep, F.col("_e.terms").alias("term"), F.col("_e.weights").alias("w"))
    most = each(filed, "cell").groupBy("cell", "term").agg(F.max("w").alias("most"), F.min("w").alias("_low"))
    low = most.agg(F.min("_low")).first()[0], queries.agg(F.min("weight")).first()[0]
    if min(x for x in (*low, 0.0) if x is not None) < 0:
        raise ValueError("bounds need weights that aren't negative")
    bounds = tables.written(each(asked, "id").join(most, "term").groupBy("id", "cell").agg(F.sum(F.col("w") * F.col("most")).alias("bound")))
    highest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("bound"), "cell"))
    first = bounds.withColumn("_n", highest).filter(F.col("_n") == 1).select("id", "cell")
    schema = f"orig_idxs {kinds[0]}, match_idxs {kinds[1]}, score double, scored long"

    def f(want: pa.Table, rows: pa.Table) -> pa.Table:
        left, right, score, count = [], [], [], []
        if len(want) and len(rows):
            cell = Cell(rows, block_rows)
            starts, terms, weights = _lists(want)
            place = np.minimum(np.searchsorted(cell.known, terms), len(cell.known) - 1)
            met, ids, low = cell.known[place] == terms, want["id"].to_pylist(), want["threshold"].to_numpy()
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                some = met[a:b]
                rows_, s, n = _best(cell, place[a:b][some], weights[a:b][some], k, low[i], ids[i] if others else None)
                left.append(np.full(len(rows_) + 1, i))
                # the first row of each query holds how many were scored, and no match
                right.append(np.append(-1, rows_))
                score.append(np.append(0.0, s))
                count.append(np.append(n, np.zeros(len(rows_), np.int64)))
        none = np.zeros(0, np.int64)
        left, right = np.concatenate([none, *left]), np.concatenate([none, *right])
        match = pa.array(cell.ids[np.maximum(right, 0)], mask=right < 0) if len(right) else pa.array([], rows["id"].type)
        return pa.Table.from_arrays([want["id"].combine_chunks().take(pa.array(left)), match.cast(rows["id"].type), pa.array(np.concatenate([np.zeros(0), *score])), pa.array(np.concatenate([none, *count]).astype(np.int64))], ["orig_idxs", "match_idxs", "score", "scored"])

    def scored(pairs: DataFrame) -> DataFrame:
        return tables.written(cell_join(pairs.join(asked, "id").select("cell", "id", "terms", "weights", "threshold"), filed, f, schema))

    rank = F.row_number().over(Window.partitionBy("orig_idxs").orderBy(F.desc("score"), "match_idxs"))
    best = lambda df: df.filter("match_idxs is not null").withColumn("_r", rank).filter(F.col("_r") <= k).select("orig_idxs", "match_idxs", "score")
    begun = scored(first.withColumn("threshold", F.lit(float("-inf"))))
    reached = best(begun).groupBy(F.col("orig_idxs").alias("id")).agg(F.min("score").alias("_s"), F.count("*").alias("_c")).select("id", F.when(F.col("_c") >= k, F.col("_s")).alias("threshold"))
    rest = bounds.join(first.withColumn("_first", F.lit(True)), ["id", "cell"], "left").filter("_first is null").join(reached, "id", "left")
    rest = rest.select("id", "cell", "bound", F.coalesce("threshold", F.lit(float("-inf"))).alias("threshold")).filter(F.col("bound") >= F.col("threshold") - PLACES)
    found = begun.unionByName(scored(rest.drop("bound")))
    return TopProducts(best(found), found.filter("match_idxs is null").select("orig_idxs", "scored"), n * asked.count())
