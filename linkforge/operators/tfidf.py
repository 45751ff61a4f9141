"""TF-IDF over character n-grams, cosine neighbours and BM25, as tables of (id, term, weight)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions.text import char_ngrams
from linkforge.operators.grid import grid


def term_counts(df: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(id, term, tf)"""
    each = df.select(F.col(id_col).alias("id"), F.explode(char_ngrams(F.col(text_col), sizes)).alias("term"))
    return each.groupBy("id", "term").agg(F.count("*").alias("tf"))


@dataclass
class TfidfModel:
    """``idf``: (term, df, idf); ``n``: rows fitted."""

    idf: DataFrame
    n: int
    sizes: tuple[int, ...]

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, term, weight) with rows of length 1; terms not fitted are left out."""
        raw = term_counts(df, id_col, text_col, self.sizes).join(self.idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
        return raw.select("id", "term", (F.col("w") / length).alias("weight"))


def fit(df: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (2, 3)) -> TfidfModel:
    """idf = ln((1 + N) / (1 + df)) + 1"""
    n = df.count()
    counts = term_counts(df, id_col, text_col, sizes).groupBy("term").agg(F.count("*").alias("df"))
    return TfidfModel(counts.withColumn("idf", F.log((1.0 + n) / (1 + F.col("df"))) + 1), n, sizes)


def top_k(scored: DataFrame, query: str, k: int, order: list) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("rank") <= k)


#: Rows of a block of the index, with about a hundred terms each.
BLOCK_ROWS = 20_000


def _rows(weights: DataFrame) -> DataFrame:
    """(id, terms, weights) of (id, term, weight); terms go by 64-bit hashes."""
    pairs = weights.groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("weight").cast("double").alias("w"))).alias("x"))
    return pairs.select("id", F.col("x.t").alias("terms"), F.col("x.w").alias("weights"))


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the rows, and the terms and weights of all."""
    terms, weights = rows["terms"].combine_chunks(), rows["weights"].combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64)
    return bounds, terms.flatten().to_numpy(), weights.flatten().to_numpy()


def products_top_k(queries: DataFrame, index: DataFrame, k: int, others: bool, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(orig_idxs, match_idxs, name): for each query the k index rows of the largest sums of products of weights, ties by id.

    Both tables have (id, term, weight).  Blocks of queries meet blocks of the
    index; a block keeps its lists of rows by term, so a query costs what its
    terms' lists hold, and sends each query's k best on.  With ``others`` a row
    isn't its own match.  Rows without a common term are no match.
    """

    def f(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, own = held["id"].combine_chunks(), asked["id"].combine_chunks()
        left, right, score = [], [], []
        if len(asked) and len(held):
            bounds, terms, weights = _flat(held)
            row = np.repeat(np.arange(len(ids)), np.diff(bounds))
            order = np.argsort(terms, kind="stable")
            known, first = np.unique(terms[order], return_index=True)
            first = np.append(first, len(order))
            row, weights = row[order], weights[order]
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            place = pc.index_in(own, ids).fill_null(-1).to_numpy() if others else None
            bounds, terms, wanted = _flat(asked)
            at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
            met = known[at] == terms
            for i in range(len(own)):
                total, some = np.zeros(len(ids)), np.zeros(len(ids), bool)
                for j in range(bounds[i], bounds[i + 1]):
                    if met[j]:
                        a, b = first[at[j]], first[at[j] + 1]
                        total[row[a:b]] += wanted[j] * weights[a:b]
                        some[row[a:b]] = True
                if others and place[i] >= 0:
                    some[place[i]] = False
                found = np.flatnonzero(some)
                s = np.round(total[found], 6)
                if len(found) > k:
                    near = s >= np.partition(s, len(s) - k)[len(s) - k]
                    found, s = found[near], s[near]
                best = np.lexsort((rank[found], -s))[:k]
                left.append(np.full(len(best), i))
                right.append(found[best])
                score.append(s[best])
        none = np.zeros(0, np.int64)
        left, right = (pa.array(np.concatenate([none, *x]).astype(np.int64)) for x in (left, right))
        return pa.Table.from_arrays([own.take(left), ids.take(right), pa.array(np.concatenate([np.zeros(0), *score]))], ["orig_idxs", "match_idxs", name])

    queries, index = _rows(queries), _rows(index)
    best = grid(queries, index, f, f"orig_idxs {dict(queries.dtypes)['id']}, match_idxs {dict(index.dtypes)['id']}, {name} double", block_rows)
    return top_k(best, "orig_idxs", k, [F.desc(name), "match_idxs"]).drop("rank")


def cosine_top_k(weights: DataFrame, k: int = 5) -> DataFrame:
    """(orig_idxs, match_idxs, similarity) of each row's k most similar others that share a term."""
    return products_top_k(weights, weights, k, True, "similarity")


def bm25_weights(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75, sizes: tuple[int, ...] = (2, 3, 4)) -> tuple[DataFrame, DataFrame]:
    """(id, term, weight) of queries and of the index, whose sums of products are BM25 scores over character n-grams."""
    tf = term_counts(index, id_col, text_col, sizes)
    length = tf.groupBy("id").agg(F.sum("tf").alias("len"))
    n, mean = length.agg(F.count("*"), F.avg("len")).first()
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    damped = tf.join(length, "id").join(idf, "term").select("id", "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))).alias("weight"))
    return term_counts(queries, query_id, query_text, sizes).select("id", "term", F.lit(1.0).alias("weight")), damped


def bm25_top_k(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int = 5, k1: float = 1.5, b: float = 0.75, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(orig_idxs, match_idxs, score) of each query's k best rows by BM25 over character n-grams."""
    asked, held = bm25_weights(index, queries, id_col, text_col, query_id, query_text, k1, b, sizes)
    return products_top_k(asked, held, k, False, "score")
