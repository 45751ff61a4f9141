"""Duplicate search in one call: from a table of strings to an edge list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions.chars import byte_ids
from linkforge.functions.strsim import jaro_winkler, similarity_vector
from linkforge.functions.vectors import normalize
from linkforge.operators import block_svd, corpus, svd, tfidf
from linkforge.operators.knn import edges, exact_knn
from linkforge.operators.minhash import lsh_match_lists
from linkforge.operators.neighbour_graph import nn_descent
from linkforge.operators.product_quantiser import ivf_pq_knn
from linkforge.operators.pruned_knn import pruned_knn
from linkforge.operators.scratch import written
from linkforge.operators.tfidf import bm25_top_k
from linkforge.operators.transformer import CharTransformer, embed_texts
from linkforge.plans.strategy import ANCHOR_PARTS, ANCHOR_SHAPE, VECTOR_PARTS, IvfShape


#: Terms up to which the decomposition's block stands on one machine; beyond, it is a table.
BLOCK_TERMS = 90_000


def compressed_vectors(df: DataFrame, id_col: str, text_col: str, dim: int | None = None) -> tuple[DataFrame, tfidf.TfidfModel, svd.SvdModel | block_svd.BlockSvd]:
    """(id, vector) by TF-IDF and SVD, and the models that embed further strings alike."""
    terms = tfidf.fit(df, id_col, text_col)
    weights = terms.transform(df, id_col, text_col)
    model = svd.fit(weights, dim) if terms.idf.count() <= BLOCK_TERMS else block_svd.fit_blocks(written(weights), dim)
    return model.transform(weights), terms, model


def dedupe_lsh(df: DataFrame, id_col: str, text_col: str, n: int = 128, threshold: float = 0.6) -> DataFrame:
    return lsh_match_lists(df, id_col, text_col, n, threshold)


def dedupe_knn(df: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """Exact neighbours; cells that the triangle inequality rules out are left out."""
    vectors = written(compressed_vectors(df, id_col, text_col, 64)[0])
    return edges(pruned_knn(vectors, vectors, k, "l2"))


def dedupe_approx_knn(df: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """Neighbours by NN-descent."""
    vectors = written(compressed_vectors(df, id_col, text_col, 64)[0])
    near = nn_descent(vectors, k).neighbours(k)
    return edges(near.withColumn("distance", F.round(F.sqrt("distance"), 6)))


def nearest(vectors: DataFrame, k: int, parts: int, shape: IvfShape | None = None, strategy: str = "exact") -> DataFrame:
    """Squared distances: exact however many rows there are, or from inverted lists of product codes where asked for (``pq``)."""
    if strategy not in ("exact", "pq"):
        raise ValueError(f"unknown strategy {strategy}")
    return exact_knn(vectors, vectors, k) if strategy == "exact" else ivf_pq_knn(vectors, vectors, k, parts, shape)


def dedupe_vectors(df: DataFrame, id_col: str, text_col: str, k: int = 5, strategy: str = "exact") -> DataFrame:
    """Squared distances of the vectors at full length."""
    return edges(nearest(written(compressed_vectors(df, id_col, text_col)[0]), k, VECTOR_PARTS, IvfShape(), strategy))


def anchor_vectors(df: DataFrame, id_col: str, text_col: str, anchors: int = 128, seed: int = 0, scorer: Callable[[str, str], float] = jaro_winkler) -> tuple[DataFrame, list[str]]:
    """(id, vector) of similarities to anchor strings drawn from the table."""
    chosen = [r["t"] for r in corpus.sample_rows(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null"), "i", anchors, seed).collect()]
    return df.select(F.col(id_col).alias("id"), similarity_vector(chosen, scorer)(F.col(text_col)).alias("vector")), chosen


def dedupe_anchors(df: DataFrame, id_col: str, text_col: str, cutoff: float = 0.1, k: int = 10, anchors: int = 128, seed: int = 0, strategy: str = "exact") -> DataFrame:
    """By similarities to anchors; a string like none of them has no matches."""
    # written before a filter on them, which would otherwise move below the comparisons and into what made the strings
    vectors = written(anchor_vectors(df, id_col, text_col, anchors, seed)[0])
    vectors = vectors.filter(F.exists("vector", lambda x: x > 0)).select("id", normalize(F.col("vector")).alias("vector"))
    return edges(nearest(vectors, k, ANCHOR_PARTS, ANCHOR_SHAPE, strategy), cutoff)


def byte_bag(df: DataFrame, id_col: str, text_col: str, table: DataFrame) -> DataFrame:
    """(id, vector): the mean of the embeddings (token_id, vec) of a text's byte ids."""
    tokens = df.select(F.col(id_col).alias("id"), F.explode(byte_ids(F.col(text_col))).alias("token_id")).groupBy("id", "token_id").agg(F.count("*").alias("n"))
    each = tokens.join(table, "token_id").select("id", "n", F.posexplode("vec").alias("p", "x"))
    mean = each.groupBy("id", "p").agg((F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n")).alias("m"))
    return mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("vector"))


def dedupe_embedded(df: DataFrame, id_col: str, text_col: str, embed: Callable[[DataFrame, str, str], DataFrame], k: int = 5, strategy: str = "exact") -> DataFrame:
    """With any embedder from (table, id column, text column) to (id, vector)."""
    return edges(nearest(written(embed(df, id_col, text_col)), k, VECTOR_PARTS, IvfShape(), strategy))


def dedupe_bm25(df: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    return bm25_top_k(df, df, id_col, text_col, id_col, text_col, k).filter("orig_idxs < match_idxs")


def dedupe_char_transformer(df: DataFrame, id_col: str, text_col: str, model: CharTransformer, k: int = 5) -> DataFrame:
    """By the mean embeddings of a character transformer."""
    return dedupe_embedded(df, id_col, text_col, lambda rows, i, t: embed_texts(rows, i, t, model), k)
