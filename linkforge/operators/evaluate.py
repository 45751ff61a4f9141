"""Precision and recall of edge lists against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def n_duplicates(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """One row, n_duplicates: the sum of count - 1 over labels."""
    return labels.groupBy(label_col).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def score_pairs(pairs: DataFrame, labels: DataFrame, id_col: str = "id", label_col: str = "label", match_labels: DataFrame | None = None) -> DataFrame:
    """Pairs with orig_label, match_label and is_match; a missing match has a null label and is none."""
    a = labels.select(F.col(id_col).alias("orig_idxs"), F.col(label_col).alias("orig_label"))
    b = (labels if match_labels is None else match_labels).select(F.col(id_col).alias("match_idxs"), F.col(label_col).alias("match_label"))
    out = pairs.join(a, "orig_idxs").join(b, "match_idxs", "left")
    return out.withColumn("is_match", F.coalesce((F.col("orig_label") == F.col("match_label")).cast("int"), F.lit(0)))


def dedupe_metrics(scored: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: pairs, matches, precision, recall (matches by duplicates, above 1 where a label has several pairs), pair_recall."""
    groups = labels.groupBy(label_col).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("n_duplicates"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("possible"))
    found = scored.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("is_match"), F.lit(0)).alias("matches"))
    ratio = lambda by: F.round(F.try_divide(F.col("matches").cast("double"), F.col(by).cast("double")), 6)
    return found.crossJoin(groups).select("pairs", "matches", ratio("pairs").alias("precision"), ratio("n_duplicates").alias("recall"), ratio("possible").alias("pair_recall"))


def search_metrics(scored: DataFrame) -> DataFrame:
    """One row: pairs, matches, precision, recall by queries."""
    found = scored.agg(F.count("match_idxs").alias("pairs"), F.coalesce(F.sum("is_match"), F.lit(0)).alias("matches"), F.countDistinct("orig_idxs").alias("queries"))
    ratio = lambda by: F.round(F.try_divide(F.col("matches").cast("double"), F.col(by).cast("double")), 6)
    return found.select("pairs", "matches", "queries", ratio("pairs").alias("precision"), ratio("queries").alias("recall"))


def write_metrics(metrics: DataFrame, path: str, **run: str | int | float) -> None:
    """Appends a table of metrics, with what the run was as columns, to a folder of Parquet files."""
    metrics.select(*[F.lit(v).alias(k) for k, v in sorted(run.items())], "*").write.mode("append").parquet(path)
