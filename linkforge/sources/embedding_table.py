"""Embeddings of byte tokens of pretrained models, as tables (token_id, vec)."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ModelSize(Enum):
    """Sizes in which the model is published."""

    SMALL = "small"
    BASE = "base"
    LARGE = "large"
    XLARGE = "xl"


def read_embedding_table(spark: SparkSession, folder: str, size: ModelSize | str = ModelSize.BASE) -> DataFrame:
    """(token_id, vec) of a size, from a folder that has a Parquet table for each."""
    return spark.read.parquet(f"{folder}/{ModelSize(size).value}").select(F.col("token_id").cast("int").alias("token_id"), F.col("vec").cast("array<float>").alias("vec"))


def write_embedding_table(table: DataFrame, folder: str, size: ModelSize | str = ModelSize.BASE) -> None:
    table.select("token_id", "vec").write.mode("overwrite").parquet(f"{folder}/{ModelSize(size).value}")
