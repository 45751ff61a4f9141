"""Addresses from GeoJSON features."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions.text import parse_filename

#: Files without numbers or streets that warnings name.
NAMED = 100
_SCHEMA = "features array<struct<properties: struct<number: string, street: string>>>"


def read_addresses(spark: SparkSession, directory: str | None = None, filename: str | None = None, recursive: bool = False) -> DataFrame:
    """(location, address) of the features in a file or a folder's ``*.geojson`` files.

    An address is number and street; a missing number reads None, a missing
    street makes the address null.  Files in which no feature has a number or
    none has a street are skipped, the first hundred with a warning.
    """
    if (directory is None) == (filename is None):
        raise ValueError("give either a directory or a filename")
    reader = spark.read.schema(_SCHEMA).option("multiLine", True)
    if directory is not None:
        reader = reader.option("pathGlobFilter", "*.geojson").option("recursiveFileLookup", recursive)
    return _addresses(reader.json(directory or filename).select(F.col("_metadata.file_path").alias("path"), "features"))


def parse_addresses(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The same from a table of GeoJSON texts and their paths."""
    return _addresses(files.select(F.col(path_col).alias("path"), F.from_json(content_col, _SCHEMA)["features"].alias("features")))


def _addresses(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.explode("features").alias("f")).select("path", "f.properties.number", "f.properties.street")
    seen = rows.groupBy(F.col("path").alias("p")).agg(F.count("number").alias("n"), F.count("street").alias("s"))
    poor = seen.filter("n = 0 or s = 0")
    for r in poor.orderBy("p").limit(NAMED).collect():
        logging.warning("%s has no number or street", r["p"])
    kept = rows.join(poor.select("p"), F.col("path") == F.col("p"), "left_anti")
    address = F.concat(F.coalesce("number", F.lit("None")), F.lit(" "), F.col("street"))
    return kept.select(parse_filename(F.col("path")).alias("location"), address.alias("address"))


def write_addresses(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
