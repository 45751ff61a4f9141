"""Text datasets in the forms that corpora come in, as (source, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS = ("lines", "paragraphs", "files", "jsonl", "csv", "parquet")


def read_texts(spark: SparkSession, path: str | list[str], form: str = "lines", text_col: str = "text", keep_empty: bool = False) -> DataFrame:
    """(source, text) of plain files by line, by paragraph (empty lines part them) or whole, or of a column of JSON lines, CSV with a header or Parquet.

    Files may be compressed and may lie wherever Spark reads; lines, JSON, CSV
    and Parquet are split among tasks, a file that is read whole or by
    paragraphs is one task's.  ``source`` is the file.  Texts that are null or
    blank are left out unless ``keep_empty``.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form {form}")
    if form in ("lines", "paragraphs", "files"):
        rows = spark.read.text(path, wholetext=form != "lines").select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
        if form == "paragraphs":
            rows = rows.select("source", F.explode(F.split("text", r"\r?\n[ \t]*\r?\n\s*")).alias("text"))
    else:
        read = {"jsonl": lambda: spark.read.schema(f"`{text_col}` string").json(path), "csv": lambda: spark.read.csv(path, header=True, multiLine=True, escape='"'), "parquet": lambda: spark.read.parquet(*([path] if isinstance(path, str) else path))}[form]()
        rows = read.select(F.col("_metadata.file_path").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows if keep_empty else rows.filter(F.length(F.trim("text")) > 0)


def with_ids(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with a column ``id`` in an order of their columns, from 0 and without gaps, the same on every run where the order is of distinct rows."""
    from linkforge.operators.corpus import numbered

    return numbered(rows, [F.col(c) if isinstance(c, str) else c for c in order or ("source", "text")], "id")
