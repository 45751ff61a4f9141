"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def fold_of(value: object) -> int:
    return zlib.crc32(str(value).encode()) % FOLDS


def held_out(id_col: str) -> Column:
    """Fold 0 is held out; a row without an id is never learnt from and counts as held out."""
    return F.coalesce(fold(id_col) == 0, F.lit(True))


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, label) of the rows that may be learnt from: one a document, its label 0 or 1 and its fold not 0.

    A document labelled both ways counts as 1.
    """
    rows = labels.select(id_col, F.col(label).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(id_col))
    return rows.groupBy(id_col).agg(F.max("label").alias("label"))


def bounded_sample(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, those whose ids have the smallest hashes: the same on every run and spread over all rows."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(77)), F.col(id_col)).limit(most)


def null_text_as_empty(batch: pa.RecordBatch, name: str) -> pa.Array:
    return pc.fill_null(batch.column(name), "")
