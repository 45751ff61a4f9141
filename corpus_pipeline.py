"""A corpus for pre-training from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it
kept, and returns a DataFrame; ``run`` writes each as Parquet in the shared
folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import decontam, ngram_join, packing, quality, substring
from linkforge.llm.common import Scratch, small_batches
from linkforge.llm.queries import tokenizer_path


#: Parts of texts that an encoder of the last stage remembers: few, since its workers hold what the stages before left too.
REMEMBERED_PARTS = 30_000
#: Bytes of an Arrow batch: texts of one length stand together after packing, so a batch by rows alone may hold the longest.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and by bytes; settings of the caller's stay."""
    small_batches(spark)
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "67108864")
    if spark.conf.get(key, default[0]) in default:
        spark.conf.set(key, str(BATCH_BYTES))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.

    Rows are judged one by one: null and empty texts by the score of an empty
    passage, repeated rows and null ids each by their own text.  Without labels
    of both kinds nothing is dropped; an empty table stays empty.
    """
    bounded_batches(spark)
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id.

    Null and empty texts have no copies and stay; so do rows without an id; of
    rows that repeat an id all stay if it is a group's smallest.
    """
    bounded_batches(spark)
    return ngram_join.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 50 words or more that a document with a smaller id has; n_chars follows the text.

    A document that loses all its words goes.  Null and empty texts and rows
    without an id stay as they are; rows that repeat an id are no reference for
    each other.
    """
    bounded_batches(spark)
    out = substring.cut_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item.

    Null and empty texts contain none and stay; rows are judged one by one,
    with an id or without; an empty benchmark drops nothing.
    """
    bounded_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left, with the text: doc_id, n_tokens, bucket, width, batch, slot, text.

    Null and empty texts have their end id alone; equal lengths go by id, rows
    alike in both by a hash; every row is in one batch.
    """
    bounded_batches(spark)
    return packing.pack_texts(docs, tokenizer_path(), with_text=True, remember=REMEMBERED_PARTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: The learnt classifier and the dynamic programme aren't expressible in SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents of a folder."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.cut(docs)
    return docs
