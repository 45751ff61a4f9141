"""The operators' queries over the tables of a folder, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import alignment, decontam, embed_lattice, html, ngram_join, packing, pieces, quality, sharding, sstable, substring, toxicity, whitening
from linkforge.llm.common import small_batches
from linkforge.llm.sql import ORACLES

N_SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all benchmark items in all documents: doc_id, item_id, distance, first_word."""
    small_batches(spark)
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under near copies: doc_id, n_shingles, component_id."""
    small_batches(spark)
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the attention model: doc_id, held_out, score, predicted."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, _table(spark, sf_dir, "labels")))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of sizes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    shards = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), N_SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written and read back: doc_id, start, n_tokens, ids_crc32."""
    manifest = sstable.write_tables(_table(spark, sf_dir, "documents"), tokenizer_path())
    return sstable.read_tables(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated passages: doc_id, n_words, n_removed, kept_sha256."""
    small_batches(spark)
    found = substring.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    small_batches(spark)
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets and batches of all documents by their tokens (those of op5): doc_id, n_tokens, bucket, width, batch, slot."""
    return packing.pack_texts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector: vec_id, n_links, component_id, kept."""
    small_batches(spark)
    return embed_lattice.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the Kneser-Ney models: doc_id, held_out, score, predicted."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the four leading components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered, spans_crc32."""
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), piece_model_path())


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a."""
    return alignment.align_corpus(_table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_decontaminate, op2_ngram_join, op3_quality, op4_shards, op5_sstable, op6_substring, op7_html, op8_packing, op9_embeddings, op10_toxicity, op11_whitening, op12_pieces, op13_alignment]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
