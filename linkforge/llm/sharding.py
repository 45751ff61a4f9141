"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch
from linkforge.llm.prefix import with_running_totals

ROW_BYTES = 16


def shard_by_bytes(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES, keep_share: float = 0.1) -> DataFrame:
    """Cuts the rows, ordered by a hash of the text and then by id, where the bytes ahead pass k / n_shards of all bytes.

    Returns one row for each input row: ``id_col``, ``size`` (UTF-8 bytes of
    the text plus ``row_bytes``), ``text_crc32``, ``shard`` (0 to n_shards - 1)
    and ``slot`` (0, 1, ... in each shard).  A row goes to the shard in which
    its middle byte lies, so shards differ by about one row from the target.

    Rows of equal text stand next to each other.  Where a cut falls inside such
    a group of at most ``keep_share`` of a target, the group goes whole to the
    side of its middle; a larger group is split at the cut, for sizes near
    equal are the law.  At most n_shards - 1 groups lie across a cut, so
    correcting them takes a table of at most so many rows.

    Null texts count as empty; null ids sort first; repeated rows each get a
    slot of their own; an empty table gives an empty result; other columns are
    left out, so their names cannot clash.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    scratch = Scratch(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_h"))
    rows = with_running_totals(scratch, rows, ["_h", "_id"], [], "size")
    rows = scratch.cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    cut = lambda start, size: F.least(F.lit(n_shards - 1), F.floor((F.lit(2) * start + size).cast("decimal(38,0)") * n_shards / F.lit(max(1, 2 * total)).cast("decimal(38,0)"))).cast("int")
    rows = rows.withColumn("_shard", cut(F.col("before"), F.col("size")))
    groups = rows.groupBy(F.col("_h").alias("_g")).agg(F.min("_shard").alias("_lo"), F.max("_shard").alias("_hi"), F.min("before").alias("_start"), F.sum("size").alias("_bytes"))
    across = groups.filter((F.col("_lo") < F.col("_hi")) & (F.col("_bytes") <= F.lit(keep_share * total / n_shards)))
    across = across.select("_g", cut(F.col("_start"), F.col("_bytes")).alias("_whole"))
    rows = rows.join(F.broadcast(across), rows["_h"] == across["_g"], "left").withColumn("shard", F.coalesce("_whole", "_shard"))
    rows = scratch.cut(rows.select("_id", "size", "text_crc32", "row_index", "shard"))
    first = rows.groupBy(F.col("shard").alias("_s")).agg(F.min("row_index").alias("_first"))
    out = rows.join(F.broadcast(first), rows["shard"] == first["_s"])
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("row_index") - F.col("_first")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the rows of ``df`` as Parquet in one folder a shard, in slot order; ids are to be unique and not null."""
    joined = df.join(assigned.select(id_col, "shard", "slot"), id_col)
    n = assigned.agg(F.max("shard")).first()[0]
    joined.repartitionByRange(max(1, (n or 0) + 1), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
