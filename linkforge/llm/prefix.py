"""Global running totals from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch, partitions


def with_running_totals(scratch: Scratch, df: DataFrame, order: list[str], within: list[str], total: str | None = None) -> DataFrame:
    """Adds ``row_index`` and, for a column ``total``, ``before``: rows and the column's sum ahead of each row.

    Rows are counted from 0 in each value of ``within`` (a leading part of
    ``order``; [] for the whole table).  Rows are dealt out by ranges of
    ``order``, so a value that many rows share spreads over as many partitions
    as it needs; the dealt rows are written to the shared folder, which fixes
    the ranges for good.  Only one row for each partition and value of
    ``within`` that it holds comes back to be summed.
    """
    # a hash of the row breaks ties, so that rows that are alike in all of ``order`` can be split too
    dealt = df.withColumn("_tie", F.xxhash64(*df.columns)).repartitionByRange(partitions(df.sparkSession), *order, "_tie")
    table = scratch.cut(dealt.withColumn("_part", F.spark_partition_id()))
    sums = [F.count("*").alias("_rows")] + ([F.sum(total).alias("_sum")] if total else [])
    totals = table.groupBy("_part", *within).agg(*sums)
    ahead = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    at = [F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_before")]
    at += [F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum_before")] if total else []
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w_{c}") for c in within], *at)
    own = Window.partitionBy("_part", *within).orderBy(*order, "_tie")
    out = table.withColumn("_n", F.row_number().over(own) - 1)
    if total:
        out = out.withColumn("_s", F.sum(total).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(total))
    match = out["_part"] == offsets["_p"]
    for c in within:
        match &= out[c].eqNullSafe(offsets[f"_w_{c}"])
    out = out.join(offsets, match)
    out = out.withColumn("row_index", F.col("_n") + F.col("_rows_before"))
    if total:
        out = out.withColumn("before", F.col("_s") + F.col("_sum_before"))
    return out.select(*df.columns, "row_index", *(["before"] if total else []))
