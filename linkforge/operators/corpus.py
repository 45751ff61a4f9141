"""Packing of a corpus into chunks of words, sampling, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.operators.scratch import written

SEPARATOR = "[SEP]"


def pack_words(df: DataFrame, id_col: str, text_col: str, length: int, drop_empty: bool = False, block: int = 10_000) -> DataFrame:
    """(chunk, text): all texts in order of id, a separator word between them, cut every ``length`` words.

    Words stand between single spaces.  There are 1 + n // length chunks and an
    empty last one; ``drop_empty`` leaves empty ones out.  Word offsets are
    running sums in blocks of ids and over the blocks, so no task orders all
    rows.
    """
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.split(F.col(text_col), " ", -1).alias("w"))
    rows = rows.withColumn("block", F.floor(F.col("id") / block))
    totals = rows.groupBy("block").agg(F.sum(F.size("w") + 1).alias("t"))
    starts = totals.withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    inside = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.size("w") + 1).over(inside), F.lit(0))
    placed = rows.withColumn("o", offset).join(starts, "block").select((F.col("o") + F.col("before")).alias("o"), "w")
    # the separator stands before each text but the first; a text is cut where chunks end, and its pieces are shuffled, not its words
    placed = placed.select((F.col("o") - 1).alias("o"), F.concat(F.array(F.lit(SEPARATOR)), "w").alias("w"))
    placed = placed.select(F.greatest("o", F.lit(0)).alias("o"), F.when(F.col("o") < 0, F.expr("slice(w, 2, size(w))")).otherwise(F.col("w")).alias("w"))
    piece = f"struct(c as chunk, greatest(o, c * {length}) as at, array_join(slice(w, cast(greatest(o, c * {length}) - o + 1 as int), cast(least((c + 1) * {length}, o + size(w)) - greatest(o, c * {length}) as int)), ' ') as piece)"
    pieces = placed.filter("size(w) > 0").select(F.expr(f"inline(transform(sequence(o div {length}, (o + size(w) - 1) div {length}), c -> {piece}))"))
    chunks = pieces.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    if drop_empty:
        return chunks
    n = totals.agg(F.coalesce(F.sum("t") - 1, F.lit(0)).alias("n"))
    every = n.select(F.explode(F.sequence(F.lit(0), F.expr(f"n div {length} + 1"))).alias("chunk"))
    return every.join(chunks, "chunk", "left").select(F.col("chunk").cast("long").alias("chunk"), F.coalesce("text", F.lit("")).alias("text"))


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, those whose draws are least: the same on every run."""
    return df.orderBy(_drawn(id_col, seed), id_col).limit(n)


def sample_with_replacement(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n draws of rows, each from all: a column ``draw`` from 0 and the drawn row's columns; the same on every run.

    A draw is a number below the number of rows, and rows are numbered by
    sorting them once; a few draws are joined to all rows.
    """
    rows = df.count()
    if not rows:
        return df.select(F.lit(0).cast("long").alias("draw"), "*").limit(0)
    drawn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.lit("draw"))), 1, 15), 16, 10).cast("long"), F.lit(rows))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), drawn.alias("_place"))
    return numbered(df, [F.col(id_col)], "_place").join(draws, "_place").select("draw", *df.columns)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in an order; ranges of rows are sorted and counted, so no task has all.

    The ranges' counts come to the driver, a number for each partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select("*", F.struct(*order).alias("_o")).repartitionByRange(parts, "_o").sortWithinPartitions("_o").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ranged = written(ranged)  # so that a lost executor's rows are dealt as they were
    counts = dict(ranged.groupBy("_part").count().collect())
    before, total = {}, 0
    for k in range(parts):
        before[k] = total
        total += counts.get(k, 0)
    starts = F.element_at(F.array(*[F.lit(before[k]).cast("long") for k in range(parts)]), F.col("_part") + 1)
    return ranged.withColumn(name, F.col("_at") + starts).drop("_o", "_part", "_at")


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """All rows in an order that seed and id draw: the same on every run."""
    return df.orderBy(_drawn(id_col, seed), id_col)


def _drawn(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def batches(df: DataFrame, id_col: str, size: int, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """Shuffled rows with the number of their batch of ``size``, from 0; the last one, if not full, is left out."""
    out = numbered(df, [_drawn(id_col, seed), F.col(id_col)], "_place")
    out = out.withColumn("batch", F.expr(f"_place div {size}"))
    return (out.filter(F.col("batch") < df.count() // size) if drop_last else out).drop("_place")


def prepare_corpus(df: DataFrame, id_col: str, text_col: str, max_length: int = 512, subset_size: int | None = None, pack: bool = True) -> DataFrame:
    """(id, text) for training: the first ``subset_size`` chunks of ``max_length`` words, or with ``pack`` off the first rows as they are.

    All of them without a ``subset_size``.  Chunks that hold nothing are left out.
    """
    rows = pack_words(df, id_col, text_col, max_length, drop_empty=True).withColumnRenamed("chunk", "id") if pack else df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows if subset_size is None else head(rows, "id", subset_size)


def head(df: DataFrame, id_col: str, n: int) -> DataFrame:
    return df.orderBy(id_col).limit(n)


def running_mean(df: DataFrame, order_col: str, value_col: str, width: int = 499, run_col: str | None = None, block: int = 100_000) -> DataFrame:
    """The mean of the last ``width`` values at each step, of each run if a column tells runs apart.

    Rows are numbered in order and worked on in blocks, each with the last rows
    of the one before, so no task has a whole run.
    """
    block = max(block, width)
    keys = [F.col(c) for c in (run_col, order_col) if c]
    rows = numbered(df, keys, "_place").withColumn("_block", F.expr(f"_place div {block}"))
    # the rows that the next block's first ones look back on go there too
    ends = F.col("_place") % block > block - width
    both = rows.withColumn("_to", F.explode(F.when(ends, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))))
    within = Window.partitionBy("_to", *([run_col] if run_col else [])).orderBy("_place").rowsBetween(-(width - 1), 0)
    return both.withColumn("mean", F.avg(value_col).over(within)).filter("_to = _block").drop("_place", "_block", "_to")
