"""What the operators of this folder share: scratch tables, components, sizes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset a local session gets a temporary one; on a cluster,
    where each machine would see its own part of such a folder, it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended, or the folder is gone
        pass


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and lost executors cost nothing before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_delete, spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)
        tidy(self.spark)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, since texts are long; a setting of the caller's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives memory that a Python worker doesn't use any more back to the system, since workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, with ``release`` at the end of each task."""

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return g


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever signs their names have."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Deals rows out by keys into as many partitions as the session's shuffles have."""
    return df.repartition(partitions(df.sparkSession), *keys)


def to_partition(df: DataFrame, column: str) -> DataFrame:
    """Sends each row to the partition whose number, below the session's count, stands in the column."""
    return df.repartitionById(partitions(df.sparkSession), F.col(column))


#: Bits of a filter by ids: sixteen for each id, within these limits (2 MB to 64 MB are broadcast); one that gets full lets more through, no less.
FILTER_BITS, FILTER_MOST = 1 << 24, 1 << 29


def maybe_in(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose doc_id may stand in a column of ``ids``: a Bloom filter of two bits an id is broadcast."""
    size = min(FILTER_MOST, max(FILTER_BITS, 1 << (16 * ids.count()).bit_length()))
    bits = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(column, F.lit(k)), F.lit(size)) for k in (1, 2)])).alias("bit"))
    found = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set")).toArrow()
    table = np.zeros(size >> 6, np.int64)
    table[found.column("word").to_numpy()] = found.column("set").to_numpy()
    broadcast = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.ones(len(x), bool)
        for bit in (x.to_numpy(), y.to_numpy()):
            out &= (broadcast.value[bit >> 6] >> (bit & 63) & 1).astype(bool)
        return pd.Series(out)

    return rows.filter(may_be(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(size)) for k in (1, 2)]))


def components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given as links: (node, component), component the smallest node.

    Alternates large-star and small-star steps, which keep the number of links
    and need about log(nodes) rounds; each round is written to the shared
    folder.  Nodes without links are not returned.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = scratch.cut(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        following = scratch.cut(small)
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = following
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
