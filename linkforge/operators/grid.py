"""All queries against all rows of an index, block by block."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(queries: DataFrame, index: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int) -> DataFrame:
    """``f`` of each block of queries with each block of the index, by their column ``id``.

    Blocks have about ``block_rows`` rows, queries fewer where cores would stand
    idle; a task holds one of each.  Nothing passes through the driver.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_queries, n_index = queries.count(), index.count()
    q = max(1, -(-n_queries // block_rows), min(cores, n_queries))
    i = max(1, -(-n_index // block_rows))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    # renamed to themselves, since both may be one table
    left, right = dealt(queries.toDF(*queries.columns), "_q", q, "_i", i), dealt(index.toDF(*index.columns), "_i", i, "_q", q)
    # as many partitions as cells of the grid, so that none has many
    left = left.repartition(max(cores, min(q * i, 100_000)), "_q", "_i")
    return left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInArrow(f, schema)
