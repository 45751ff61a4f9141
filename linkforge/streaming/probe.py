"""A stream of queries against a static LSH index: a stream-static join without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.operators.minhash import band_shape, bands, signatures


def probe(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, n: int = 128, threshold: float = 0.6) -> DataFrame:
    """(orig_idxs, match_idxs) for each bucket that a streamed query shares with an index row; a pair comes once a bucket."""
    filed = bands(signatures(queries, id_col, text_col, n), *band_shape(threshold, n))
    return filed.join(index, ["band", "bucket"]).select(F.col("id").alias("orig_idxs"), "match_idxs")
