"""Table functions for SQL: shingles, MinHash bands, and candidate pairs by any scorer of string pairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkforge.functions.strsim import jaro_winkler_many
from linkforge.operators.minhash import _hash32, band_shape, family, PRIME


Scorer = Callable[[list[str], list[str]], np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of whole numbers."""
    h = np.zeros(len(x), np.uint64)
    for column in x.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def band_function(n: int = 128, threshold: float = 0.6, size: int = 4):
    """``bands(TABLE(rows))`` of rows (id BIGINT, text STRING): id, band, bucket; texts without shingles share theirs, null ones have none."""
    shape = band_shape(threshold, n)

    @F.arrow_udtf(returnType="id bigint, band int, bucket bigint")
    class Bands:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            rows = rows.filter(pc.is_valid(rows.column("text")))
            a, b = (np.array(x, np.int64) for x in zip(*family(n)))
            signed = np.full((len(rows), n), PRIME, np.int64)
            for r, t in enumerate(rows.column("text").to_pylist()):
                h = np.array([_hash32(s) % PRIME for s in {t[i : i + size] for i in range(len(t) - size + 1)}], np.int64)
                for k in range(0, len(h), 4096):
                    np.minimum(signed[r], ((h[k : k + 4096, None] * a + b) % PRIME).min(axis=0), out=signed[r])
            for band in range(shape[0]):
                part = signed[:, band * shape[1] : (band + 1) * shape[1]]
                yield pa.table({"id": rows.column("id"), "band": pa.array(np.full(len(rows), band, np.int32)), "bucket": pa.array(_mixed(part))})

    return Bands


def pair_function(scorer: Scorer = jaro_winkler_many, threshold: float = 0.9):
    """``pairs(TABLE(candidates))`` of rows (orig_idxs, match_idxs BIGINT, a, b STRING): those with a score of the threshold or more, and the score.

    Candidates are scored a batch at a time, where they are; a pair with a null
    string is left out.
    """

    @F.arrow_udtf(returnType="orig_idxs bigint, match_idxs bigint, score double")
    class Pairs:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            rows = rows.filter(pc.and_(pc.is_valid(rows.column("a")), pc.is_valid(rows.column("b"))))
            score = np.asarray(scorer(rows.column("a").to_pylist(), rows.column("b").to_pylist()), float)
            keep = pa.array(score >= threshold)
            yield pa.table({"orig_idxs": rows.column("orig_idxs").filter(keep), "match_idxs": rows.column("match_idxs").filter(keep), "score": pa.array(score).filter(keep)})

    return Pairs


def register(spark: SparkSession, prefix: str = "linkforge_", scorer: Scorer = jaro_winkler_many, n: int = 128, level: float = 0.6, threshold: float = 0.9) -> dict[str, str]:
    """Registers shingles(text, size), bands(TABLE) and pairs(TABLE) for a session under a prefix; returns their names."""
    if not re.fullmatch(r"\w+", prefix):
        raise ValueError("a prefix of letters, digits and underscores")
    names = {name: f"{prefix}{name}" for name in ("shingles", "bands", "pairs")}
    # in SQL itself, so it stays an expression that Spark compiles
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names['shingles']}(t STRING, size INT) RETURNS TABLE (place INT, shingle STRING) RETURN SELECT inline(CASE WHEN char_length(t) >= size THEN transform(sequence(1, char_length(t) - size + 1), i -> struct(i, substr(t, i, size))) END)")
    spark.udtf.register(names["bands"], band_function(n, level))
    spark.udtf.register(names["pairs"], pair_function(scorer, threshold))
    return names
