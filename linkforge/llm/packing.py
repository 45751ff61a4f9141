"""Length buckets of least padding, and batches of a token budget inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkforge.llm.common import Scratch, released, small_batches
from linkforge.llm.prefix import with_running_totals
from linkforge.llm.sstable import Encoder, encoder

N_BUCKETS, TOKEN_BUDGET = 16, 65_536
#: Lengths are binned by their leading bits: 1024 to 2047 exact, longer ones within a thousandth; at most 512 bins for each doubling.
EXACT_BITS = 10


def byte_tokens(text_col: str = "text") -> Column:
    """Token count of a byte-level model: UTF-8 bytes and an end token; a null text has the end token alone."""
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets that minimise sum(count * bound).

    ``lengths`` ascend.  Dynamic programme over (buckets, lengths); the cost is
    a Monge array, so the best last cut moves right with the length and each
    layer is found by divide and conquer in O(n log n).
    """
    n = len(lengths)
    if n <= n_buckets:
        return [int(x) for x in lengths]
    total = np.concatenate([[0], np.cumsum(counts.astype(np.float64))])
    cost = np.concatenate([[0.0], lengths * total[1:]])  # one bucket for the first i lengths
    cuts = []
    for _ in range(1, n_buckets):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, left, right = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            k = np.arange(left, min(mid - 1, right) + 1)
            values = cost[k] + lengths[mid - 1] * (total[mid] - total[k])
            best = int(np.argmin(values))
            new[mid], cut[mid] = values[best], k[best]
            stack += [(lo, mid - 1, left, int(k[best])), (mid + 1, hi, int(k[best]), right)]
        cuts.append(cut)
        cost = new
    bounds, at = [], n
    for cut in reversed(cuts):
        if at == 0:
            break
        bounds.append(int(lengths[at - 1]))
        at = int(cut[at])
    if at:
        bounds.append(int(lengths[at - 1]))
    return bounds[::-1]


def length_bounds(lengths: DataFrame, column: str, n_buckets: int = N_BUCKETS) -> list[int]:
    """Best bounds for the global histogram of a column of lengths.

    What comes to the driver is the histogram, of at most 512 bins for each
    doubling of the length whatever the number of rows.
    """
    shift = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(column), F.lit(1)) + 1)).cast("int") - EXACT_BITS)
    bins = lengths.groupBy(F.expr("0").alias("_"), shift.alias("s"), F.floor(F.col(column) / F.pow(F.lit(2.0), shift)).alias("b"))
    found = bins.agg(F.max(column).alias("length"), F.count("*").alias("n")).orderBy("length").select("length", "n").collect()
    return best_bounds(np.array([r["length"] for r in found], np.float64), np.array([r["n"] for r in found]), n_buckets)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_tokens: Column | None = None, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, keep: list[str] | None = None) -> DataFrame:
    """Puts every row into a length bucket and, inside it, into a batch of at most ``budget`` padded tokens.

    Returns for each row: ``id_col``, ``n_tokens`` (``byte_tokens`` unless
    given), ``bucket`` (from 0, by length), ``width`` (the bucket's bound, to
    which its rows are padded), ``batch`` (from 0 in each bucket, in the order
    of length and id) and ``slot`` (from 0 in each batch).  A batch holds
    budget // width rows, one at least: a row longer than the budget is a
    batch of its own and is neither cut nor dropped.  The columns ``keep``
    follow.

    Null texts have length 1; null ids come first; equal lengths go by id,
    rows alike in both by a hash; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    keep = keep or []
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = scratch.cut(df.select(F.col(id_col).alias("_id"), (byte_tokens(text_col) if n_tokens is None else n_tokens.cast("long")).alias("n_tokens"), *kept))
    bounds = length_bounds(rows, "n_tokens", n_buckets)
    bucket, width = F.lit(len(bounds) - 1), F.lit(bounds[-1] if bounds else 0)
    for k in range(len(bounds) - 2, -1, -1):
        inside = F.col("n_tokens") <= bounds[k]
        bucket, width = F.when(inside, F.lit(k)).otherwise(bucket), F.when(inside, F.lit(bounds[k])).otherwise(width)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = rows.select("_id", "n_tokens", bucket.cast("int").alias("bucket"), width.cast("long").alias("width"), *names)
    rows = with_running_totals(scratch, rows, ["bucket", "n_tokens", "_id"], ["bucket"])
    per = F.greatest(F.lit(1), F.expr(f"{int(budget)} div width"))
    rows = rows.select(F.col("_id").alias(id_col), "n_tokens", "bucket", "width", (F.col("row_index") - F.pmod("row_index", per)).alias("_first"), "row_index", per.alias("_per"), *names)
    return rows.select(id_col, "n_tokens", "bucket", "width", F.expr("_first div _per").alias("batch"), (F.col("row_index") - F.col("_first")).alias("slot"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, remember: int | None = None, slice_bytes: int = 4 << 20) -> DataFrame:
    """(id_col, n_tokens) of every row, and its text: token ids of the whole text and an end id; a null text has the end id alone.

    A worker keeps its encoder and the parts that it knows between tasks; with
    ``remember`` each task has one of its own, which knows so many parts at
    most and takes a fifth more time and half the memory.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer) if remember is None else Encoder(tokenizer, remember)
        for batch in batches:
            texts, n, a = [t or "" for t in batch.column("_text").to_pylist()], [], 0
            while a < len(texts):  # some megabyte at a time, however long the texts are
                b, size = a, 0
                while b < len(texts) and (b == a or size < slice_bytes):
                    size += len(texts[b])
                    b += 1
                n += [len(ids) // own.width + 1 for ids in own.encode(texts[a:b])]
                a = b
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), *([batch.column("_text")] if with_text else [])], schema.names)

    schema = StructType([rows.schema["_id"]]).add("n_tokens", "long")
    if with_text:
        schema = schema.add("_text", "string")
    out = rows.mapInArrow(f if remember is None else released(f), schema)
    return out.select(F.col("_id").alias(id_col), "n_tokens", *([F.col("_text").alias(text_col)] if with_text else []))


def pack_texts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, remember: int | None = None, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``pack`` by the tokens of a tokenizer of the tokenizers library, with the text as the last column if asked for."""
    counted = token_counts(df, tokenizer, id_col, text_col, with_text, remember)
    return pack(counted, id_col, text_col, F.col("n_tokens"), n_buckets, budget, [text_col] if with_text else None)
