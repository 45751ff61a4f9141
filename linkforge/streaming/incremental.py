"""A stream that is its own index: each row meets those of the same buckets that came within a time of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkforge.operators.minhash import band_shape, bands, signature_udf


def stream_pairs(rows: DataFrame, id_col: str, text_col: str, time_col: str, within: str = "1 hour", delay: str = "10 minutes", n: int = 128, threshold: float = 0.6, size: int = 4) -> DataFrame:
    """(orig_idxs, match_idxs, band), orig < match, for each bucket that two streamed rows share whose times are at most ``within`` apart.

    ``rows`` have a long id and a timestamp.  The state of a bucket are the ids
    and times of its rows, which go when the watermark, ``delay`` behind the
    latest time, is ``within`` past them; rows behind the watermark are dropped.
    Of rows that arrive in time no pair is lost, in whichever batches they come.
    Rows without id, text or time meet nothing.
    """
    most = int(pd.Timedelta(within).total_seconds() * 1000)
    some = rows.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(time_col).isNotNull())
    some = some.select(F.struct(F.col(id_col).cast("long").alias("id"), F.col(time_col).cast("timestamp").alias("at")).alias("id"), signature_udf(n, size)(F.col(text_col)).alias("signature"))
    filed = bands(some, *band_shape(threshold, n)).select("band", "bucket", F.col("id.id").alias("id"), F.col("id.at").alias("at")).withWatermark("at", delay)
    filed = filed.withColumn("ms", F.unix_millis("at"))

    def f(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times = (np.array(x, np.int64) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not state.hasTimedOut:
            for frame in frames:
                new, at = frame["id"].to_numpy(np.int64), frame["ms"].to_numpy(np.int64)
                ids, times = np.concatenate([ids, new]), np.concatenate([times, at])
                # each new row with those before it in the state, which now holds them all
                for k in range(len(ids) - len(new), len(ids)):
                    other = np.flatnonzero((np.abs(times[:k] - times[k]) <= most) & (ids[:k] != ids[k]))
                    if len(other):
                        yield pd.DataFrame({"orig_idxs": np.minimum(ids[other], ids[k]), "match_idxs": np.maximum(ids[other], ids[k]), "band": np.int32(key[0])})
        open_ = times + most >= state.getCurrentWatermarkMs()
        ids, times = ids[open_], times[open_]
        if len(ids):
            state.update((ids.tolist(), times.tolist()))
            state.setTimeoutTimestamp(int(max(times.min() + most, state.getCurrentWatermarkMs()) + 1))
        elif state.exists:
            state.remove()

    return filed.groupBy("band", "bucket").applyInPandasWithState(f, "orig_idxs long, match_idxs long, band int", "ids array<long>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
