"""A replayed stream against the batch join, and the table functions in SQL."""

import datetime
import json
import os

import numpy as np
import pytest

from linkforge.functions import table_functions
from linkforge.operators import minhash
from linkforge.streaming.incremental import stream_pairs


def test_replayed_stream(spark, tmp_path):
    """Rows in files out of order; pairs within an hour, whichever batch brings them."""
    texts = [f"{a} {b} limited {i % 3}" for i, (a, b) in enumerate((a, b) for a in ("acme", "globex", "initech") for b in ("trading", "tradings", "holdings", "holding"))]
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [{"id": i, "text": texts[i % 12] if i != 7 else None, "at": (start + datetime.timedelta(minutes=9 * i)).isoformat()} for i in range(24)]
    order = [0, 2, 1, 3, *range(5, 12), 4, *range(12, 24)]
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(rows[i]) for i in order[k * 4 : k * 4 + 4]))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order
    stream = spark.readStream.schema("id long, text string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream_pairs(stream, "id", "text", "at", "1 hour", "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [(r["orig_idxs"], r["match_idxs"], r["band"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    df = spark.createDataFrame([(r["id"], r["text"]) for r in rows], "id long, text string")
    near = {(a, b) for a, b in map(tuple, minhash.lsh_pairs(df, "id", "text").collect()) if a < b and 9 * (b - a) <= 60}
    assert near and {p[:2] for p in got} == near and len(got) == len(set(got))


def test_table_functions(spark):
    rows = [(1, "globex corporation"), (2, "globex corporatoin"), (3, "other"), (4, "ab"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    f = table_functions.register(spark, "t_", lambda a, b: np.array([len(x) / max(1, len(y)) for x, y in zip(a, b)]), threshold=0.5)
    got = spark.sql(f"SELECT r.id, s.place, s.shingle FROM {{rows}} r, LATERAL {f['shingles']}(r.text, 4) s", rows=df).collect()
    assert sorted(map(tuple, got)) == sorted((i, k + 1, t[k : k + 4]) for i, t in rows if t for k in range(len(t) - 3))
    banded = spark.sql(f"SELECT * FROM {f['bands']}(TABLE(SELECT id, text FROM {{rows}}))", rows=df).collect()
    buckets = {}
    for r in banded:
        buckets.setdefault((r["band"], r["bucket"]), set()).add(r["id"])
    met = {(a, b) for ids in buckets.values() for a in ids for b in ids}
    assert met == {tuple(r) for r in minhash.lsh_pairs(df, "id", "text").collect()}
    pairs = spark.createDataFrame([(1, 2, "ab", "abc"), (1, 3, "a", "abc"), (2, 3, None, "x")], "orig_idxs long, match_idxs long, a string, b string")
    scored = spark.sql(f"SELECT * FROM {f['pairs']}(TABLE(SELECT * FROM {{pairs}}))", pairs=pairs).collect()
    assert [tuple(r) for r in scored] == [(1, 2, pytest.approx(2 / 3))]
    with pytest.raises(ValueError):
        table_functions.register(spark, "no; drop")
