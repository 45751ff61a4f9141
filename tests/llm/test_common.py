"""What the operators share, and the shards' cuts, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.llm import common, sharding
from linkforge.llm.common import Scratch
from linkforge.llm.prefix import with_running_totals


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    least = {k: k for p in links for k in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    got = {r["node"]: r["component"] for r in common.components(Scratch(spark), spark.createDataFrame(links, "a long, b long")).collect()}
    own = {a for a, b in links if a != b} | {b for a, b in links if a != b}
    assert got == {k: v for k, v in least.items() if k in own}
    assert common.components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(v), int(n)) for g, v, n in zip(rng.integers(0, 3, 400), rng.integers(0, 5, 400), rng.integers(1, 9, 400))]
    df = spark.createDataFrame(rows, "g long, v long, n long").repartition(7)
    got = with_running_totals(Scratch(spark), df, ["g", "v"], ["g"], "n").collect()
    assert sorted((r["g"], r["v"], r["n"]) for r in got) == sorted(rows)
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["row_index"])
        assert [r["row_index"] for r in own] == list(range(len(own))) and [r["v"] for r in own] == sorted(r["v"] for r in own)
        assert [r["before"] for r in own] == np.concatenate([[0], np.cumsum([r["n"] for r in own])])[:-1].tolist()


def test_filter_loses_nothing(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    wanted = rows.filter("doc_id % 17 = 3").select(F.col("doc_id").alias("k"))
    got = {r["doc_id"] for r in common.maybe_in(rows, wanted, "k").collect()}
    assert got >= set(range(3, 20_000, 17)) and len(got) < 1.1 * len(range(3, 20_000, 17))
    assert common.maybe_in(rows, wanted.limit(0), "k").count() == 0


class _Cluster:
    """As much of a session as the choice of the folder looks at."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder
        self.sparkContext, self.conf, self._jsc = self, self, self
        self.isDefined = lambda: False

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.folder or default

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self


def test_no_machine_local_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError):
            common.shared_dir(_Cluster(master))
        assert common.shared_dir(_Cluster(master, "hdfs://x/y/")) == "hdfs://x/y"


@pytest.mark.parametrize("n", [1, 3, 7])
def test_cuts(spark, n, tmp_path):
    """Shards from the rows in order: each row where its middle byte lies, small groups of equal texts whole."""
    texts = ["same" * 5] * 4 + [f"text {i} " + "x" * (i * 13 % 90) for i in range(150)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assigned = sharding.shard_by_bytes(docs, n, keep_share=0.3)
    got = {r["doc_id"]: r for r in assigned.collect()}
    order = [r["doc_id"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy("h", "doc_id").collect()]
    size = [len((texts[i] or "").encode()) + 16 for i in order]
    before, total = np.concatenate([[0], np.cumsum(size)]), sum(size)
    want = [min(n - 1, (2 * b + s) * n // (2 * total)) for b, s in zip(before.tolist(), size)]
    k = 0
    while k < len(order):
        e = k
        while e < len(order) and (texts[order[e]] or "") == (texts[order[k]] or ""):
            e += 1
        if len(set(want[k:e])) > 1 and before[e] - before[k] <= 0.3 * total / n:
            want[k:e] = [min(n - 1, (2 * int(before[k]) + int(before[e] - before[k])) * n // (2 * total))] * (e - k)
        k = e
    assert [got[i]["shard"] for i in order] == want
    for shard in set(want):
        assert [got[i]["slot"] for i, s in zip(order, want) if s == shard] == list(range(want.count(shard)))
    sharding.write_shards(docs, assigned, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == {(i, got[i]["shard"], got[i]["slot"]) for i in got}
