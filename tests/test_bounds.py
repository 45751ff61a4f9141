"""What operators hold and move stays in bounds, with the same results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkforge import queries
from linkforge.functions import chars, text
from linkforge.operators import cells, knn, minhash, neighbour_graph, product_quantiser, svd
from linkforge.plans.strategy import IvfShape


def _texts(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcd "), 80)) for _ in range(12)]
    texts = [b[:k] + "xyz" + b[k:] for b in base for k in (5, 30, 55)] + [base[0], base[0], "abc", "", None]
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string"), texts


def test_outlines_are_bounds():
    """an outline never leaves out a pair that reaches the threshold, whatever the sizes, and does leave out others."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 6000).astype(np.uint64)
    sets = [np.unique(pool[a : a + n]) for n in (3, 60, 64, 65, 300, 900, 1025, 1500) for a in range(0, n, max(1, n // 4))] + [np.unique(pool[3000 + a : 4000 + a]) for a in (0, 900)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    for threshold in (0.3, 0.6, 0.9):
        found = {(i, int(j)) for i, js in minhash._in_reach(n, [minhash.outline(s) for s in sets], threshold) for j in js}
        both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
        every = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))}
        want = {(i, j) for i, j in every if both(i, j) >= threshold * (n[i] + n[j] - both(i, j))}
        assert want <= found and len(found) < len(every) * 0.8


def test_outline_is_linear():
    assert all(len(minhash.outline(np.arange(n, dtype=np.uint64))) <= max(24, n) for n in (0, 1, 64, 1000, 70_000))


def test_verified_pairs_in_blocks(spark):
    """a bucket dealt into blocks gives the same pairs."""
    rows, _ = _texts(spark)
    got = [sorted(map(tuple, minhash.verified_pairs(rows, "id", "t", 128, 0.6, bucket_rows=b).collect())) for b in (2, 2000)]
    assert got[0] == got[1] and len(got[0]) > 30


def test_pairs_are_found_once(spark):
    """In the first band that they share, whatever the blocks; lists hold each match once."""
    rows, _ = _texts(spark)
    for size in (2, 2000):
        found = minhash._matches(rows, "id", "t", 16, 0.6, 4, size).select("rep", F.explode("matches").alias("m"))
        assert found.count() == found.distinct().count()
        lists = {r[0]: r[1] for r in minhash.lsh_match_lists(rows, "id", "t", 16, 0.6, size).collect()}
        pairs = sorted(map(tuple, minhash.lsh_pairs(rows, "id", "t", 16, 0.6, bucket_rows=size).collect()))
        assert pairs == sorted((a, b) for a, bs in lists.items() for b in bs) and len(pairs) == len(set(pairs))


def test_texts_of_a_batch_are_taken_in_parts(spark, monkeypatch):
    """a worker makes strings and signatures of a few texts of a batch at a time, each text once, with the same results."""
    lengths = [10, 0, 0, 40, 250, 90, 20, 0, 1, 30, 60]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(lengths))), "text": ["é" * (n // 2) for n in lengths]})
    monkeypatch.setattr(minhash, "TEXT_BYTES", 100)
    parts = list(minhash._some_texts([batch.slice(0, 0), batch]))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch]) and len(parts) > 3
    assert all(len(p) == 1 or sum(len(t.encode()) for t in p.column("text").to_pylist()[1:]) <= 100 for p in parts)
    assert [len(p) for p in minhash._some_texts([batch.slice(k, 1) for k in range(len(batch))])] == [1] * len(batch)
    rows, texts = _texts(spark)
    # of one partition and one batch, of which the workers' Spark gets no more than a part back at a time
    found = {r["id"]: r["signature"] for r in minhash.signatures(rows.coalesce(1), "id", "t", 16).collect()}
    assert found == {i: minhash.signature(t, minhash.shingle_hashes(t), 16, 4).tolist() for i, t in enumerate(texts) if t is not None}


def test_remembered_shingles(monkeypatch):
    """signatures are the same when few shingles are remembered."""
    monkeypatch.setattr(minhash, "REMEMBERED", 50)
    few, a, b = minhash._Values(16), *(np.array(x) for x in zip(*minhash.family(16)))
    for t in ("a text of some length that goes on", "another text, also of some length", "日本語のテキスト", "a text of some length that goes on", "abc"):
        h = [minhash._hash32(t[i : i + 4]) % minhash.PRIME for i in range(len(t) - 3)]
        want = [min([(x * int(p) + int(q)) % minhash.PRIME for x in h], default=minhash.PRIME) for p, q in zip(a, b)]
        assert few.least(t, minhash.shingle_hashes(t), 4).tolist() == want
    assert len(few.keys) == 50


def test_shingle_counts(spark):
    """counts without lists of shingles; a null text has none, as in SQL."""
    rows = spark.createDataFrame([(None,), ("abc",), ("aaaaa",), ("abcdabcd",)], "t string").coalesce(1)
    assert [tuple(r[0]) for r in rows.select(text.shingle_counts_udf(4)("t")).collect()] == [(0, 0), (0, 0), (2, 1), (5, 4)]


def test_probe_join_holds_few(spark, monkeypatch):
    """what cells find is cut to each query's nearest a stretch of queries at a time."""
    x = np.random.default_rng(2).standard_normal((300, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    centres, seen = x[:6], []

    def f(asked, held, cell):
        return knn.block_neighbours(asked, held, 20, "l2sq")

    def dealt(queries, index, g, schema, block_rows):
        out = g(queries.toArrow(), index.toArrow())
        return spark.createDataFrame(out.to_pandas(), schema)

    def nearest(found, k):
        seen.append(len(found))
        return kept(found, k)

    kept = cells.nearest_of
    monkeypatch.setattr(cells, "FOUND_ROWS", 1000)
    monkeypatch.setattr(cells, "cell_join", dealt)
    monkeypatch.setattr(cells, "nearest_of", nearest)
    got = cells.probe_join(v, cells.file_by_cell(v, centres, 1), centres, 6, f, "orig_idxs long, match_idxs long, distance double", 5)
    assert max(seen) <= 6 * 20 * (1000 // (5 * 6)) and sorted(map(tuple, got.collect())) == sorted(map(tuple, knn.exact_knn(v, v, 5).collect()))


def test_distances_in_memory(monkeypatch):
    """The table of distances is bounded, whatever the blocks' rows."""
    x = np.random.default_rng(2).standard_normal((400, 8))
    t = pa.table({"id": np.arange(400), "vector": pa.array(x.tolist())})
    seen, part = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda a, *args, **kw: seen.append(a.size) or part(a, *args, **kw))
    want = knn.block_neighbours(t, t, 5, "l2")
    monkeypatch.setattr(knn, "DISTANCES", 4000)
    seen.clear()
    assert knn.block_neighbours(t, t, 5, "l2").to_pydict() == want.to_pydict()
    assert max(seen) <= 4000


def test_places_are_drawn_once(spark):
    """the draws stand once in the expression, not once for each id and result."""
    rows = spark.createDataFrame([(1, [5, 6, 7, 252, 8, 9, 10, 11])], "i long, ids array<int>")
    masked = rows.select(chars.mlm_mask(F.col("i"), F.col("ids"), 0.5).alias("m"))
    assert str(masked._jdf.queryExecution().optimizedPlan()).count("md5(") == 1
    apart = rows.withColumn("p", chars.mask_places(F.col("i"), F.col("ids"), 0.5)).select(chars.masked(F.col("ids"), F.col("p")).alias("m"))
    assert masked.collect() == apart.collect()


def test_parts_grow(spark, tmp_path):
    """texts are dealt into as many parts as a shuffle has, not as cores."""
    spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, "a b")], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "77")
    try:
        assert queries._documents(spark, str(tmp_path)).rdd.getNumPartitions() == 77
        assert queries.QUERIES["mlm_mask_chunks"](spark, str(tmp_path)).rdd.getNumPartitions() == 77
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_probe_join_compares_blocks_whole(spark, monkeypatch):
    """Queries that look into most cells of a block meet it in one comparison, and miss none of their cells' rows."""
    seen = spark.sparkContext.accumulator(0)

    def f(asked, held, _):
        if len(asked) and len(held):
            seen.add(1)
        return knn.block_neighbours(asked, held, 5, "l2sq")

    x = np.random.default_rng(6).standard_normal((300, 4))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    centres = knn.kmeans(x, 20)
    found = cells.probe_join(v, cells.file_by_cell(v, centres, 1), centres, 12, f, "orig_idxs long, match_idxs long, distance double", 5, any_cell=True)
    want = {tuple(r) for r in knn.exact_knn(v, v, 5).collect()}
    assert {tuple(r) for r in knn.merged(found, 5).collect()} == want and seen.value <= 4


def test_rows_meet_centres_in_parts(spark, monkeypatch):
    """However many rows a batch has, few are compared with the centres at a time, and cells are the same."""
    x = np.random.default_rng(7).standard_normal((400, 6))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, vector array<double>").coalesce(1)
    centres = x[:40]
    want = sorted((r["cell"], r["id"]) for r in cells.file_by_cell(v, centres, 2).collect())
    batch = pa.RecordBatch.from_pydict({"id": list(range(400))})
    assert [len(b) for b in cells.slices([batch], 1 << 18)] == [4] * 100
    monkeypatch.setattr(cells, "CENTRE_DISTANCES", 1000)
    assert sorted((r["cell"], r["id"]) for r in cells.file_by_cell(v, centres, 2).collect()) == want


def test_one_block_comes_to_the_driver(spark, monkeypatch):
    """Sums of the decomposition's products are added where stretches meet, however many partitions there are."""
    x = np.random.default_rng(8).random((60, 12))
    weights = spark.createDataFrame([(i, f"t{j:02}", float(x[i, j])) for i in range(60) for j in range(12)], "id long, term string, weight double")
    rows, terms, block = svd._grouped(weights).repartition(9, "id"), {f"t{j:02}": j for j in range(12)}, np.random.default_rng(9).random((12, 4))
    monkeypatch.setattr(svd, "CHUNK_BYTES", 8 * 4 * 5)
    got = svd._products(rows, block, terms).toArrow().sort_by("chunk")
    assert got["chunk"].to_pylist() == [0, 1, 2]
    assert np.concatenate([np.frombuffer(s) for s in got["s"].to_pylist()]).reshape(12, 4) == pytest.approx(x.T @ (x @ block))
    assert svd.fit(weights, 5).values == pytest.approx(np.linalg.svd(x)[1][:5], rel=1e-3)


def test_tasks_by_points(spark, monkeypatch):
    """many partitions of the session are no more tasks a round or a pass for few points, with the same results."""
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(300)], "id long, vector array<double>")
    weights = spark.createDataFrame([(i, f"t{j}", float(x)) for i in range(300) for j, x in enumerate(rng.random(6))], "id long, term string, weight double")
    met, products = [], svd._products
    monkeypatch.setattr(svd, "_products", lambda rows, *rest: met.append(rows.rdd.getNumPartitions()) or products(rows, *rest))
    default, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("48", default):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            graph = neighbour_graph.nn_descent(vectors, 3)
            assert len(graph.edges.inputFiles()) <= 4
            near = sorted(map(tuple, graph.neighbours(3).collect()))
            asked = sorted(map(tuple, neighbour_graph.graph_search(graph, vectors.limit(40), 3).collect()))
            found.append((near, asked, svd.fit(weights, 3, passes=2).values.round(9).tolist()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", default)
    assert found[0] == found[1] and max(met) <= 4
    # tables of many points have all of the session's partitions still
    assert neighbour_graph._parts(spark, 10**6) == max(4, int(default))


def test_pairs_of_signatures_are_not_moved(spark):
    """F8 of round 4: no shuffle follows the place where pairs of signatures are found."""
    df = spark.createDataFrame([(i, f"a text of some length, number {i % 9}") for i in range(30)], "id long, t string")
    plan = minhash.signature_groups(df, "id", "t")[0]._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0] and "Exchange" not in plan.split("MapInArrow")[0]


def test_remembered_shingles_are_not_sorted_again(monkeypatch):
    """F1, F3, F5, F6 of round 4: a text's new shingles are put between the known ones."""
    few = minhash._Values(16)
    few.least("a first text", minhash.shingle_hashes("a first text"), 4)
    monkeypatch.setattr(minhash.np, "argsort", lambda *_, **__: pytest.fail("all known shingles are sorted"))
    text = "another text, and a longer one"
    hashes, known = minhash.shingle_hashes(text), few.keys.copy()
    got = few.least(text, hashes, 4).tolist()
    assert got == [min((x * (minhash._hash32(text[i : i + 4]) % minhash.PRIME) + y) % minhash.PRIME for i in range(len(text) - 3)) for x, y in minhash.family(16)]
    assert few.keys.tolist() == sorted({*known.tolist(), *hashes.tolist()}) and len(few.at) == len(few.keys)


def test_small_meetings_go_together():
    """F3, F5, F6 of round 4: meetings of few rows are looked at together, and pair none but their own."""
    rng = np.random.default_rng(3)
    rows = sorted((int(band), int(bucket), 0, 0) for band, bucket in zip(rng.integers(0, 2, 300), rng.integers(0, 60, 300)))
    rows += [(2, 7, 0, 1)] * 6
    side = [0] * 300 + [0, 1, 0, 1, 1, 0]
    met = [[int(x) for x in rng.integers(0, 9, r[0])] for r in rows]
    table = pa.table({c: pa.array([r[k] for r in rows]) for k, c in enumerate(minhash._MEETING)} | {"_side": side, "id": list(range(306)), "buckets": pa.array(met, pa.list_(pa.int64()))})
    want = {(i, j) for i in range(306) for j in range(306) if i != j and rows[i] == rows[j] and (rows[i][2] == rows[i][3] or side[i] != side[j]) and not any(x == y for x, y in zip(met[i], met[j]))}
    for step in (7, 100, 306):
        batches = table.to_batches(step)
        runs = list(minhash._each(iter(batches), minhash._MEETING, minhash.SMALL))
        assert pa.Table.from_batches(runs).equals(table) and (step < 100 or len(runs) < 20)
        found = [(int(run["id"][int(i + a)].as_py()), int(run["id"][int(j)].as_py())) for run in runs for open_, a in minhash._open(run) for i, j in zip(*np.nonzero(open_))]
        assert len(found) == len(set(found)) and set(found) == want
        assert [len(set(zip(*(b.column(c).to_pylist() for c in minhash._MEETING)))) for b in minhash._each(iter(batches), minhash._MEETING)] == [1] * len(set(rows))


def test_product_codes_send_no_vector_with_a_pair(spark, monkeypatch):
    """F2 of round 4: blocks send k exact finds of a query, and a query that looks into much of a block goes without a list of cells."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 8))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    sent = []

    def dealt(queries, index, g, schema, block_rows):
        asked, held = queries.toArrow(), index.toArrow()
        assert asked["vector"].type.value_type == pa.float32()
        found = [g(asked.filter(pa.array(asked["cell"].to_numpy() == c)), held.filter(pa.array(held["cell"].to_numpy() == c))) for c in np.unique(asked["cell"].to_numpy())]
        sent.append((int(asked["cells"].combine_chunks().value_lengths().to_numpy().sum()), len(asked), sum(map(len, found))))
        return spark.createDataFrame(pa.concat_tables(found).to_pandas(), schema)

    monkeypatch.setattr(cells, "cell_join", dealt)
    monkeypatch.setattr(product_quantiser, "EXACT_BYTES", 8 * 8 * 100)
    near = product_quantiser.ivf_pq_knn(v, v, 5, 4, IvfShape(16, 16))
    (listed, asked, found), = sent
    assert listed == 0 and found == 5 * asked and asked <= 400 * 5
    want = {tuple(r)[:2] for r in knn.exact_knn(v, v, 5).collect()}
    assert len({tuple(r)[:2] for r in near.collect()} & want) >= 0.97 * len(want)
    # few cells of a block are listed, and what they find is exact too
    sent.clear()
    near = {tuple(r)[:2]: r["distance"] for r in product_quantiser.ivf_pq_knn(v, v, 5, 4, IvfShape(40, 3)).collect()}
    assert sent[0][0] > 0 and all(d == round(((np.float32(x[i]).astype(float) - np.float32(x[j]).astype(float)) ** 2).sum(), 6) for (i, j), d in near.items())


def test_outlines_of_small_meetings(monkeypatch):
    """F4, F7 of round 4: pairs of small meetings are bounded together, with the same bounds as a large meeting's."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = sorted((np.unique(pool[a : a + n]) for n in (3, 60, 64, 65, 300, 900, 1025) for a in range(0, n, max(1, n // 4))), key=len)
    n, outlines = np.array([len(s) for s in sets]), [minhash.outline(s) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    for threshold, held in ((0.3, 1 << 22), (0.6, 1), (0.9, 4000)):
        monkeypatch.setattr(minhash, "OUTLINE_BYTES", held)
        want = {(a, int(b)) for a, bs in minhash._in_reach(n, outlines, threshold) for b in bs}
        reach = minhash._pairs_in_reach(n, outlines, i, j, threshold)
        assert set(zip(i[reach].tolist(), j[reach].tolist())) == want and not reach.all()
