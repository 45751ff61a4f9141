import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.operators import corpus, dedupe, evaluate, knn, minhash, svd, tfidf
from linkforge.operators.transformer import CharTransformer, Shape, embed_texts
from linkforge.plans.strategy import IvfShape, choose
from linkforge.sources.address import read_addresses
from linkforge.sources.feather import read_feather, write_feather

NAMES = [(i, n) for i, n in enumerate(["acme trading ltd", "acme tradng ltd", "globex corporation", "globex corporatoin", "initech", "initech inc", "umbrella", "hooli", "abc", "xyz"])]


@pytest.fixture
def names(spark):
    return spark.createDataFrame(NAMES, "id long, name string")


@pytest.mark.parametrize(("t", "n", "want"), [(0.6, 128, (18, 7)), (0.8, 128, (9, 13)), (0.5, 128, (25, 5))])
def test_band_shape(t, n, want):
    assert minhash.band_shape(t, n) == want


def test_lsh(spark, names):
    pairs = {tuple(r) for r in minhash.lsh_pairs(names, "id", "name", 128, 0.5).collect()}
    assert {(i, i) for i, _ in NAMES} <= pairs and (2, 3) in pairs and (3, 2) in pairs
    # strings without shingles have one signature
    assert (8, 9) in pairs
    lists = {r[0]: r[1] for r in minhash.lsh_match_lists(names, "id", "name").collect()}
    assert all(i in lists[i] for i, _ in NAMES)
    found = minhash.lsh_search(minhash.lsh_index(names, "id", "name"), spark.createDataFrame([(1, "globex corporation"), (2, "nothing like it")], "id long, name string"), "id", "name").collect()
    assert {(r[0], r[1]) for r in found} >= {(1, 2), (2, None)}


def test_copies_in_lsh(spark):
    rows = spark.createDataFrame([(i, "one and the same") for i in range(5)], "id long, name string")
    assert minhash.lsh_pairs(rows, "id", "name").count() == 25


def test_set_join_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = [set(rng.integers(0, 40, 12).tolist()) for _ in range(60)]
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(base)], "id long, s array<string>")
    for t in (0.3, 0.5, 1.0):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(base[i] & base[j]) >= t * len(base[i] | base[j])}
        assert {(r[0], r[1]) for r in minhash.set_join(rows, "id", "s", t).collect()} == want


def test_svd_against_numpy(spark, names):
    weights = tfidf.fit(names, "id", "name").transform(names, "id", "name").cache()
    rows = weights.collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    x = np.zeros((len(NAMES), len(terms)))
    for r in rows:
        x[r["id"], terms[r["term"]]] = r["weight"]
    model = svd.fit(weights, 4, passes=12)
    assert model.values == pytest.approx(np.linalg.svd(x, compute_uv=False)[:4], rel=1e-3)
    got = np.array([r["vector"] for r in model.transform(weights).orderBy("id").collect()])
    # values tie here, so the vectors aren't unique: the columns are orthogonal and hold what the values say
    assert got.T @ got == pytest.approx(np.diag(model.values**2), abs=1e-3)


def test_knn_strategies(spark):
    x = np.random.default_rng(1).standard_normal((300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {i: np.argsort(d[i], kind="stable")[:5].tolist() for i in range(300)}
    for size in (1 << 20, 8 * 8 * 40):  # one block, and several
        got = {}
        for r in knn.exact_knn(v, v, 5, block_bytes=size).collect():
            got.setdefault(r[0], set()).add(r[1])
        assert got == {i: set(w) for i, w in want.items()}
    near = {(r[0], r[1]) for r in knn.ivf_knn(v, v, 5, IvfShape(16, 8)).collect()}
    assert sum((i, j) in near for i, w in want.items() for j in w) > 0.8 * 1500
    e = knn.edges(knn.knn(v, v, 5))
    assert e.columns == ["orig_idxs", "match_idxs", "distance"] and e.filter("orig_idxs >= match_idxs").count() == 0
    assert choose(50_000) == "exact" and choose(50_001) == "ivf"
    with pytest.raises(ValueError):
        knn.knn(v, v, 5, "other")


def test_dedupe_calls(spark, names):
    for f in (dedupe.dedupe_knn, dedupe.dedupe_approx_knn, dedupe.dedupe_vectors):
        rows = f(names, "id", "name", k=3)
        assert rows.columns == ["orig_idxs", "match_idxs", "distance"]
        assert (0, 1) in {(r[0], r[1]) for r in rows.collect()}
    assert (2, 3) in {(r[0], r[1]) for r in dedupe.dedupe_anchors(names, "id", "name", anchors=8).collect()}
    assert (2, 3) in {(r[0], r[1]) for r in dedupe.dedupe_bm25(names, "id", "name").collect()}


def test_evaluate(spark):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)], "id long, label long")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (0, 4), (1, None)], "orig_idxs long, match_idxs long")
    scored = evaluate.score_pairs(pairs, labels)
    assert evaluate.n_duplicates(labels).first()[0] == 3
    m = evaluate.dedupe_metrics(scored, labels).first()
    assert (m["pairs"], m["matches"], m["recall"], m["pair_recall"]) == (4, 2, 0.666667, 0.5)
    assert evaluate.search_metrics(scored).first()["recall"] == 0.666667


def test_pack_words(spark):
    docs = [(0, "a b"), (1, ""), (2, None), (3, "c d  e"), (20_000, "f")]
    rows = spark.createDataFrame(docs, "id long, t string")
    flat = " [SEP] ".join(t for _, t in docs if t is not None).split(" ")
    for n in (2, 3, len(flat)):
        want = [" ".join(flat[k : k + n]) for k in range(0, (len(flat) // n + 2) * n, n)]
        assert [r["text"] for r in corpus.pack_words(rows, "id", "t", n).orderBy("chunk").collect()] == want
    assert corpus.sample_rows(rows, "id", 2).count() == 2 and corpus.head(rows, "id", 1).first()["id"] == 0


def test_transformer(spark, names, tmp_path):
    model = CharTransformer(Shape(16, 2, 2, 12))
    out = embed_texts(names, "id", "name", model).collect()
    assert len(out) == len(NAMES) and len(out[0]["vector"]) == 16
    model.save(str(tmp_path / "m.npz"))
    again = CharTransformer.load(str(tmp_path / "m.npz"), model.shape)
    ids = np.full((1, 12), 97)
    assert np.allclose(model.embed(ids), again.embed(ids)) and again.fill(ids).shape == (1, 12)
    with pytest.raises(ValueError):
        model.embed(np.zeros((1, 3), int))


def test_addresses(spark, tmp_path):
    (tmp_path / "data" / "us").mkdir(parents=True)
    (tmp_path / "data" / "us" / "a.geojson").write_text('{"features": [{"properties": {"number": "1", "street": "Elm"}}, {"properties": {"street": "Oak"}}, {"properties": {"number": "2"}}]}')
    (tmp_path / "data" / "us" / "b.geojson").write_text('{"features": [{"properties": {"other": 1}}]}')
    (tmp_path / "data" / "us" / "c.txt").write_text("not read")
    rows = read_addresses(spark, directory=str(tmp_path), recursive=True).collect()
    assert {(r[0], r[1]) for r in rows} == {("us-a", "1 Elm"), ("us-a", "None Oak"), ("us-a", None)}
    assert read_addresses(spark, filename=str(tmp_path / "data/us/a.geojson")).count() == 3
    for bad in ({}, {"directory": "x", "filename": "y"}):
        with pytest.raises(ValueError):
            read_addresses(spark, **bad)


def test_feather(spark, names, tmp_path):
    write_feather(names, str(tmp_path / "x.feather"))
    assert read_feather(spark, str(tmp_path / "x.feather")).orderBy("id").collect() == names.orderBy("id").collect()
    assert read_feather(spark, str(tmp_path / "x.feather"), ["name"]).columns == ["name"]


def test_streamed_probe(spark, names, tmp_path):
    from linkforge.streaming.probe import probe

    names.limit(4).write.parquet(str(tmp_path / "in"))
    index = minhash.lsh_index(names, "id", "name").cache()
    stream = spark.readStream.schema(names.schema).parquet(str(tmp_path / "in"))
    q = probe(index, stream, "id", "name").writeStream.format("memory").queryName("probed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r[0], r[1]) for r in spark.table("probed").collect()} >= {(i, i) for i in range(4)}


@pytest.mark.parametrize("metric", knn.METRICS)
def test_exact_knn_ties(spark, metric):
    """Of 200 equal vectors the least ids are returned, in one block and in several."""
    x = np.random.default_rng(2).standard_normal((400, 8))
    x[np.random.default_rng(3).permutation(400)[:200]] = x[0]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.array([1 - u @ a for a in u]) if metric == "cosine" else ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = np.round(np.sqrt(d) if metric == "l2" else d, 6)
    want = {(i, int(j)) for i in range(400) for j in np.lexsort((np.arange(400), d[i]))[:5]}
    for size in (1 << 20, 8 * 8 * 90):
        assert {(r[0], r[1]) for r in knn.exact_knn(v, v, 5, metric, block_bytes=size).collect()} == want
