"""Joins in blocks, verified pairs, corpora, shared vocabulary rows and the forward pass, each against a plain version."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.functions import strsim, vectors
from linkforge.functions.chars import encode
from linkforge.operators import corpus, dedupe, evaluate, knn, minhash, svd, tfidf
from linkforge.operators.transformer import CharTransformer, Shape, embed_texts, softmax
from linkforge.sources import address, embedding_table


def test_products_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"t{t}", float(w)) for i in range(60) for t, w in zip(rng.choice(40, 6, replace=False), rng.integers(1, 4, 6))]
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    x = np.zeros((60, 40))
    for i, t, w in rows:
        x[i, int(t[1:])] = w
    s = x @ x.T
    for block_rows, others in ((100, True), (13, True), (13, False)):
        got = {(r[0], r[1]): r[2] for r in tfidf.products_top_k(weights, weights, 4, others, "s", block_rows).collect()}
        want = {}
        for i in range(60):
            near = [(-s[i, j], j) for j in range(60) if s[i, j] > 0 and not (others and i == j)]
            want |= {(i, j): -v for v, j in sorted(near)[:4]}
        assert got == want
    assert tfidf.products_top_k(weights, weights.limit(0), 4, True, "s").count() == 0


def test_verified_pairs(spark):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abcdef "), 60)) for _ in range(20)]
    texts = [b[:k] + "xyz" + b[k:] for b in base for k in (5, 30, 55)] + [base[0], base[0], "abc", "abc", "", None, "日本語テキスト"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = [{t[i : i + 4] for i in range(len(t) - 3)} if t else set() for t in texts]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j]}
    want = {p: v for p, v in want.items() if v >= 0.6}
    got = {(r[0], r[1]): r[2] for r in minhash.verified_pairs(rows, "id", "t", 128, 0.6).collect()}
    assert all(got[p] == pytest.approx(want[p]) for p in got) and len(got) >= 0.9 * len(want) and (60, 61) in got


def test_groups_of_copies(spark):
    """A text that many rows have is one member of a pair; all pairs of rows come from these and the members."""
    texts = ["the same text here"] * 30 + ["the same text her"] * 2 + ["quite another string"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found, members = minhash.lsh_groups(rows, "id", "t")
    assert found.count() <= 9 and {(r["rep"], r["id"]) for r in members.collect()} == {(texts.index(t), i) for i, t in enumerate(texts)}
    assert minhash.lsh_pairs(rows, "id", "t").count() == 32 * 32 + 1


def test_ivf_reaches_its_recall(spark):
    """Cells follow the number of rows and probes the recall, on vectors without any clusters."""
    x = np.random.default_rng(1).standard_normal((1500, 24))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, 1:6]
    near = {(r[0], r[1]) for r in knn.ivf_knn(v, v, 6).collect()}
    assert np.mean([(i, j) in near for i in range(1500) for j in want[i].tolist()]) >= 0.9
    with pytest.raises(ValueError):
        knn.ivf_knn(v, v, 6, metric="cosine")


def test_edges_both_ways(spark):
    found = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (2, 1, 3.0), (1, 0, 1.0)], "orig_idxs long, match_idxs long, distance double")
    assert {tuple(r) for r in knn.edges(found).collect()} == {(0, 1, 1.0)}
    assert {tuple(r) for r in knn.edges(found, symmetric=True).collect()} == {(0, 1, 1.0), (1, 2, 3.0)}
    assert knn.edges(found, 2.0, True).count() == 1


def test_vocabulary_rows_shared_by_hash(spark):
    names = spark.createDataFrame([(i, f"name {i % 7} of {i % 11}") for i in range(60)], "id long, name string")
    model = tfidf.fit(names, "id", "name")
    weights = model.transform(names, "id", "name").cache()
    own = svd.fit(weights, 4, most_terms=10)
    assert len(own.terms) <= 10 and own.shared == 10
    rows = own.transform(weights).collect()
    assert len(rows) == 60 and all(len(r["vector"]) == 4 and any(r["vector"]) for r in rows)
    assert svd.fit(weights, 4).shared == 0


def test_default_passes_are_enough(spark):
    names = spark.createDataFrame([(i, f"part {i * 37 % 101} kind {i * 13 % 17} x{i}") for i in range(200)], "id long, name string")
    weights = tfidf.fit(names, "id", "name").transform(names, "id", "name").cache()
    rows = weights.collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    x = np.zeros((200, len(terms)))
    for r in rows:
        x[r["id"], terms[r["term"]]] = r["weight"]
    assert svd.fit(weights, 32).values == pytest.approx(np.linalg.svd(x, compute_uv=False)[:32], rel=0.02)


def test_corpora(spark):
    rows = spark.createDataFrame([(i, f"a{i} b c") for i in range(50)] + [(50, None)], "id long, t string")
    assert {r["text"].count(" ") for r in corpus.prepare_corpus(rows, "id", "t", 8).orderBy("id").limit(20).collect()} == {7}
    assert corpus.prepare_corpus(rows, "id", "t", 8, subset_size=3).count() == 3 and corpus.prepare_corpus(rows, "id", "t", pack=False).count() == 50
    order = [r["id"] for r in corpus.shuffled(rows, "id").collect()]
    assert sorted(order) == list(range(51)) and order != sorted(order) and order == [r["id"] for r in corpus.shuffled(rows.repartition(3), "id").collect()]
    got = corpus.batches(rows, "id", 8).groupBy("batch").count().collect()
    assert sorted(r["batch"] for r in got) == list(range(6)) and {r["count"] for r in got} == {8}
    assert corpus.batches(rows, "id", 8, drop_last=False).count() == 51 and corpus.batches(rows.limit(0), "id", 8).count() == 0
    drawn = corpus.sample_with_replacement(rows, "id", 200).collect()
    assert len(drawn) == 200 and 30 < len({r["id"] for r in drawn}) < 51
    assert corpus.sample_with_replacement(rows.limit(0), "id", 5).count() == 0
    steps = spark.createDataFrame([(i, float(i)) for i in range(20)], "step long, loss double")
    assert [r["mean"] for r in corpus.running_mean(steps, "step", "loss", 3).orderBy("step").collect()][-2:] == [17.0, 18.0]
    for block in (3, 7):  # a block's first rows look back on the one before
        assert {r["step"]: r["mean"] for r in corpus.running_mean(steps, "step", "loss", 3, block=block).collect()} == {i: np.mean(range(max(0, i - 2), i + 1)) for i in range(20)}
    two = steps.withColumn("run", F.col("step") % 2)
    for block in (100, 4):
        assert {r["step"]: r["mean"] for r in corpus.running_mean(two, "step", "loss", 2, "run", block).collect()} == {i: float(max(i - 1, i % 2)) for i in range(20)}


def test_addresses_from_texts(spark):
    good = '{"features": [{"properties": {"number": "1", "street": "A St"}}, {"properties": {"street": "B St"}}, {"properties": {"number": "3"}}]}'
    poor = '{"features": [{"properties": {"number": "1"}}]}'
    files = spark.createDataFrame([("/x/data/us/a.geojson", good), ("/x/data/us/b.geojson", poor), ("/x/data/us/c.geojson", None)], "path string, content string")
    got = [tuple(r) for r in address.parse_addresses(files).collect()]
    assert sorted(got, key=str) == [("us-a", "1 A St"), ("us-a", "None B St"), ("us-a", None)]


def test_embedding_tables(spark, tmp_path):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "token_id int, vec array<float>")
    embedding_table.write_embedding_table(table, str(tmp_path))
    assert embedding_table.read_embedding_table(spark, str(tmp_path), "base").count() == 5
    metrics = spark.createDataFrame([(1, 0.5)], "pairs long, recall double")
    for k in (5, 10):
        evaluate.write_metrics(metrics, str(tmp_path / "m"), call="dedupe_knn", k=k)
    assert {r["k"] for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {5, 10}


def test_jaro_winkler_many(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcé "), int(n))) for n in rng.integers(0, 12, 300)] + ["MARTHA", "DIXON", "日本語", "\U0001f600x"]
    other = ["".join(rng.choice(list("abcé "), int(n))) for n in rng.integers(0, 12, 300)] + ["MARHTA", "DICKSONX", "日本", "x\U0001f600"]
    for rows in (7, 4096):
        assert strsim.jaro_winkler_many(words, other, rows) == pytest.approx([strsim.jaro_winkler(a, b) for a, b in zip(words, other)], abs=1e-12)
    assert len(strsim.jaro_winkler_many([], [])) == 0 and strsim.jaro_winkler_many(["", "a"], ["", ""]).tolist() == [0, 0]
    df = spark.createDataFrame([(0, "MARTHA", "MARHTA"), (1, None, "x"), (2, "a", None), (3, "", "")], "id long, a string, b string").coalesce(1)
    got = {r["id"]: r["s"] for r in df.select("id", strsim.jaro_winkler_udf()("a", "b").alias("s")).collect()}
    assert got == {0: pytest.approx(0.961111, abs=1e-6), 1: None, 2: None, 3: 0}
    got = {r["id"]: r["v"] for r in df.select("id", strsim.similarity_vector(["MARHTA", "x"])("a").alias("v")).collect()}
    assert got[1] is None and got[0] == pytest.approx([0.961111, 0], abs=1e-6)


def test_vector_functions(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0] * 8), (3, [1.0] * 9)], "id long, v array<double>")
    got = {r["id"]: r for r in df.select("id", vectors.pad_to_multiple(F.col("v")).alias("p"), vectors.normalize(F.col("v")).alias("n")).collect()}
    assert [len(got[i]["p"]) for i in (1, 2, 3)] == [8, 8, 16] and got[1]["p"][2:] == [0.0] * 6
    assert got[1]["n"] == pytest.approx([0.6, 0.8]) and sum(x * x for x in got[3]["n"]) == pytest.approx(1)
    x = np.array([[1.0, 2.0, 3.0], [1000.0, 1000.0, 1000.0]])
    assert softmax(x).sum(axis=1) == pytest.approx([1, 1]) and softmax(x)[0] == pytest.approx(np.exp(x[0]) / np.exp(x[0]).sum())


def forward(model, ids):
    """The same network for one row, number by number."""
    w, s = model.w, model.shape
    d, hd = s.dim, s.dim // s.heads

    def norm(v, name):
        mean = sum(v) / d
        var = sum((x - mean) ** 2 for x in v) / d
        return [(x - mean) / math.sqrt(var + 1e-5) * a + b for x, a, b in zip(v, w[f"{name}_scale"], w[f"{name}_shift"])]

    def times(v, m, bias=None):
        return [sum(v[i] * m[i][j] for i in range(len(v))) + (bias[j] if bias is not None else 0) for j in range(m.shape[1])]

    gelu = lambda x: x * 0.5 * (1 + math.erf(x / math.sqrt(2)))
    x = []
    for t, c in enumerate(ids):
        place = [math.sin(t / 10_000 ** (i / d)) if i % 2 == 0 else math.cos(t / 10_000 ** ((i - 1) / d)) for i in range(d)]
        x.append(norm([a + b for a, b in zip(w["embed"][c], place)], "in"))
    for n in range(s.layers):
        qkv = [times(norm(v, f"{n}.n1"), w[f"{n}.qkv"]) for v in x]
        mixed = [[0.0] * d for _ in x]
        for h in range(s.heads):
            q, k, v = ([row[part * d + h * hd : part * d + (h + 1) * hd] for row in qkv] for part in range(3))
            for t in range(len(x)):
                e = [math.exp(sum(a * b for a, b in zip(q[t], other)) / math.sqrt(hd)) for other in k]
                for j in range(hd):
                    mixed[t][h * hd + j] = sum(a * other[j] for a, other in zip(e, v)) / sum(e)
        x = [[a + b for a, b in zip(v, times(m, w[f"{n}.proj"]))] for v, m in zip(x, mixed)]
        inner = [[gelu(a) for a in times(norm(v, f"{n}.n2"), w[f"{n}.fc1"], w[f"{n}.fc1_b"])] for v in x]
        x = [[a + gelu(b) for a, b in zip(v, times(m, w[f"{n}.fc2"], w[f"{n}.fc2_b"]))] for v, m in zip(x, inner)]
    x = [norm(v, "out") for v in x]
    return [sum(column) / len(x) for column in zip(*x)]


def test_forward_pass(spark):
    model = CharTransformer(Shape(8, 2, 2, 6, 2), seed=3)
    rng = np.random.default_rng(0)
    for k, v in model.w.items():  # larger weights than a fresh model's, and no zeros or ones
        model.w[k] = v + rng.normal(0, 0.5, v.shape)
    rows = spark.createDataFrame([(1, "ab"), (2, "a[MASK]é"), (3, "")], "id long, t string")
    ids = {r["id"]: r["e"] for r in rows.select("id", encode(F.col("t"), 6).alias("e")).collect()}
    got = {r["id"]: r["vector"] for r in embed_texts(rows, "id", "t", model).collect()}
    for i in (1, 2, 3):
        assert got[i] == pytest.approx(forward(model, ids[i]), abs=1e-5)
    pairs = dedupe.dedupe_char_transformer(spark.createDataFrame([(0, "same"), (1, "same"), (2, "other")], "id long, t string"), "id", "t", model, 2)
    assert {(r[0], r[1]): r[2] for r in pairs.collect()}[0, 1] == pytest.approx(0)
