"""The stages on odd rows, on empty tables and against brute force on small documents."""

import os

import pytest

from linkforge.llm import decontam, quality
from tests.llm.conftest import words
from tests.llm.test_llm import SPLIT, edit, shingles

FOLDER = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, `a.b` string, _row int, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables of a folder: good and bad documents, near copies, shared passages, leaks, odd rows."""
    folder = tmp_path_factory.mktemp("tables")
    passage, item = words(60, 800), words(30, 900)
    texts = {i: " ".join(words(70 + i % 9, i)) for i in range(80)}
    texts |= {i: " ".join(f"{w.upper()}!!" for w in words(40, i)) for i in range(80, 130)}
    texts |= {130: texts[3], 131: texts[4] + " more", 132: " ".join([*words(40, 300), *passage]), 133: " ".join([*passage, *words(40, 301)])}
    texts |= {134: " ".join([*words(30, 302), *item, *words(30, 303)]), 135: "", 136: None, 137: " \n", 138: "One two"}
    rows = [(i, t, "en", "x", 1, len(t or "")) for i, t in texts.items()]
    rows += [(None, texts[5], "en", "x", 1, 0), (None, None, "en", "x", 1, 0), (139, texts[6], "en", "x", 1, 0), (139, " ".join(words(80, 304)), "en", "x", 1, 0)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(130)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least, changed = {k: i for k, (i, _) in enumerate(rows)}, True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return [r for k, r in enumerate(rows) if r[0] is None or least[k] == r[0]]


def brute_passages(rows):
    first, out = {}, []
    for i, t in rows:
        w = SPLIT.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = {k + d for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for d in range(50)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_stages_against_brute_force(spark, corpus):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = quality.train_quality(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").filter("item_id = 1").first()["text"].split()
    for (name, stage), columns in zip(c.STAGES[:-1], [docs.columns] * 4):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, corpus)
        assert out.columns == columns, name
        if name.startswith("quality"):
            score = [float(model.score(*next(quality.passages(_array(t))))[0][0]) for _, t in before]
            want = [r for r, s in zip(before, score) if s >= 0.3]
            kept = {i for i, _ in want}
            assert kept >= set(range(80)) and not kept & set(range(80, 130))
        elif name.startswith("n-gram"):
            want = brute_near(before)
            assert {130, 131} & {i for i, _ in want} == set()
        elif name.startswith("substring"):
            want = brute_passages(before)
            assert dict(want)[133] != dict(before)[133]
        else:
            want = [r for r in before if edit(item, SPLIT.findall((r[1] or "").lower())) > decontam.allowed(30)]
            assert 134 not in {i for i, _ in want}
        assert rows_of(out) == sorted(want, key=str), name
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = c.STAGES[-1][1](spark, docs, corpus)
    assert rows_of(packed) == rows_of(docs)
    check_batches(packed.collect())


def _array(text):
    import pyarrow as pa

    return pa.array([text], pa.string())


def check_batches(rows, budget=65_536):
    """Buckets by length; in each, batches filled in the order of length and id, each as full as the budget allows."""
    tokens = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    assert all(r["n_tokens"] == len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows)
    for bucket in {r["bucket"] for r in rows}:
        own = sorted((r for r in rows if r["bucket"] == bucket), key=lambda r: (r["batch"], r["slot"]))
        width = {r["width"] for r in own}
        assert len(width) == 1 and max(r["n_tokens"] for r in own) == max(width)
        order = [(r["n_tokens"], r["doc_id"] is not None, r["doc_id"] or 0) for r in own]
        assert order == sorted(order)
        per = max(1, budget // max(width))
        assert [(r["batch"], r["slot"]) for r in own] == [(k // per, k % per) for k in range(len(own))]


def test_empty_table(spark, corpus):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and out.count() == 0
    assert c.STAGES[-1][1](spark, docs, corpus).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_given_tables(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = c.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "bucket", "width", "batch", "slot", "text"]
    assert 0.5 * docs.count() < out.count() < docs.count()
