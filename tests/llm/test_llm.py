"""Operators for training data against brute force, on odd rows and empty tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkforge.llm import decontam, embed_lattice, html, ngram_join, packing, quality, sharding, sstable, substring, toxicity
from tests.llm.conftest import words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shingles(t):
    w = SPLIT.findall((t or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(spark, odd_docs):
    rows = [(i, shingles(t)) for i, t in pairs_of(odd_docs)]
    known = [(i, s) for i, s in rows if i is not None]
    least = {k: i for k, (i, _) in enumerate(known)}
    changed = True
    while changed:
        changed = False
        for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(known), 2):
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    want = sorted([(i, len(s), least[k]) for k, (i, s) in enumerate(known)])
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(odd_docs).collect()]
    assert sorted(x for x in got if x[0] is not None) == want
    assert [x[2] for x in got if x[0] is None] == [None, None]
    assert ngram_join.ngram_join(odd_docs.limit(0)).count() == 0
    kept = ngram_join.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {1, 4, 5, 6, 7, 9, 10, 11, 12, None}


def test_rtree_against_all_pairs():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 12, (12, 128))
    points = (centres[rng.integers(0, 12, 400)] + rng.integers(0, 2, (400, 128))).astype(np.int32)
    tree = ngram_join.RTree(points, 8)
    got = {tuple(sorted((int(a), int(b)))) for i, j in tree.pairs() for a, b in zip(i, j)}
    size = points.sum(axis=1)
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if np.minimum(points[a], points[b]).sum() >= -((-75 * (size[a] + size[b])) // 175) and min(size[a], size[b]) * 100 >= 75 * max(size[a], size[b])}
    assert got == want and 0 < len(want) < 400 * 399 / 2


def test_substring(spark, odd_docs):
    rows = [(i, SPLIT.findall(t or "")) for i, t in pairs_of(odd_docs)]
    first = {}
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in rows:
        gone = {k + d for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for d in range(50)}
        left = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    found = substring.remove_repeats(odd_docs)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in found.collect())
    texts = dict(rows)
    for r in found.filter("n_removed > 0").collect():
        for f in r["factors"]:
            assert f["words"] >= 50 and f["ref_doc"] < r["doc_id"]
            assert texts[r["doc_id"]][f["first"] : f["first"] + f["words"]] == texts[f["ref_doc"]][f["ref_first"] : f["ref_first"] + f["words"]]
    assert substring.remove_repeats(odd_docs.limit(0)).count() == 0
    cut = substring.cut_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and {r[0] for r in cut.collect()} >= {1, 3, 4, 5, 6, None} and 2 not in {r[0] for r in cut.collect()}


def edit(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j - 1] + (x != w), row[j] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination(spark, odd_docs):
    item = words(30, 77)
    edited = item[:5] + ["other"] + item[6:20] + item[21:]
    far = item[:8] + words(22, 50)
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100, " ".join(words(40, 4) + edited + words(9, 6))), (101, " ".join(item).upper()), (102, " ".join(far)), (103, " ".join(words(20, 1) + item[3:]))], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (None, " ".join(item)), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.leaks(docs, bench).collect()}
    low = [w.lower() for w in item]
    want = {(i, 1) for i, t in pairs_of(docs) if i is not None and edit(low, SPLIT.findall((t or "").lower())) <= 6}
    assert set(got) == want == {(100, 1), (101, 1), (103, 1)} and got[101, 1] == 0
    clean = decontam.decontaminate(odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.lit(" ".join(item)))), bench)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.recall(0.0) == 1 and decontam.recall(0.1) > 0.95 and decontam.recall(0.2, 25) > 0.9


def test_short_items(spark):
    """Items of 1 to 16 words, copied, with as many edits as are allowed and with one more."""
    rng = np.random.default_rng(4)
    items = {n: [f"i{n}x{j}" for j in range(n)] for n in range(1, 17)}
    rows = []
    for n, item in items.items():
        for edits in (0, *[n // 5] * 6, n // 5 + 1):
            text = list(item)
            for _ in range(edits):
                kind, at = rng.integers(3), int(rng.integers(len(text))) if text else 0
                text[at : at + (kind < 2)] = ["other"] * int(kind != 1)
            rows.append((len(rows), " ".join([*words(int(rng.integers(3)), 5), *text, *words(int(rng.integers(3)), 6)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(item).upper()) for n, item in items.items()], "item_id long, text string")
    want = {(i, n, d) for i, t in rows for n, item in items.items() if (d := edit(item, t.split())) <= n // 5}
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.leaks(docs, bench).collect()} == want
    left = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _, _ in want}
    assert all(decontam.recall(0.2, n, 100) == 1 for n in (5, 8, 10, 12, 15, 16))


def test_sharding(spark, odd_docs):
    n = 3
    got = sharding.shard_by_bytes(odd_docs, n).collect()
    texts = sorted(map(str, ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs_of(odd_docs))))
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == texts
    for s in range(n):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    sizes = [r["s"] for r in sharding.shard_by_bytes(many, 10).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 60
    assert sharding.shard_by_bytes(odd_docs.limit(0), n).count() == 0


def test_best_bounds():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.sort(rng.choice(200, 9, replace=False) + 1).astype(float)
        counts = rng.integers(1, 20, 9)
        for k in (1, 2, 4):
            cost = lambda b: sum(c * min(x for x in b if x >= l) for l, c in zip(lengths, counts))  # noqa: B023,E731,E741
            best = min(cost([*x, lengths[-1]]) for r in range(k) for x in itertools.combinations(lengths[:-1], r))
            assert cost(packing.best_bounds(lengths, counts, k)) == best


def test_packing(spark, odd_docs):
    got = packing.pack(odd_docs, n_buckets=3, budget=4000).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t in pairs_of(odd_docs))
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["width"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rows in batches.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0]["width"] <= 4000
    assert packing.pack(odd_docs.limit(0)).count() == 0


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("most", [0, 40, 500_000])
def test_encoder_is_the_library(tokenizer, most):
    """Whatever it remembers, known parts, new parts and both in one text give the library's ids."""
    own = sstable.Encoder(tokenizer, most)
    texts = ["", "one two", "two three  one", "it's\n\n x1 , ", "日本 one", "<|endoftext|> two", "\t", " ".join(f"w{i}" for i in range(60))]
    for part in (texts, texts[::-1], [t + " one more" for t in texts]):
        assert own.encode(part) == [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, own.kind).tobytes() for t in part]
        assert len(own.known) <= most


def test_sstable(spark, odd_docs, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    more = spark.createDataFrame([(50, "don't ²³ 日本 <|endoftext|>\x85 a b  c\n\n d_e 'll I'm"), (-3, "  x"), (51, "it's 12 words' end\r\n")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    manifest = sstable.write_tables(docs, tokenizer, out_dir=f"file://{tmp_path}/t")
    got = sorted(sstable.read_tables(spark, manifest).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    model, start, by_id = Tokenizer.from_file(tokenizer), 0, {}
    for i, t in pairs_of(docs):
        by_id.setdefault(i, []).append([*model.encode(t or "", add_special_tokens=False).ids, 2])
    for r in got:
        crcs = {zlib.crc32(np.array(x, "<u4").tobytes()): len(x) for x in by_id[r["doc_id"]]}
        assert crcs[r["ids_crc32"]] == r["n_tokens"] and r["start"] == start
        start += r["n_tokens"]
    shards = [sstable.open_shard(m["path"]) for m in manifest]
    for i, want in by_id.items():
        assert sorted(x.tolist() for s in shards for x in s.get(i)) == sorted(want)
    assert all(s.get(999) == [] for s in shards)
    assert sstable.read_tables(spark, sstable.write_tables(docs.limit(0), tokenizer)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.12 * rng.standard_normal(16)).tolist()) for i in range(160)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [None] * 16), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, []), (209, [1e300] * 16), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, copies long, _v double")
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = {(i, j) for i in unit for j in unit if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95}
    least = {i: i for i, _ in rows if i is not None}
    while True:
        new = {i: min([least[i], *[least[j] for a, j in links if a == i]]) for i in least}
        if new == least:
            break
        least = new
    got = {r["vec_id"]: r for r in embed_lattice.link_embeddings(df).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert 0.97 * len(links) <= found <= len(links)
    assert got[200]["component_id"] == got[201]["component_id"] == least[200] and got[206]["n_links"] == got[207]["n_links"] == 1
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (202, 203, 204, 205, 208)) and got[None]["component_id"] is None
    assert sum(got[i]["component_id"] == least[i] for i in least) >= 0.97 * len(least)
    assert embed_lattice.link_embeddings(df.limit(0)).count() == 0


def test_e8_is_nearest():
    x = np.random.default_rng(1).standard_normal((300, 8)) * 2
    p, m = embed_lattice.decode_e8(x) / 2, embed_lattice.minimal_vectors() / 2
    assert m.shape == (240, 8) and np.allclose((m**2).sum(axis=1), 2)
    assert (((x - p) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - p[:, None] - m) ** 2).sum(axis=2) + 1e-9).all()


def labelled(spark, bad, n=400):
    rows = [(i, " ".join(words(20 + i % 60, i)) if i % 4 else bad(i), int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], 1 - r[2], r[2]) for r in rows], "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_quality(spark, odd_docs):
    docs, labels = labelled(spark, lambda i: " ".join(f"{w.upper()}!!" for w in words(30, i)))
    model = quality.train_quality(docs, labels)
    assert accuracy(quality.score_quality(docs, model), labels, "quality") > 0.95
    odd = quality.score_quality(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    kept = quality.filter_quality(odd_docs.unionByName(odd_docs.limit(0)), labels)
    assert kept.columns == odd_docs.columns
    assert quality.score_quality(odd_docs.limit(0), model).count() == 0
    none = quality.score_quality(odd_docs, quality.train_quality(odd_docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    # a document's score doesn't depend on what stands beside it
    alone = quality.score_quality(spark.createDataFrame([(7, "  one two")], "doc_id long, text string"), model).first()["score"]
    beside = quality.score_quality(spark.createDataFrame([(6, " \t "), (7, "  one two"), (8, " z")], "doc_id long, text string").coalesce(1), model).filter("doc_id = 7").first()["score"]
    assert alone == pytest.approx(beside)


def test_attention_gradient():
    """Gradients against differences of the loss, passage by passage weighed anew."""
    rng = np.random.default_rng(1)
    bounds, y = np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    x = rng.standard_normal((7, 4))
    w = {k: rng.standard_normal(s) for k, s in {"encode": (4, 3), "encode_b": (3,), "v": (3, 2), "u": (3, 2), "a": (2,), "out": (3,), "out_b": ()}.items()}

    def loss():
        total = 0.0
        for a, b, label in zip(bounds[:-1], bounds[1:], y):
            code = np.tanh(x[a:b] @ w["encode"] + w["encode_b"])
            e = np.exp((np.tanh(code @ w["v"]) / (1 + np.exp(-(code @ w["u"])))) @ w["a"])
            z = (e / e.sum()) @ code @ w["out"] + w["out_b"]
            total += np.log1p(np.exp(z)) - label * z
        return total / len(y)

    for k, g in quality._gradients(w, x, bounds, y).items():
        for at in np.ndindex(w[k].shape):
            kept, value = w[k], []
            for step in (1e-5, -1e-5):
                w[k] = kept.copy()
                w[k][at] += step
                value.append(loss())
            w[k] = kept
            assert (value[0] - value[1]) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_attention_learns():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 5, 60)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.standard_normal((bounds[-1], 3)).astype(np.float32)
    y = np.array([x[a:b, 0].max() > 1 for a, b in zip(bounds[:-1], bounds[1:])]).astype(int)
    model = quality.fit_attention(x, bounds, y, epochs=400)
    score, weight = model.score(x, bounds)
    assert ((score > 0.5) == y).mean() > 0.9 and np.allclose(np.add.reduceat(weight, bounds[:-1]), 1)


def test_toxicity(spark, odd_docs):
    insults = ["nitwit", "blockhead", "dunce"]
    docs, labels = labelled(spark, lambda i: " ".join(w if k % 9 else insults[(i + k) % 3] for k, w in enumerate(words(40, i))))
    model = toxicity.train_toxicity(docs, labels)
    assert accuracy(toxicity.score_toxicity(docs, model), labels, "toxic") > 0.95
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_toxicity(odd_docs.limit(0), model).count() == 0
    assert toxicity.train_toxicity(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, None).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div><div class="ad">Buy &amp; save</div>
<article><h1>Head &amp; line</h1><p>First   para&nbsp;of
text.<p><b>Second<br>one.</b><ul><li>x<li>y</ul><div class="share">Share</div><section id=comments><p>Nice!</p></section></article>
<aside>Side</aside><form><label>Mail</label></form><footer>&copy; us</footer>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Head & line\nFirst para of text.\nSecond one.\nx\ny"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "u", ""), (4, "u", "<p>a <"), (4, "u", "<!-- open"), (5, "u", "<p>" + "w " * 100_000), (6, "u", '<p title="x>y">q</p>' + "<div>" * 500)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract_text(pages.withColumn("text", F.lit(1))).collect()}
    assert got[2]["text"] == "" and got[None]["n_chars"] == 0 and got[5]["n_chars"] == 199_999 and got[6]["text"] == "q"
    assert html.extract_text(pages.limit(0)).count() == 0
