import pytest
from pyspark.sql import functions as F

from linkforge.functions import chars, fuzz, strsim, text, vectors

EDGE = ["", "a", "abc", "abcd", "abcd", "  two  spaces ", "é", "日本", "a[MASK]é日", "[SEP][PAD][UNK]", "üýþÿ", None, "x" * 70]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("s", "want"), [("", []), ("abc", []), ("abcd", ["abcd"]), ("abcde", ["abcd", "bcde"]), (None, None)])
def test_shingles(spark, s, want):
    assert one(spark, text.shingle_udf(4)(F.col("v")), s) == want
    assert (one(spark, text.shingles(F.col("v"), 4), s) or None) == (want or None)


def test_word_jaccard(spark):
    assert one(spark, text.word_jaccard(F.col("v"), F.lit("b c")), "a b") == pytest.approx(1 / 3)
    assert one(spark, text.word_jaccard(F.col("v"), F.lit(" ")), "") is None


def test_parse_filename(spark):
    assert one(spark, text.parse_filename(F.col("v")), "../data/us/ct/x.geojson") == "us-ct-x"


@pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("abcd", "axyz", 0.5), ("", "", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, want):
    assert strsim.jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("s", "length", "want"), [("a[MASK]é日", 6, [97, 253, 233, 255, 254, 254]), ("ü", 2, [255, 254]), ("", 2, [254, 254]), ("abc", 2, [97, 98]), (None, 2, None)])
def test_encode(spark, s, length, want):
    assert one(spark, chars.encode(F.col("v"), length), s) == want


def test_decode_and_mask(spark):
    rows = spark.createDataFrame(list(enumerate(EDGE)), "id int, v string").select("id", "v", chars.encode(F.col("v"), 64).alias("ids"))
    for r in rows.select("*", chars.decode(F.col("ids")).alias("d"), chars.mlm_mask(F.col("id"), F.col("ids")).alias("m")).collect():
        if r["v"] is None:
            assert r["m"] is None
            continue
        assert len(r["d"]) == 64
        masked = [i for i, x in enumerate(r["m"]["labels"]) if x != -100]
        n = sum(x not in (252, 253, 254, 255) for x in r["ids"])
        assert len(masked) == int(0.15 * n)
        assert all(r["m"]["input_ids"][i] == 253 and r["m"]["labels"][i] == r["ids"][i] for i in masked)


def test_byte_ids(spark):
    assert one(spark, chars.byte_ids(F.col("v")), "aé") == [100, 198, 172, 1]
    assert one(spark, chars.byte_ids(F.col("v")), "") == [1]


def test_corruptions(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "id int, v string")
    for kind, size in (("insert", lambda n: 2 * n), ("delete", lambda n: 0), ("substitute", lambda n: n), ("transpose", lambda n: n + max(0, n - 1))):
        for r in fuzz.corrupt(rows, kind, "id", "v", "f", 1.0).collect():
            assert r["f"] is None if r["v"] is None else len(r["f"]) == size(len(r["v"]))
        for r in fuzz.corrupt(rows, kind, "id", "v", "f", 0.0).collect():
            assert r["f"] == r["v"] or kind == "delete"
    assert fuzz.corrupt(spark.createDataFrame([(1, "ab")], "id int, v string"), "transpose", "id", "v", "f", 1.0).first()["f"] == "bab"
    once = fuzz.fuzzify(rows, "id", "v", "f", 0.4, 3).collect()
    assert once == fuzz.fuzzify(rows.repartition(3), "id", "v", "f", 0.4, 3).orderBy("id").collect()


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(vectors.l2sq(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("b")), F.size(vectors.pad_to_multiple(F.col("a").cast("array<float>")))).first()
    assert tuple(r) == (2.0, 1.0, 8)
