"""Text datasets in each form."""

import gzip
import json

import pytest

from linkforge.operators import corpus
from linkforge.sources.texts import read_texts, with_ids


def test_forms(spark, tmp_path):
    lines = ["first line", "", "second, \"quoted\" line", "  ", "naïve 日本"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("zipped line\n")
    texts = lambda df: sorted(r["text"] for r in df.collect())
    kept = sorted(t for t in lines if t.strip())
    assert texts(read_texts(spark, str(tmp_path / "a.txt"))) == kept
    assert len(texts(read_texts(spark, str(tmp_path / "a.txt"), keep_empty=True))) == 5
    assert texts(read_texts(spark, str(tmp_path / "*.txt*"))) == sorted([*kept, "zipped line"])
    assert texts(read_texts(spark, str(tmp_path / "a.txt"), "files")) == ["\n".join(lines)]
    assert texts(read_texts(spark, str(tmp_path / "a.txt"), "paragraphs")) == sorted(["first line", 'second, "quoted" line', "naïve 日本"])
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": i, "body": t}) for i, t in enumerate([*lines, None])))
    assert texts(read_texts(spark, str(tmp_path / "c.jsonl"), "jsonl", "body")) == kept
    (tmp_path / "d.csv").write_text('n,text\n1,"two\nlines"\n2,"say ""so"""\n3,\n')
    assert texts(read_texts(spark, str(tmp_path / "d.csv"), "csv")) == ['say "so"', "two\nlines"]
    spark.createDataFrame([(1, "x y"), (2, None)], "id long, text string").write.parquet(str(tmp_path / "e"))
    assert texts(read_texts(spark, str(tmp_path / "e"), "parquet")) == ["x y"]
    with pytest.raises(ValueError):
        read_texts(spark, "x", "xml")


def test_into_a_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i:02d}" for i in range(20)))
    rows = with_ids(read_texts(spark, str(tmp_path / "a.txt")))
    assert [(r["id"], r["text"]) for r in rows.orderBy("id").collect()] == [(i, f"line {i:02d}") for i in range(20)]
    chunks = corpus.prepare_corpus(rows, "id", "text", 6).orderBy("id").collect()
    assert chunks[0]["text"] == "line 00 [SEP] line 01 [SEP]" and len(chunks) == 10
