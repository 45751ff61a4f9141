"""Arrow IPC files as a data source: a partition for each record batch, pruned columns, folders."""

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest

from linkforge.sources import arrow_source


@pytest.fixture
def folder(tmp_path):
    for k in range(2):
        schema = pa.schema([("id", pa.int64()), ("name", pa.string()), ("x", pa.list_(pa.float64()))])
        with ipc.new_file(str(tmp_path / f"{k}.arrow"), schema) as out:
            for b in range(3):
                ids = [k * 30 + b * 10 + i for i in range(10)]
                out.write_batch(pa.record_batch([ids, [f"n{i}" if i % 4 else None for i in ids], [[float(i)] for i in ids]], schema=schema))
    (tmp_path / "_SUCCESS").write_text("")
    return tmp_path


def test_batches_and_columns(spark, folder):
    arrow_source.register(spark)
    df = spark.read.format("arrow_file").load(str(folder))
    assert df.columns == ["id", "name", "x"] and df.rdd.getNumPartitions() == 6
    assert sorted((r["id"], r["name"], r["x"]) for r in df.collect()) == [(i, f"n{i}" if i % 4 else None, [float(i)]) for i in range(60)]
    assert spark.read.format("arrow_file").option("batches", 3).load(str(folder)).rdd.getNumPartitions() == 2
    few = spark.read.format("arrow_file").schema("name string").load(f"file://{folder}/0.arrow")
    assert few.columns == ["name"] and few.count() == 30
    for where in ("id >= 42 AND name IS NOT NULL", "name IS NULL", "id = 7", "id < 5 OR id > 55", "upper(name) = 'N9'"):
        assert sorted(r["id"] for r in df.filter(where).collect()) == sorted(r["id"] for r in spark.createDataFrame([(i, f"n{i}" if i % 4 else None) for i in range(60)], "id long, name string").filter(where).collect())
    # the reader itself reads what is asked for only
    reader = arrow_source.ArrowReader(str(folder), few.schema, 1)
    assert [b.schema.names for b in reader.read(reader.partitions()[0])] == [["name"]]
    assert arrow_source._opened(str(folder), str(folder / "0.arrow"), ["x"]).schema.names == ["x"]


def test_no_files(spark, tmp_path):
    arrow_source.register(spark)
    with pytest.raises(Exception, match="no files"):
        spark.read.format("arrow_file").load(str(tmp_path)).count()
