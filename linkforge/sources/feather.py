"""Arrow IPC (Feather) files as tables, and tables as Feather files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Files under a path that Spark can list, each read whole by one task."""
    files = spark.read.format("binaryFile").load(path)

    def schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield pa.RecordBatch.from_pydict({"s": pa.array([ipc.open_file(pa.BufferReader(content.as_buffer())).schema.serialize().to_pybytes()], pa.binary())})

    # a task reads the schema of one file; the driver gets the schema alone
    schema = ipc.read_schema(pa.py_buffer(files.select("content").limit(1).mapInArrow(schemas, "s binary").first()[0]))
    schema = pa.schema([schema.field(c) for c in columns]) if columns else schema

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from feather.read_table(pa.BufferReader(content.as_buffer()), columns=schema.names).cast(schema).to_batches()

    return files.select("content").mapInArrow(f, from_arrow_schema(schema))


def write_feather(df: DataFrame, path: str) -> None:
    """One local file, written batch by batch as rows come to the driver, a partition at a time."""
    schema = df.limit(0).toArrow().schema
    with ipc.new_file(path, schema) as out:
        for rows in _partitions(df, schema):
            out.write_batch(rows)


def _partitions(df: DataFrame, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"b": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for r in df.mapInArrow(packed, "b binary").toLocalIterator():
        for batch in ipc.open_stream(pa.py_buffer(r["b"])):
            yield pa.Table.from_batches([batch]).cast(schema).combine_chunks().to_batches()[0] if len(batch) else batch.cast(schema)
