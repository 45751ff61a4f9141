"""Arrow IPC files as a data source of Spark: ``spark.read.format("arrow_file")``.

Each record batch of each file is a partition, read by itself through the
file's footer; columns that the given schema doesn't name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

def _files(path: str) -> list[str]:
    """The file of a path or, of a folder, its files by name, those that begin with a dot or an underscore left out."""
    fs, place = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.File:
        return [place]
    found = fs.get_file_info(pafs.FileSelector(place, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def _opened(path: str, place: str, columns: list[str] | None = None) -> ipc.RecordBatchFileReader:
    fs, _ = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    file = fs.open_input_file(place)
    if columns is None:
        return ipc.open_file(file)
    names = ipc.open_file(file).schema.names
    return ipc.open_file(file, options=ipc.IpcReadOptions(included_fields=sorted(names.index(c) for c in columns), use_threads=False))


@dataclass
class BatchPartition(InputPartition):
    file: str
    first: int
    last: int

    def __init__(self, file: str, first: int, last: int):
        super().__init__((file, first, last))
        self.file, self.first, self.last = file, first, last


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, batches: int):
        self.path, self.schema, self.batches = path, schema, batches

    def partitions(self) -> list[BatchPartition]:
        """``batches`` record batches each, one unless the option says otherwise; footers alone are read here."""
        out = []
        for file in _files(self.path):
            n = _opened(self.path, file).num_record_batches
            out += [BatchPartition(file, a, min(n, a + self.batches)) for a in range(0, n, self.batches)]
        return out

    def read(self, partition: BatchPartition) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        source, target = _opened(self.path, partition.file, names), to_arrow_schema(self.schema)
        for k in range(partition.first, partition.last):
            batch = source.get_batch(k)
            if len(batch):
                yield pa.Table.from_batches([batch]).select(names).cast(target).combine_chunks().to_batches()[0]


class ArrowFileSource(DataSource):
    """Options: ``path``, and ``batches`` for how many record batches a partition reads.

    Without a schema all columns of the first file are read; ``.schema(...)``
    with some of them reads these alone.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no files under {self.options['path']}")
        return from_arrow_schema(_opened(self.options["path"], files[0]).schema)

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options["path"], schema, int(self.options.get("batches", "1")))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(ArrowFileSource)
