"""A MinHash band index kept as a bucketed table: probed without moving it, and added to."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.operators.minhash import band_shape, bands, signatures


@dataclass
class BandIndex:
    """An index under a folder that all machines share: ``bands`` (band, bucket, match_idxs), bucketed by the first two, and ``about``, a row with its shape."""

    spark: SparkSession
    folder: str
    n: int
    threshold: float
    size: int
    buckets: int
    id_kind: str
    table: str

    @classmethod
    def create(cls, df: DataFrame, id_col: str, text_col: str, folder: str, n: int = 128, threshold: float = 0.6, size: int = 4, buckets: int | None = None) -> BandIndex:
        """A new index with the rows of a table; as many buckets as the session's shuffles have partitions unless given."""
        spark = df.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        about = spark.createDataFrame([(n, float(threshold), size, buckets, dict(df.dtypes)[id_col])], "n int, threshold double, size int, buckets int, id_kind string")
        about.coalesce(1).write.parquet(f"{folder}/about")
        own = cls.open(spark, folder)
        own.insert(df, id_col, text_col)
        return own

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> BandIndex:
        """An index that another session may have written."""
        r = spark.read.parquet(f"{folder}/about").first()
        if not re.fullmatch(r"[\w<>(),: ]+", r["id_kind"]):
            raise ValueError(f"not a type: {r['id_kind']}")
        own = cls(spark, folder, r["n"], r["threshold"], r["size"], r["buckets"], r["id_kind"], f"band_index_{uuid.uuid4().hex}")
        place = folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {own.table} (band INT, bucket BIGINT, match_idxs {own.id_kind}) USING parquet CLUSTERED BY (band, bucket) SORTED BY (band, bucket) INTO {own.buckets} BUCKETS LOCATION '{place}/bands'")
        return own

    def _filed(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return bands(signatures(df, id_col, text_col, self.n, self.size), *band_shape(self.threshold, self.n))

    def insert(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Adds rows: new files in the buckets that they belong to; what is there stays as it is."""
        rows = self._filed(df, id_col, text_col).select("band", "bucket", F.col("id").cast(self.id_kind).alias("match_idxs"))
        # dealt as the buckets are, so a task writes few files
        rows.repartition(self.buckets, "band", "bucket").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def search(self, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(orig_idxs, match_idxs) of queries and the rows that share a bucket; a query without any has a null match.

        The queries' bands are dealt as the index is, bucket by bucket; the
        index is read where it lies and not shuffled.
        """
        filed = self._filed(queries, id_col, text_col)
        found = filed.hint("shuffle_hash").join(self.spark.table(self.table), ["band", "bucket"]).select(F.col("id").alias("orig_idxs"), "match_idxs").distinct()
        return queries.select(F.col(id_col).alias("orig_idxs")).join(found, "orig_idxs", "left")

    def compact(self) -> BandIndex:
        """The same index in a new folder beside this one, a file for each bucket again, after many inserts."""
        folder = f"{self.folder}-{uuid.uuid4().hex[:8]}"
        self.spark.read.parquet(f"{self.folder}/about").coalesce(1).write.parquet(f"{folder}/about")
        own = BandIndex.open(self.spark, folder)
        # its files, which say nothing of buckets, or Spark would take the rows as dealt already and write each task's
        self.spark.read.parquet(f"{self.folder}/bands").select("band", "bucket", "match_idxs").repartition(self.buckets, "band", "bucket").write.insertInto(own.table)
        self.spark.catalog.refreshTable(own.table)
        return own

    def close(self) -> None:
        """Forgets the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
