"""Tables written between the steps of an operator, in the folder that all machines share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Tables:
    """A folder of Parquet tables: lineage ends at each, so a lost executor costs the step since, and no filter moves behind it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended, or the folder is gone
            pass

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_to = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._written_to)


def written(df: DataFrame) -> DataFrame:
    return Tables(df.sparkSession).written(df)
