"""Tables that are written once and read again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session in one local process that leaves it unset (tests) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidecast-"))
        base = spark.sparkContext.getCheckpointDir()
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Saved:
    """A folder of saved tables. A lost executor costs a re-read; what isn't dropped goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.saved_path = path
        return out

    def drop(self, what: DataFrame | str) -> None:
        path = what if isinstance(what, str) else what.saved_path
        try:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session may be gone at exit
            pass
