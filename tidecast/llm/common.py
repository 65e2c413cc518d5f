"""Shared plumbing of the training-data operators: tables, scratch storage, guarded broadcasts, connected groups."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast at most (8 bytes each, so 4 MB of values); beyond it the same join shuffles.
BROADCAST_IDS = 500_000
#: Spark's setting by which an execution's shuffle files go when it ends, instead of at the driver's next collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session in one local process may leave it unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidecast-"))
        base = spark.sparkContext.getCheckpointDir()
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder so that a lost executor costs a re-read only.

    drop() removes a table once its readers are saved, keep() all but those that a lazily returned result still reads;
    what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        atexit.register(self.drop, self.root)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{len(self.paths) + 1:03d}-{name}"
        self.paths.append(path)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # the written table stands for its shuffles
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, what) -> None:
        """Removes a saved table, or a path; a DataFrame that isn't a saved table itself is left alone."""
        path = what if isinstance(what, str) else getattr(what, "scratch_path", None)
        if path is None:
            return
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            pass

    def keep(self, *tables: DataFrame) -> None:
        """Drops every saved table but these."""
        kept = {t.scratch_path for t in tables}
        for path in self.paths:
            if path not in kept:
                self.drop(path)


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """df joined with a saved table of ids (or an id and a few numbers): broadcast where its counted rows are few, shuffled otherwise."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, key, how)


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) of every id in edges: comp is the smallest id reachable. Min-label rounds with pointer jumping.

    Every round hands on the smallest label across links (partially aggregated, so a hub doesn't meet in one task),
    then lets each label jump to its own label's label, until nothing changes; rounds grow with the logarithm of a
    chain's length.
    """
    both = scratch.save(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").union(edges.select(F.col(b).alias("u"), F.col(a).alias("v")).where("u <> v")).distinct(), "links")
    labels = scratch.save(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("heard"))
        near = scratch.save(labels.join(heard, "id").select("id", F.least("comp", "heard").alias("near"), "comp"), "near")
        jump = near.select(F.col("id").alias("near"), F.col("near").alias("far"))
        far = F.least("near", F.coalesce("far", "near"))
        new = scratch.save(near.join(jump, "near", "left").select("id", far.alias("comp"), (far != F.col("comp")).alias("changed")), "labels")
        scratch.drop(labels)
        scratch.drop(near)
        if not new.where("changed").limit(1).count():
            scratch.drop(both)
            out = new.select("id", "comp")
            out.scratch_path = new.scratch_path
            return out
        labels = new
