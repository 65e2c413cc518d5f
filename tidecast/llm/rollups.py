"""Operator 6: token totals by source, language and tokenizer version, maintained from signed deltas with idempotent commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
#: Counters by tokenizer version: fixed patterns whose matches are the tokens.
COUNTERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+"}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a whole text by a version's counter; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[version])), F.lit(0)).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """(source, lang, version, docs, tokens) signed sums of changes (op, source, lang, version, n_tokens, old_tokens).

    insert adds a document and its tokens, delete takes both back, revise adds n_tokens - old_tokens. Null counts are 0,
    null keys a group of their own; another op raises. Sums are partially aggregated, so a hot source's rows never meet.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(unknown.cast("int"))
    tokens = F.when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(n)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """Totals under a folder that all executors share: a Parquet folder of deltas per committed batch.

    A batch is committed when Spark's _SUCCESS stands in its folder, which the writer leaves last; a batch that broke off
    has none and is written over by its next try, and a committed batch is never applied again. compact() writes the
    totals of all committed batches, and their names, as a new snapshot, after which readers start from that.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _children(self, name: str) -> list[str]:
        """Names of the complete folders below the named one."""
        top = f"{self.folder}/{name}"
        if not self._exists(top):
            return []
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
        return sorted(n for n in (s.getPath().getName() for s in found) if self._exists(f"{top}/{n}/_SUCCESS"))

    def _snapshot(self) -> tuple[DataFrame | None, set[str]]:
        done = self._children("snapshots")
        if not done:
            return None, set()
        names = self.spark.read.parquet(f"{self.folder}/members/{done[-1]}")
        return self.spark.read.parquet(f"{self.folder}/snapshots/{done[-1]}"), {r["batch"] for r in names.collect()}

    def committed(self) -> set[str]:
        """Names of the committed batches (one per batch, never per document)."""
        return set(self._children("batches")) | self._snapshot()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of changes once; False if its name is committed already, whatever the changes hold."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch names are letters, digits, - and _: {batch!r}")
        if self._exists(f"{self.folder}/batches/{batch}/_SUCCESS"):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        return True

    def _read(self) -> tuple[DataFrame, list[str]]:
        """Totals, and the names of the batches in them: one listing serves both."""
        base, covered = self._snapshot()
        fresh = [b for b in self._children("batches") if b not in covered]
        kind = "source string, lang string, version string, docs long, tokens long"
        parts = [self.spark.read.schema(kind).parquet(*[f"{self.folder}/batches/{b}" for b in fresh])] if fresh else []
        parts += [base] if base is not None else []
        out = parts[0] if parts else self.spark.createDataFrame([], kind)
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        return out, sorted(covered | set(fresh))

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches; groups that came back to nothing are left out."""
        return self._read()[0]

    def compact(self) -> None:
        """A new snapshot: the totals of exactly the batches that it lists as members, so a batch committed meanwhile is read beside
        it and counts once. Members are written first; a snapshot counts from its _SUCCESS on. One compaction at a time."""
        totals, names = self._read()
        version = f"{len(self._children('snapshots')):08d}"
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.mode("overwrite").parquet(f"{self.folder}/members/{version}")
        totals.write.mode("overwrite").parquet(f"{self.folder}/snapshots/{version}")
