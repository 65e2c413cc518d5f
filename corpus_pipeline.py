"""The corpus pipeline: quality, near-duplicates, personal data, mixing, tokens. STAGES in order, run() over a folder of tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import bpe, jaccard, mixing, pii, quality
from tidecast.llm.common import Scratch, table, with_ids
from tidecast.llm.queries import ratings

#: Bytes of texts that Spark hands to a Python worker at a time, in this session from the first stage on.
BATCH_BYTES = "8m"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def grade_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose probability of the top grade (of quality, not toxic) is under the model's cut go.

    Null and empty texts are graded by the thresholds alone, rows that repeat count each, an empty table stays empty, and
    columns other than those of documents go.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    model = quality.train(docs, ratings(table(spark, sf_dir, "labels")), levels=3)
    return quality.grade(docs.select(COLUMNS), model, least=2, keep_columns=True).where("kept").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of linked documents the one of smallest doc_id stays.

    Null, empty and wordless texts link with nothing and stay; so do null keys. Of rows that repeat a doc_id with the same
    text one stays, with other texts each that isn't linked to a smaller doc_id. An empty table stays empty.
    """
    scratch, joined = Scratch(spark, "pipeline"), Scratch(spark, "jaccard")
    groups = jaccard.near_duplicates(docs, scratch=joined)
    gone = scratch.save(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    joined.drop(joined.root)
    out = with_ids(docs, gone, "doc_id", "left_anti").select(COLUMNS)
    again = scratch.save(docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id"), "again")
    if again.limit(1).count():  # rows repeated with their doc_id: one of each text stays
        out = with_ids(out, again, "doc_id", "left_anti").unionByName(with_ids(out, again, "doc_id").dropDuplicates(["doc_id", "text"]))
    return out


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every found span becomes its kind in brackets, and n_chars follows the text.

    Null texts stay null with their n_chars; empty texts, repeated rows and empty tables pass as they are.
    """
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document as often as the mix repeats it; rows of a repeated document are equal.

    Null and empty texts have size 0 and are taken as often as others of their source; a null source is a source of its own;
    repeated rows count each; an empty table stays empty.
    """
    return mixing.mixed(docs.select(COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token numbers and digests of ids and decoded bytes. Null texts are empty; rows that repeat give a row each."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", grade_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: SQL can't express the stages' models, exact merges and hash order; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "run")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
