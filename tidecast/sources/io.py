"""Sources and sinks: typed scans, adapters to day resolution, guarded JSON specs, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV under a declared schema; a column that isn't selected later isn't parsed. File order means nothing."""
    return spark.read.schema(schema).csv(path, header=True, dateFormat=date_format, enforceSchema=False)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, as Spark's aggregates would carry it on."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def day(df: DataFrame, column: str, name: str = "d") -> DataFrame:
    """The column at day resolution as a date."""
    return df.withColumn(name, F.to_date(column))


def validate_schema(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing, unexpected = sorted(set(names) - set(df.columns)), sorted(set(df.columns) - set(names))
    if missing or unexpected:
        raise ValueError(f"missing columns {missing}, unexpected columns {unexpected}")
    return df


def write_spec(spec: object, path: str) -> str:
    """A derived contract (metadata, never rows) as JSON; returns its checksum."""
    text = json.dumps(spec, indent=1, sort_keys=True, default=str)
    Path(path).write_text(text)
    return hashlib.sha256(text.encode()).hexdigest()


def read_spec(path: str, checksum: str | None = None) -> object:
    """A spec, refused if its checksum differs from the one recorded for it."""
    raw = Path(path).read_bytes()
    if checksum and hashlib.sha256(raw).hexdigest() != checksum:
        raise ValueError(f"{path} isn't the file that the spec was derived from")
    return json.loads(raw)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a path, computed where the files are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_model(model: Model, path: str) -> None:
    """A fitted model (components, boosted steps), as Spark's own files, so that any session can load it."""
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str) -> Model:
    return PipelineModel.load(path).stages[0]


def markdown(rows: Sequence[Sequence[object]], header: Sequence[str]) -> str:
    """A small report table."""
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])
