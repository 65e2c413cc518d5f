"""Spark sessions with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Pinned: timestamps read alike everywhere, plans adapt to measured sizes, and ANSI errors surface.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "tidecast", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None, **conf: str) -> SparkSession:
    """A session; without a master, the one that spark-submit or the environment names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        settings["spark.driver.memory"] = driver_memory
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
