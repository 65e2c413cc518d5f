"""Forecast metrics and a trading scorecard over step returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import correlation_table


def always_up(df: DataFrame) -> DataFrame:
    """The baseline: a constant long position."""
    return df.withColumn("position", F.lit(1.0))


def flatten_at_boundaries(df: DataFrame, fold: str = "fold", order: str = "pos") -> DataFrame:
    """The position is 0 on the first row of every fold, where the model changes."""
    first = F.row_number().over(Window.partitionBy(fold).orderBy(order)) == 1
    return df.withColumn("position", F.when(first, 0.0).otherwise(F.col("position")))


def scorecard(df: DataFrame, value: str = "r", order: str = "pos", cost: float = 0.0, per_year: int = 252, group: Sequence[str] = ()) -> DataFrame:
    """Cumulative return, Sharpe ratio and largest drawdown of position times log return, less cost per unit of turnover."""
    w = Window.partitionBy(*group).orderBy(order)
    turnover = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    net = df.withColumn("net", F.col("position") * F.col(value) - F.lit(cost) * turnover)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    path = net.withColumn("log_equity", F.sum("net").over(upto))
    path = path.withColumn("peak", F.greatest(F.lit(0.0), F.max("log_equity").over(upto)))
    return path.groupBy(*group).agg(F.count("*").alias("n"), (F.exp(F.sum("net")) - 1).alias("total_return"), F.try_divide(F.avg("net") * F.sqrt(F.lit(float(per_year))), F.stddev_samp("net")).alias("sharpe"), F.min(F.exp(F.col("log_equity") - F.col("peak")) - 1).alias("max_drawdown"))


def per_fold(df: DataFrame, value: str, fold: str = "fold") -> DataFrame:
    return df.groupBy(fold).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def errors(df: DataFrame, truth: Sequence[str], forecast: Sequence[str]) -> DataFrame:
    """(step, rmse, nrmse, direction, share): per horizon, with its share of all squared error."""
    cells = F.array(*[F.struct(F.lit(k + 1).alias("step"), F.col(t).alias("y"), F.col(f).alias("f")) for k, (t, f) in enumerate(zip(truth, forecast, strict=True))])
    by = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("step").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("f"), 2))).alias("rmse"), F.stddev_pop("y").alias("sd"), F.avg((F.signum("y") == F.signum("f")).cast("double")).alias("direction"), F.sum(F.pow(F.col("y") - F.col("f"), 2)).alias("se"))
    return by.select("step", "rmse", F.try_divide("rmse", "sd").alias("nrmse"), "direction", F.try_divide("se", F.sum("se").over(Window.partitionBy())).alias("share"))


def horizon_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(step_a, step_b, r): correlation of each pair of horizon columns, step_a before step_b; null where a column is constant."""
    columns = list(columns)
    step = lambda c: F.array_position(F.array(*map(F.lit, columns)), F.col(c)).cast("int")
    return correlation_table(df, columns).select(step("a").alias("step_a"), step("b").alias("step_b"), F.nanvl("r", F.lit(None).cast("double")).alias("r"))


def boosted_steps(train: DataFrame, features: Sequence[str], targets: Sequence[str], rounds: int = 10, depth: int = 3, seed: int = 1) -> list[PipelineModel]:
    """A stand-in for multi-output boosting: one gradient-boosted regressor per horizon step, on Spark's own trees."""
    data = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(train)
    return [GBTRegressor(featuresCol="_features", labelCol=t, predictionCol=f"f_{t}", maxIter=rounds, maxDepth=depth, seed=seed).fit(data.where(F.col(t).isNotNull())) for t in targets]


def forecast(df: DataFrame, models: list, features: Sequence[str]) -> DataFrame:
    out = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(df)
    for m in models:
        out = m.transform(out)
    return out.drop("_features")
