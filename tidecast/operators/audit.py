"""Audits of derived columns: dependencies, fits, errors, moments and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.circular import close
from .windows import central_difference, unwrap


def dependency_violations(df: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """Groups of `by` that take more than one target value: empty if the target depends on them."""
    return df.groupBy(*by).agg(F.count_distinct(target).alias("targets")).where("targets > 1")


def dependency_report(df: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """(by, targets, n, holds) of every group: how many target values it takes over its n rows; nulls are no value."""
    return df.groupBy(*by).agg(F.count_distinct(target).alias("targets"), F.count("*").alias("n"), (F.count_distinct(target) <= 1).alias("holds"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of the pairs that occur."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str, levels: Sequence[object]) -> DataFrame:
    """A row for each a, a column for each declared level of b."""
    return df.groupBy(a).pivot(b, list(levels)).agg(F.count(F.lit(1))).fillna(0)


def line(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x with correlation and largest residual: one pass for the fit, one for the residuals."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.count("*").alias("n"))
    if by:
        return df.join(fit, list(by)).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("slope", "intercept", "r", "n")], F.max(F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))).alias("max_residual"))
    row = fit.first()  # four numbers
    return df.agg(*[F.lit(row[c]).alias(c) for c in ("slope", "intercept", "r", "n")], F.max(F.abs(F.col(y) - F.lit(row["slope"]) * F.col(x) - F.lit(row["intercept"]))).alias("max_residual"))


def max_error(df: DataFrame, recomputed: Column, stored: Column, name: str = "max_error") -> DataFrame:
    return df.agg(F.max(F.abs(recomputed - stored)).alias(name))


def mismatches(df: DataFrame, recomputed: Column, stored: Column) -> DataFrame:
    return df.agg(F.count_if(~recomputed.eqNullSafe(stored)).alias("mismatches"), F.count("*").alias("n"))


def at_maximum(df: DataFrame, value: str, by: str, tie: str, group: Sequence[str] = ()) -> DataFrame:
    """value where `by` is largest; of equals the first along `tie`."""
    return df.groupBy(*group).agg(F.max_by(value, F.struct(F.col(by), (-F.col(tie)))).alias(f"{value}_at_max"))


def span(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg((F.max(value) - F.min(value)).alias("span"))


def moments(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, extremes, and skewness and kurtosis with the small-sample corrections of pandas."""
    n = F.count(value).cast("double")
    g1, g2 = F.skewness(value), F.kurtosis(value)
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1)
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), skew.alias("skew"), kurt.alias("kurt"))


def tail_share(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Shares of cells and of rows whose magnitude passes the threshold."""
    beyond = [(F.abs(F.col(c)) > threshold).cast("double") for c in columns]
    total, any_ = beyond[0], beyond[0]
    for b in beyond[1:]:
        total, any_ = total + b, F.greatest(any_, b)
    return df.agg((F.sum(total) / (F.count("*") * len(columns))).alias("cell_share"), F.avg(any_).alias("row_share"), F.count("*").alias("n"))


def rate_consistency(df: DataFrame, angle: str, reported: str, order: str, least: float = 0.999, period: float = 360.0, partition_by: Sequence[str] = ()) -> DataFrame:
    """(n, r, slope, consistent): the reported rate against the central difference of the unwrapped angle."""
    path = unwrap(df, angle, order, period, partition_by)
    rates = central_difference(path, f"{angle}_unwrapped", order, partition_by)
    out = rates.groupBy(*partition_by).agg(F.count("*").alias("n"), F.corr("rate", reported).alias("r"), F.regr_slope("rate", reported).alias("slope"))
    return out.withColumn("consistent", F.coalesce(F.col("r") >= least, F.lit(False)))


def prune_survival(df: DataFrame, column: str, bodies: Mapping[str, tuple[str, str]], threshold: float = 0.95) -> DataFrame:
    """(body, strength, survives): whether a column stays beside each body's sine and cosine, in one aggregation."""
    row = df.agg(*[F.greatest(F.abs(F.corr(column, s)), F.abs(F.corr(column, c))).alias(b) for b, (s, c) in bodies.items()])
    cells = F.array(*[F.struct(F.lit(b).alias("body"), F.col(b).alias("strength")) for b in bodies])
    return row.select(F.explode(cells).alias("c")).select("c.*").withColumn("survives", F.coalesce(F.col("strength") < threshold, F.lit(True)))


def duplicates(df: DataFrame, pairs: Sequence[tuple[str, str]], rtol: float = 0.0, atol: float = 1e-6) -> DataFrame:
    """(a, b, max_difference, duplicate) of column pairs: duplicates agree within the tolerance in every row."""
    row = df.agg(*[e for k, (a, b) in enumerate(pairs) for e in (F.max(F.abs(F.col(a) - F.col(b))).alias(f"m{k}"), F.every(close(F.col(a), F.col(b), rtol, atol)).alias(f"d{k}"))])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"m{k}").alias("max_difference"), F.col(f"d{k}").alias("duplicate")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def verdicts(df: DataFrame) -> DataFrame:
    """(verdict, n) of a long (family, item, verdict) table, with the total under verdict null."""
    return df.rollup("verdict").agg(F.count("*").alias("n"))
