"""Declared-level encodings, structural fills and fit-scoped scaling."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import quantiles

VIEWS = ("tree", "network")


def fill(df: DataFrame, sentinels: Mapping[str, str]) -> DataFrame:
    """Structural nulls become a declared level."""
    return df.fillna(dict(sentinels))


def null_rule_violations(df: DataFrame, column: str, driver: str, value: object) -> DataFrame:
    """Rows where "column is null exactly if driver = value" fails."""
    return df.where(F.col(column).isNull() != F.coalesce(F.col(driver) == F.lit(value), F.lit(False)))


def _array(levels: Sequence[str]) -> Column:
    return F.array(*map(F.lit, levels))


def level_code(x: Column, levels: Sequence[str]) -> Column:
    """0-based place among the declared levels, -1 for an undeclared one, null for null."""
    return (F.array_position(_array(levels), x) - 1).cast("int")


def reserved_code(x: Column, levels: Sequence[str]) -> Column:
    """1-based place among the levels in code point order; 0 is kept for unknown and null."""
    return F.coalesce(F.array_position(_array(sorted(levels)), x), F.lit(0)).cast("int")


def ordinal_code(x: Column, levels: Sequence[str], null_level: str = "None") -> Column:
    """level_code with null as a level of its own; unknown is -1."""
    return level_code(F.coalesce(x, F.lit(null_level)), levels)


def undeclared(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Observed values outside the declared levels."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*levels)).select(column).distinct()


def never_observed(df: DataFrame, declared: Mapping[str, Sequence[str]]) -> DataFrame:
    """(column, level) declared but absent, with one pass over the data."""
    seen = df.agg(*[F.collect_set(F.when(F.col(c).isin(*levels), F.col(c))).alias(c) for c, levels in declared.items()])  # bounded by the declared levels
    absent = lambda c, levels: F.transform(F.array_except(_array(levels), F.col(c)), lambda x: F.struct(F.lit(c).alias("column"), x.alias("level")))
    return seen.select(F.explode(F.concat(*[absent(c, levels) for c, levels in declared.items()])).alias("m")).select("m.*")


def view(df: DataFrame, kind: str, levels: Mapping[str, Sequence[str]], booleans: Sequence[str], numbers: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One of the two dtype views: tree (codes, int8 flags) or network (strings, float flags); numbers are float32 in both."""
    if kind not in VIEWS:
        raise ValueError(f"unknown view {kind!r}")
    cats = [level_code(F.col(c), v).alias(c) if kind == "tree" else F.col(c).cast("string").alias(c) for c, v in levels.items()]
    flags = [F.col(b).cast("boolean").cast("tinyint" if kind == "tree" else "float").alias(b) for b in booleans]
    return df.select(*keep, *cats, *flags, *[F.col(n).cast("float").alias(n) for n in numbers])


def out_of_unit(df: DataFrame, columns: Sequence[str], slack: float = 1e-9) -> DataFrame:
    """How many values of each cyclic column are null, not finite or outside [-1, 1]."""
    bad = lambda c: F.count_if(F.coalesce(F.isnan(c) | (F.abs(F.col(c)) > 1 + slack), F.lit(True)))
    return df.agg(*[bad(c).alias(c) for c in columns])


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of one fold's training rows. It doesn't pickle: a fold's state must not outlive it."""

    stats: Mapping[str, tuple[float, float]]

    def __reduce__(self):
        raise TypeError("fold state is refitted, not stored")

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled columns as float32, others as they are; a deviation of 0 divides by 1."""
        return df.select(*[((F.col(c) - F.lit(self.stats[c][0])) / F.lit(self.stats[c][1] or 1.0)).cast("float").alias(c) if c in self.stats else F.col(c) for c in df.columns])


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """Statistics of the rows given, and only of those; no rows raise."""
    row = train.agg(F.count("*").alias("n"), *[e for k, c in enumerate(columns) for e in (F.avg(c).alias(f"m{k}"), F.stddev_pop(c).alias(f"s{k}"))]).first()
    if not row["n"]:
        raise ValueError("no training rows to fit on")
    return Scaler({c: (row[f"m{k}"], row[f"s{k}"]) for k, c in enumerate(columns)})


def takes_no_data(builder: Callable) -> bool:
    """Whether a global builder has no parameter that could hand it data: its encoding is then the same on every split."""
    return not inspect.signature(builder).parameters


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the exact median of the column; a column without values keeps its nulls."""
    median = {c: quantiles(df, c, [0.5])[0] for c in columns}
    return df.fillna({c: m for c, m in median.items() if m is not None})


def log_scaled(x: Column) -> Column:
    """log1p; null at or below -1."""
    return F.log1p(F.when(x > -1, x))
