"""Column roles, types, constants and availability: one-pass profiles over many columns, and checks that give violations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-6


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, text, number): columns of any type stacked, so that one aggregation profiles all of them."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), (F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None).cast("double")).alias("number")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, nulls, levels, low, high, mean, std) in one pass and one shuffle; NaN counts as null."""
    rows = long_form(df, columns or df.columns)
    number = F.nanvl("number", F.lit(None).cast("double"))
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | F.isnan("number")).alias("nulls"), F.count_distinct("text").alias("levels"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("std"))


def extremes(df: DataFrame, columns: Sequence[str]) -> list[Row]:
    """Rows (column, first, last, low, high, mean, std) on the driver, one a column: first and last are the least and greatest value
    as text. One aggregation without keys: a task hands on one row, whatever the columns hold."""
    cells = []
    for k, c in enumerate(columns):
        text, numeric = F.col(c).cast("string"), isinstance(df.schema[c].dataType, T.NumericType)
        number = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if numeric else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), F.min(text).alias("first"), F.max(text).alias("last"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("std")).alias(f"c{k}"))
    return list(df.agg(*cells).first()) if cells else []


def _tight(df: DataFrame, columns: Sequence[str] | None, tolerance: float) -> list[tuple[Row, int]]:
    """Columns that may be constant, with their number of levels. Cells are told apart only in columns whose numbers lie within the
    tolerance; a column whose least text is its greatest has one level."""
    found = [e for e in extremes(df, columns or df.columns) if e.first == e.last or (e.low is not None and e.high - e.low < tolerance)]
    several = [e.column for e in found if e.first != e.last]
    counts = {r.column: r.k for r in long_form(df, several).groupBy("column").agg(F.count_distinct("text").alias("k")).collect()} if several else {}
    return [(e, counts.get(e.column, int(e.first is not None))) for e in found]


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(column, levels, span): at most one level, or numbers within the tolerance."""
    rows = [(e.column, k, None if e.low is None else e.high - e.low) for e, k in _tight(df, columns, tolerance)]
    return df.sparkSession.createDataFrame(rows, "column string, levels long, span double")


def degenerate_columns(df: DataFrame, columns: Sequence[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Numbers that take several levels within the tolerance: constants up to noise."""
    rows = [(e.column, k, e.high - e.low, e.mean, e.std) for e, k in _tight(df, columns, tolerance) if k > 1 and e.low is not None and e.high - e.low < tolerance]
    return df.sparkSession.createDataFrame(rows, "column string, levels long, span double, mean double, std double")


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of exactly two levels that are whole numbers: none of the cells is anything but the least or the greatest."""
    whole = lambda text: re.fullmatch(r"\s*[+-]?\d+\s*", text) is not None
    pairs = [(e.column, e.first, e.last) for e in extremes(df, columns) if e.first != e.last and whole(e.first) and whole(e.last)]
    others = df.agg(*[F.count_if(~F.col(c).cast("string").isin(a, b)).alias(f"c{k}") for k, (c, a, b) in enumerate(pairs)]).first() if pairs else []
    return df.sparkSession.createDataFrame([(c,) for (c, _, _), n in zip(pairs, others, strict=True) if n == 0], "column string")


def log_unsafe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers at or below -1, of which log1p is undefined."""
    return profile(df, columns).where(F.col("low") <= -1).select("column", "low")


def roles(columns: Sequence[str], key: str, target: str, dropped: Sequence[str], constants: Sequence[str]) -> dict[str, str]:
    """Role of every column; every column gets exactly one."""
    out = {}
    for c in columns:
        out[c] = "key" if c == key else "target_source" if c == target else "dropped_price" if c in dropped else "dropped_constant" if c in constants else "feature"
    missing = {key, target, *dropped, *constants} - set(columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    return out


def types(schema: T.StructType, levels: Mapping[str, Sequence[str]], angular: str) -> dict[str, str]:
    """Type of every column by the first rule that holds: boolean, declared levels, angular name pattern, number."""
    out = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            out[f.name] = "boolean"
        elif f.name in levels:
            out[f.name] = "categorical"
        elif re.search(angular, f.name):
            out[f.name] = "angular"
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = "linear_numeric"
        else:
            raise ValueError(f"no type rule fits {f.name}")
    return out


def partition(df: DataFrame, by_role: Mapping[str, str]) -> dict[str, DataFrame]:
    """df's columns by role; names that differ from the spec's raise before anything runs."""
    missing, unexpected = set(by_role) - set(df.columns), set(df.columns) - set(by_role)
    if missing or unexpected:
        raise ValueError(f"missing columns {sorted(missing)}, unexpected columns {sorted(unexpected)}")
    return {role: df.select(*[c for c in df.columns if by_role[c] == role]) for role in sorted(set(by_role.values()))}


def coverage(df: DataFrame, by_role: Mapping[str, str], by_type: Mapping[str, str]) -> DataFrame:
    """(column, role, type, n, nulls) of every column, counted in one pass that hands on a row a task; NaN counts as null. Roles or
    types that don't cover df's columns raise."""
    for spec in (by_role, by_type):
        partition(df, spec)
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    empty = lambda c: F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(empty(c)).alias(f"c{k}") for k, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(by_role[c]).alias("role"), F.lit(by_type[c]).alias("type"), F.col("n"), F.col(f"c{k}").alias("nulls")) for k, c in enumerate(df.columns)]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def pairs(columns: Sequence[str], names: Sequence[str], suffix: str = "dist") -> list[tuple[str, str, str]]:
    """(column, a, b) of columns named a_b_suffix with a and b among the names."""
    one = "|".join(map(re.escape, sorted(names)))
    found = [(c, re.fullmatch(f"({one})_({one})_{re.escape(suffix)}", c)) for c in columns]
    return [(c, m[1], m[2]) for c, m in found if m]


def availability(df: DataFrame, columns: Sequence[str], date: str, cutoff: str, excused: Sequence[str] = ()) -> DataFrame:
    """(column, nulls): features with nulls from the cutoff on, which therefore aren't known ahead."""
    after = df.where(F.col(date) >= F.to_timestamp_ntz(F.lit(cutoff)) if dict(df.dtypes)[date] == "timestamp_ntz" else F.col(date) >= F.to_date(F.lit(cutoff)))
    return long_form(after, [c for c in columns if c not in excused]).groupBy("column").agg(F.count_if(F.col("text").isNull()).alias("nulls")).where("nulls > 0")


def apply(df: DataFrame, exprs: Mapping[str, object], drop: Sequence[str] = ()) -> DataFrame:
    """df without `drop` and with the derived columns, in one projection; a name that exists is replaced. Consumed columns that
    df doesn't have raise."""
    missing = sorted(set(drop) - set(df.columns))
    if missing:
        raise ValueError(f"no such source columns: {', '.join(missing)}")
    kept = [F.col(c) for c in df.columns if c not in drop and c not in exprs]
    return df.select(*kept, *[e.alias(n) for n, e in exprs.items()])


def uncovered(columns: Sequence[str], families: Mapping[str, Sequence[str]]) -> list[str]:
    """What keeps the families from covering the columns once each: missing, unknown and repeated names."""
    held = [c for cs in families.values() for c in cs]
    out = [f"missing {c}" for c in columns if c not in held] + [f"unknown {c}" for c in dict.fromkeys(held) if c not in columns]
    return out + [f"repeated {c}" for c in dict.fromkeys(held) if held.count(c) > 1]


def formula_violations(df: DataFrame, column: str, expected: Column, tolerance: float = 0.0) -> DataFrame:
    """Rows whose column isn't what the formula says; both null agree."""
    near = F.abs(F.col(column) - expected) <= tolerance
    return df.where(~F.coalesce(near, F.col(column).isNull() & expected.isNull()))


def require(checks: Mapping[str, DataFrame | Sequence[str]]) -> None:
    """A bundle of checks, each a frame or list of violations: raises with the names of those that have any."""
    failed = [n for n, v in checks.items() if (bool(v.limit(1).count()) if isinstance(v, DataFrame) else len(v) > 0)]
    if failed:
        raise ValueError(f"checks failed: {', '.join(failed)}")


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows along the order, which should break ties: each task hands on n rows only."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n rows along the order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def complete_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in the subset."""
    return df.dropna(subset=list(subset))


def sorted_sets(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by, values): each group's distinct values in order, for columns of few levels."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(column)).alias("values"))


def matrix_to_long(df: DataFrame, keys: Sequence[str], prefix: str, horizon: int) -> DataFrame:
    """(keys, step, value) of <prefix>_1 .. <prefix>_horizon."""
    return df.select(*keys, F.posexplode(F.array(*[F.col(f"{prefix}_{k}") for k in range(1, horizon + 1)])).alias("step", "value")).withColumn("step", F.col("step") + 1)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one but not both, with side."""
    left, right = a.distinct(), b.distinct()
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
