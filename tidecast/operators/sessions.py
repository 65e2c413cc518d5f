"""Session calendars: business days, the session index, restriction, gaps and runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every calendar day from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d"))


def business_days(spark: SparkSession, start: str, end: str, holidays: Sequence[str] = ()) -> DataFrame:
    """Monday to Friday without the holidays (a fixed list, hence literals)."""
    out = days(spark, start, end).where(F.weekday("d") < 5)
    return out.where(~F.col("d").isin([dt.date.fromisoformat(h) for h in holidays])) if holidays else out


def observed(daily: DataFrame, value: str = "c") -> DataFrame:
    """Sessions that took place: rows with a value."""
    return daily.where(F.col(value).isNotNull())


def positions(df: DataFrame, order: str = "d", partition_by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """0-based dense position along the order; without partition_by one task orders all, so only for session-sized frames."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*partition_by).orderBy(order)) - 1).cast("long"))


def session_index(history: DataFrame, forward: DataFrame, date: str = "d") -> DataFrame:
    """(pos, d, is_history): observed sessions, then the rule's."""
    both = history.select(date, F.lit(True).alias("is_history")).unionByName(forward.select(date, F.lit(False).alias("is_history")))
    return positions(both, date).select("pos", F.col(date).alias("d"), "is_history")


def restrict(df: DataFrame, sessions: DataFrame, key: str = "d") -> DataFrame:
    """df's rows on sessions, nothing filled."""
    return df.join(sessions.select(key), key, "left_semi")


def missing_sessions(df: DataFrame, sessions: DataFrame, key: str = "d") -> DataFrame:
    """Sessions that df lacks; restrict() is complete only if this is empty."""
    return sessions.select(key).join(df.select(key), key, "left_anti")


def checked_restrict(df: DataFrame, sessions: DataFrame, key: str = "d") -> DataFrame:
    first = missing_sessions(df, sessions, key).agg(F.min(key)).first()[0]
    if first is not None:
        raise ValueError(f"sessions without a row, the first on {first}")
    return restrict(df, sessions, key)


def position_of(sessions: DataFrame, date: str) -> int:
    row = sessions.where(F.col("d") == F.to_date(F.lit(date))).select("pos").first()
    if row is None:
        raise KeyError(f"{date} is no session")
    return row["pos"]


def lookup(df: DataFrame, sessions: DataFrame, key: str = "d") -> DataFrame:
    """df with pos and is_session of each row's day: null and false where the day is no session, or null. Sessions hold a row a day,
    so Spark broadcasts them by their size."""
    seen = sessions.select(F.col("d").alias("_day"), F.col("pos").alias("_pos"))
    kept = df.drop("pos", "is_session")
    return kept.join(seen, F.col(key) == F.col("_day"), "left").select(*kept.columns, F.col("_pos").alias("pos"), F.col("_pos").isNotNull().alias("is_session"))


def asof_forward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, value: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """left with the value of the first right row at or after it, null where there is none.

    One sort of both sides together in place of a range join, so a large left side costs a window, not a product. A task per
    partition_by group: without one, both sides are sorted in one task, which suits session-sized frames.
    """
    tagged = left.select(*[F.col(c) for c in left.columns], F.col(left_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    fill = [F.col(c) if c in partition_by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    other = right.select(*fill, F.col(right_on).alias("_at"), F.lit(1).alias("_side"), F.col(value).alias("_value"))
    ahead = Window.partitionBy(*partition_by).orderBy("_at", "_side").rowsBetween(0, Window.unboundedFollowing)
    out = tagged.unionByName(other).withColumn(value, F.first("_value", ignorenulls=True).over(ahead))
    return out.where("_side = 0").drop("_at", "_side", "_value")


def discontinuities(gaps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Positions of the first sessions on or after a gap date, each once, without position 0 and gaps beyond the end."""
    return asof_forward(gaps.select("d"), sessions, "d", "d", "pos").where("pos > 0").select("pos").distinct()


def rule_error(daily: DataFrame, value: str = "c", skip_years: Sequence[int] = ()) -> DataFrame:
    """How far "every weekday is a session" is off, up to the last observed day, with and without the skipped years."""
    last = daily.where(F.col(value).isNotNull()).agg(F.max("d")).first()[0]
    seen = daily.where(F.col("d") <= F.lit(last))
    weekday, open_ = F.weekday("d") < 5, F.col(value).isNotNull()
    keep = ~F.year("d").isin(*skip_years) if skip_years else F.lit(True)

    def rate(cond: Column) -> list[Column]:
        return [F.count_if(weekday & ~open_ & cond), F.count_if(weekday & cond)]

    (c_all, n_all), (c_keep, n_keep) = rate(F.lit(True)), rate(keep)
    return seen.agg(c_all.alias("closed_all"), n_all.alias("weekdays_all"), F.round(F.try_divide(c_all, n_all), 5).alias("rate_all"), c_keep.alias("closed_kept"), n_keep.alias("weekdays_kept"), F.round(F.try_divide(c_keep, n_keep), 5).alias("rate_kept"), F.count_if(~weekday & open_).alias("weekend_sessions"))


def closures_per_year(daily: DataFrame, value: str = "c") -> DataFrame:
    last = daily.where(F.col(value).isNotNull()).agg(F.max("d")).first()[0]
    closed = daily.where((F.col("d") <= F.lit(last)) & (F.weekday("d") < 5) & F.col(value).isNull())
    return closed.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("closures"))


def closed_runs(daily: DataFrame, min_run: int = 4, value: str = "c") -> DataFrame:
    """(d, run_start, run_days) of closed weekdays in runs of min_run or more consecutive weekdays, a run at the end included."""
    days_ = daily.where(F.weekday("d") < 5).select("d", F.col(value).isNotNull().alias("open"))
    island = F.row_number().over(Window.orderBy("d")) - F.row_number().over(Window.partitionBy("open").orderBy("d"))
    runs = days_.withColumn("island", island).where("NOT open")
    by = Window.partitionBy("island")
    return runs.select("d", F.min("d").over(by).alias("run_start"), F.count("*").over(by).alias("run_days")).where(F.col("run_days") >= min_run)


def mismatch_years(dates: DataFrame, least: int = 3) -> DataFrame:
    """Dates of years that have at least `least` of them."""
    years = dates.groupBy(F.year("d").alias("y")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return dates.withColumn("y", F.year("d")).join(years, "y", "left_semi").select("d")


def gap_dates(daily: DataFrame, mismatches: DataFrame, least: int = 3, min_run: int = 4, value: str = "c") -> DataFrame:
    """(d, rule): mismatches of bad years and members of long closed runs, and the mismatches left over as residue."""
    bad = mismatch_years(mismatches, least)
    flagged = bad.union(closed_runs(daily, min_run, value).select("d")).distinct().select("d", F.lit("gap").alias("rule"))
    return flagged.unionByName(mismatches.select("d").distinct().join(bad, "d", "left_anti").select("d", F.lit("residue").alias("rule")))


def holiday_differences(derived: DataFrame, frozen: DataFrame) -> DataFrame:
    """(d, side): dates that only one of two holiday lists has."""
    return derived.select("d").exceptAll(frozen.select("d")).select("d", F.lit("derived").alias("side")).unionByName(frozen.select("d").exceptAll(derived.select("d")).select("d", F.lit("frozen").alias("side")))
