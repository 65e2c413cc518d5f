"""Purged rolling walk-forward folds: geometry on a few scalars, membership as a lazy range join with the bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INNER_SHARE = 0.15


@dataclass(frozen=True)
class Fold:
    """Inclusive index bounds among the origins."""

    fold: int
    train: tuple[int, int]
    inner_train: tuple[int, int]
    inner_val: tuple[int, int]
    val: tuple[int, int]


def inner_split(first: int, last: int, purge: int, share: float = INNER_SHARE) -> tuple[tuple[int, int], tuple[int, int]]:
    """Inner train and validation of a training block: the last share (rounded half to even), purged from what precedes."""
    size = round((last - first + 1) * share)
    start = last - size + 1
    inner = (first, start - purge)
    if size < 1 or inner[1] < inner[0]:
        raise ValueError("the inner split leaves an empty block")
    return inner, (start, last)


def geometry(n_cv: int, per_year: int, purge: int, n_folds: int = 5, train_years: int = 10) -> list[Fold]:
    """Rolling folds over n_cv origins. Training blocks have equal length and end exactly `purge` origins before their
    validation block; the last fold takes the remainder."""
    length = train_years * per_year
    pool = n_cv - length - purge
    size = pool // n_folds
    if size < 1:
        raise ValueError(f"{n_cv} origins leave no validation block after {length} training origins and {purge} purged")
    out, start = [], n_cv - pool
    for k in range(n_folds):
        end = n_cv - 1 if k == n_folds - 1 else start + size - 1
        train = (start - purge - length + 1, start - purge)
        inner, val = inner_split(*train, purge)
        out.append(Fold(k + 1, train, inner, val, (start, end)))
        start = end + 1
    return out


def holdout(n_origins: int, first: int, per_year: int, purge: int, train_years: int = 10) -> Fold:
    """The final refit block and the holdout, under the folds' own lengths."""
    train = (first - purge - train_years * per_year + 1, first - purge)
    if train[0] < 0:
        raise ValueError("not enough origins before the holdout")
    inner, val = inner_split(*train, purge)
    return Fold(0, train, inner, val, (first, n_origins - 1))


def sessions_per_year(dates: DataFrame, date: str = "d") -> DataFrame:
    """(per_year): median of the yearly counts without the first and last year, cut to a whole number."""
    years = dates.groupBy(F.year(date).alias("y")).agg(F.count("*").alias("n"))
    ends = years.agg(F.min("y").alias("a"), F.max("y").alias("b")).first()
    return years.where((F.col("y") > F.lit(ends["a"])) & (F.col("y") < F.lit(ends["b"]))).agg(F.percentile("n", F.lit(0.5)).cast("long").alias("per_year"))


def bounds_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    """(fold, role, lo, hi): a few rows a fold."""
    rows = [(f.fold, role, *getattr(f, role)) for f in folds for role in ("train", "inner_train", "inner_val", "val")]
    return spark.createDataFrame(rows, "fold int, role string, lo long, hi long")


def membership(origins: DataFrame, bounds: DataFrame, index: str = "i") -> DataFrame:
    """(fold, role, origin columns): origins within the inclusive bounds; a range join whose bounds, as bounds_table makes them, are four
    rows a fold; Spark broadcasts them by their size."""
    return origins.join(bounds, (F.col(index) >= F.col("lo")) & (F.col(index) <= F.col("hi"))).drop("lo", "hi")


def oos(members: DataFrame) -> DataFrame:
    """All validation origins, each once, in the folds' order."""
    return members.where("role = 'val'").drop("role")


def effective_size(n: int, horizon: int) -> int:
    return n // horizon


def gap_audit(bounds: DataFrame, breaks: DataFrame, reach: int) -> DataFrame:
    """(fold, role, edge, boundary, break_pos, distance): discontinuities near a block's ends; bounds in positions."""
    edges = bounds.select("fold", "role", F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col("lo").alias("at")), F.struct(F.lit("end").alias("edge"), F.col("hi").alias("at")))).alias("e")).select("fold", "role", "e.edge", F.col("e.at").alias("boundary"))
    near = breaks.select(F.col("pos").alias("break_pos")).join(edges, F.abs(F.col("break_pos") - F.col("boundary")) <= reach)
    return near.select("fold", "role", "edge", "boundary", "break_pos", F.abs(F.col("break_pos") - F.col("boundary")).alias("distance"))


def violations(folds: list[Fold], purge: int) -> list[str]:
    """What breaks the geometry's promises, in words; empty when all hold."""
    out = []
    if len({f.train[1] - f.train[0] for f in folds}) > 1:
        out.append("training blocks differ in length")
    for f in folds:
        if f.val[0] - f.train[1] < purge:
            out.append(f"fold {f.fold}: validation starts inside the purge")
        if f.inner_val[0] - f.inner_train[1] < purge or f.inner_val[1] != f.train[1] or f.inner_train[0] != f.train[0]:
            out.append(f"fold {f.fold}: inner split")
    for a, b in zip(folds, folds[1:]):
        if b.val[0] != a.val[1] + 1:
            out.append(f"fold {b.fold}: validation isn't contiguous")
    return out


def geometry_report(bounds: DataFrame, purge: int) -> DataFrame:
    """(fold, length, gap, inner_gap, contiguous, holds) of bounds_table's rows: violations as rows. gap is from the last training origin
    to the first of validation, inner_gap the same inside; holds: both at least `purge`, and the training length is everybody's."""
    at = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    p = bounds.groupBy("fold").agg((at("train", "hi") - at("train", "lo") + 1).alias("length"), (at("val", "lo") - at("train", "hi")).alias("gap"), (at("inner_val", "lo") - at("inner_train", "hi")).alias("inner_gap"), at("val", "lo").alias("a"), at("val", "hi").alias("z"))
    before = F.lag("z").over(Window.orderBy("fold"))  # a row a fold
    whole = F.max("length").over(Window.partitionBy())
    return p.select("fold", "length", "gap", "inner_gap", F.coalesce(F.col("a") == before + 1, F.lit(True)).alias("contiguous"), ((F.col("gap") >= purge) & (F.col("inner_gap") >= purge) & (F.col("length") == whole)).alias("holds"))
