"""Window operators over ordered series: returns, horizon matrices, origins, blocks, exposure, rolling and phase operators.

Every function takes the ordering column and an optional partition_by, so a panel of series runs one task per series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PAST, FUTURE, HORIZON = 60, 30, 10
#: Ranges that transitions() deals its rows into.
RANGES = 64


def along(order: Sequence[str] | str, partition_by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*partition_by).orderBy(*([order] if isinstance(order, str) else order))


def step_returns(history: DataFrame, value: str = "c", order: str = "d", partition_by: Sequence[str] = ()) -> DataFrame:
    """r = ln(value) - ln(previous value) over observed rows; each series' first row goes."""
    log = F.ln(value)
    out = history.withColumn("r", log - F.lag(log).over(along(order, partition_by)))
    return out.where(F.col("r").isNotNull())


def elapsed_days(sessions: DataFrame, order: str = "d", partition_by: Sequence[str] = ()) -> DataFrame:
    """Calendar days since the session before; each series' first row goes."""
    out = sessions.withColumn("elapsed", F.datediff(order, F.lag(order).over(along(order, partition_by))).cast("short"))
    return out.where(F.col("elapsed").isNotNull())


def lead_matrix(df: DataFrame, value: str, horizon: int, order: str = "pos", prefix: str = "y", partition_by: Sequence[str] = ()) -> DataFrame:
    """<prefix>_1 .. <prefix>_horizon: the value 1 .. horizon rows ahead, null past the end; one sort serves all."""
    w = along(order, partition_by)
    return df.select("*", *[F.lead(value, k).over(w).alias(f"{prefix}_{k}") for k in range(1, horizon + 1)])


def cumulative(matrix: DataFrame, horizon: int, prefix: str = "y", name: str = "cum") -> DataFrame:
    """Running sums along the horizon, derived and never stored."""
    total: Column = F.lit(0.0)
    cols = []
    for k in range(1, horizon + 1):
        total = total + F.col(f"{prefix}_{k}")
        cols.append(total.alias(f"{name}_{k}"))
    return matrix.select("*", *cols)


def trainable(pos: Column, n_history: Column, past: int = PAST, horizon: int = HORIZON) -> Column:
    """Origins with a full past block and labels for the whole horizon."""
    return (pos >= past - 1) & (pos <= n_history - horizon - 1)


def plannable(pos: Column, n_sessions: Column, past: int = PAST, ahead: int = FUTURE) -> Column:
    """Origins with a full past and a full future block."""
    return (pos >= past - 1) & (pos <= n_sessions - ahead - 1)


def forward(pos: Column, n_history: Column, n_sessions: Column, ahead: int = FUTURE) -> Column:
    """Origins from the last observed session to the last with a full future block: covariates known, no labels."""
    return (pos >= n_history - 1) & (pos <= n_sessions - ahead - 1)


def counted(sessions: DataFrame) -> DataFrame:
    """sessions with n_history and n_sessions on every row; a window over one task, for session-sized frames."""
    w = Window.partitionBy()
    return sessions.select("*", F.count_if(F.col("is_history")).over(w).alias("n_history"), F.count("*").over(w).alias("n_sessions"))


def window_blocks(origins: DataFrame, sessions: DataFrame, past: int = PAST, future: int = FUTURE, horizon: int = HORIZON) -> DataFrame:
    """(origin, block, step, d): the past, future and target sessions of each origin; offsets expand to an equi-join on pos."""
    block = lambda name, lo, hi: F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.struct(F.lit(name).alias("block"), k.alias("step")))
    blocks = F.concat(block("past", 1 - past, 0), block("future", 1, future), block("target", 1, horizon))
    spread = origins.select(F.col("pos").alias("origin"), F.explode(blocks).alias("b")).select("origin", "b.block", "b.step", (F.col("origin") + F.col("b.step")).alias("pos"))
    return spread.join(sessions.select("pos", "d"), "pos").select("origin", "block", "step", "d")


def exposure(sessions: DataFrame, breaks: DataFrame, past: int = PAST, horizon: int = HORIZON, partition_by: Sequence[str] = ()) -> DataFrame:
    """hits_target and hits_window: whether a discontinuity p has first < p <= last for (pos, pos + horizon] and
    (pos - past + 1, pos + horizon]; differences of one running count, no range join."""
    flagged = sessions.join(breaks.select("pos", F.lit(1).alias("b")), "pos", "left")
    w = along("pos", partition_by)
    upto = flagged.withColumn("upto", F.sum(F.coalesce("b", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.coalesce(F.lag("upto", past - 1).over(w), F.lit(0))
    last = F.lead("upto", horizon).over(w)
    return upto.select("pos", "d", (last - F.col("upto") > 0).alias("hits_target"), (last - first > 0).alias("hits_window")).where(F.col("hits_target").isNotNull())


def forward_fill(df: DataFrame, value: str, order: str = "d", partition_by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(f"{value}_filled", F.last(value, ignorenulls=True).over(along(order, partition_by).rowsBetween(Window.unboundedPreceding, 0)))


def lags(df: DataFrame, value: str, steps: Sequence[int] = (1, 2, 5, 10, 20), order: str = "d", partition_by: Sequence[str] = ()) -> DataFrame:
    w = along(order, partition_by)
    return df.select("*", *[F.lag(value, k).over(w).alias(f"{value}_lag{k}") for k in steps])


def rolling(df: DataFrame, value: str, sizes: Sequence[int] = (5, 10, 20), order: str = "d", partition_by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation over full windows only; Spark itself would emit partial ones."""
    cols = []
    for k in sizes:
        w = along(order, partition_by).rowsBetween(1 - k, 0)
        full = F.count(value).over(w) == k
        cols += [F.when(full, F.avg(value).over(w)).alias(f"mean_{k}"), F.when(full, F.stddev_samp(value).over(w)).alias(f"std_{k}")]
    return df.select("*", *cols)


def changes(df: DataFrame, value: str, order: str = "d", roc: int = 5, mean: int = 5, digits: int = 4, mean_digits: int = 6, partition_by: Sequence[str] = ()) -> DataFrame:
    """Percent change to the row before and roc rows before, and the rolling mean of the rounded change, rounded to mean_digits."""
    w = along(order, partition_by)
    change = F.round(100 * F.try_divide(F.col(value) - F.lag(value).over(w), F.lag(value).over(w)), digits)
    out = df.select("*", change.alias("pct"), F.round(100 * F.try_divide(F.col(value) - F.lag(value, roc).over(w), F.lag(value, roc).over(w)), digits).alias("roc"))
    full = F.count("pct").over(w.rowsBetween(1 - mean, 0)) == mean
    return out.select("*", F.when(full, F.round(F.avg("pct").over(w.rowsBetween(1 - mean, 0)), mean_digits)).alias("pct_mean"))


def direction(x: Column) -> Column:
    """1, -1 or 0; null is 0."""
    return F.coalesce(F.signum(x), F.lit(0)).cast("byte")


def holiday_flag(daily: DataFrame, cutoff: str, value: str = "c") -> DataFrame:
    """Before the cutoff a null value or weekend, after it a weekend; to be taken before any filling."""
    weekend = F.weekday("d") >= 5
    return daily.withColumn("is_holiday", F.when(F.col("d") < F.to_date(F.lit(cutoff)), weekend | F.col(value).isNull()).otherwise(weekend))


def unwrap(df: DataFrame, angle: str, order: str, period: float = 360.0, partition_by: Sequence[str] = ()) -> DataFrame:
    """angle plus whole turns, so that no step exceeds half a period."""
    w = along(order, partition_by)
    step = F.col(angle) - F.lag(angle).over(w)
    turns = F.coalesce(F.when(step > period / 2, -F.ceil((step - period / 2) / period)).when(step < -period / 2, F.ceil((-step - period / 2) / period)), F.lit(0))
    out = df.withColumn("_turns", turns)
    return out.withColumn(f"{angle}_unwrapped", F.col(angle) + period * F.sum("_turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turns")


def central_difference(df: DataFrame, value: str, order: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """(next - previous) / 2 of the rows that have both."""
    w = along(order, partition_by)
    return df.withColumn("rate", (F.lead(value).over(w) - F.lag(value).over(w)) / 2).where(F.col("rate").isNotNull())


def transitions(df: DataFrame, value: str, order: Sequence[str], before: object, after: object, partition_by: Sequence[str] = ()) -> DataFrame:
    """How often `after` directly follows `before` along the order, whose first column is a number.

    Rows are dealt into ranges of that column, so a group is no single task. Transitions inside a range are counted there, in one
    shuffle of the value and order columns; those between ranges come from each range's first and last value, a row a group
    and range.
    """
    return _steps(df, value, order, lambda prev, now: (prev == F.lit(before)) & (now == F.lit(after)), partition_by).select(*partition_by, F.col("hits").alias("transitions"))


def _steps(df: DataFrame, value: str, order: Sequence[str], hit: Callable[[Column, Column], Column], partition_by: Sequence[str]) -> DataFrame:
    """(partition_by, hits, n): neighbours along the order, of the value before and the value, that are a hit, and rows."""
    by, place, names = list(partition_by), F.struct(*order), list(dict.fromkeys([*partition_by, value, *order]))
    cuts = df.agg(F.percentile_approx(F.col(order[0]).cast("double"), [k / RANGES for k in range(1, RANGES)]).alias("_cuts"))
    bucket = F.when(F.col(order[0]).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda x: x < F.col(order[0]))))
    dealt = df.select(*names).crossJoin(F.broadcast(cuts)).select(*names, bucket.alias("_bucket"))
    stepped = dealt.withColumn("_prev", F.lag(value).over(along(order, [*by, "_bucket"])))
    ends = stepped.groupBy(*by, "_bucket").agg(F.count_if(hit(F.col("_prev"), F.col(value))).alias("_hits"), F.count("*").alias("_n"), F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"))
    ends = ends.withColumn("_prev", F.lag("_last").over(along("_bucket", by)))
    return ends.groupBy(*by).agg((F.sum("_hits") + F.count_if(hit(F.col("_prev"), F.col("_first")))).alias("hits"), F.sum("_n").alias("n"))


def monotone_violations(df: DataFrame, code: str, order: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """How often the code falls along the order, whose first column is a number and whose last columns break every tie; by ranges of
    the order, as in transitions()."""
    return _steps(df, code, order, lambda prev, now: now < prev, partition_by).select(*partition_by, F.col("hits").alias("violations"), "n")
