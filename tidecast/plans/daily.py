"""Adapter from the order tables to the library's shapes: a daily close series with closures, gaps and a forward block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions, windows
from ..sources.io import read_table

START, END, CUTOFF, HOLDOUT = "1995-01-01", "2001-08-01", "2001-01-01", "2000-01-01"
# Exchange holidays of the forward block.
HOLIDAYS = ("2001-01-01", "2001-01-15", "2001-02-19", "2001-04-13", "2001-05-28", "2001-07-04")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, c) of every day: mean price of finished orders on weekdays before the cutoff, else null. Orders meet by day only."""
    orders = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    closes = orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.round(F.avg("o_totalprice"), 6).alias("c"))
    open_ = (F.weekday("d") < 5) & (F.col("d") < F.to_date(F.lit(CUTOFF)))
    return sessions.days(spark, START, END).join(closes, "d", "left").select("d", F.when(open_, F.col("c")).alias("c"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.observed(daily(spark, sf_dir))


def forward_days(spark: SparkSession) -> DataFrame:
    return sessions.business_days(spark, CUTOFF, END, HOLIDAYS)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, d, is_history, n_history, n_sessions)."""
    return windows.counted(sessions.session_index(history(spark, sf_dir), forward_days(spark)))


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap dates of the adapter: weekdays without an order before the cutoff."""
    return daily(spark, sf_dir).where((F.weekday("d") < 5) & F.col("c").isNull() & (F.col("d") < F.to_date(F.lit(CUTOFF)))).select("d")


#: The same shapes in SQL, in front of the catalogue's oracle queries.
SQL = """
WITH spine AS (SELECT CAST(t.d AS DATE) AS d FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-02', INTERVAL 1 DAY) t(d)),
closes AS (SELECT CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice), 6) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
daily AS (SELECT s.d, CASE WHEN isodow(s.d) < 6 AND s.d < DATE '2001-01-01' THEN k.c END AS c FROM spine s LEFT JOIN closes k ON k.d = s.d),
hist AS (SELECT d, c, row_number() OVER (ORDER BY d) - 1 AS pos FROM daily WHERE c IS NOT NULL),
fwd AS (SELECT d FROM spine WHERE d >= DATE '2001-01-01' AND isodow(d) < 6 AND d NOT IN (DATE '2001-01-01', DATE '2001-01-15', DATE '2001-02-19', DATE '2001-04-13', DATE '2001-05-28', DATE '2001-07-04')),
alls AS (SELECT d, true AS is_history FROM hist UNION ALL SELECT d, false FROM fwd),
idx AS (SELECT row_number() OVER (ORDER BY d) - 1 AS pos, d, is_history, (SELECT count(*) FROM hist) AS n_history, (SELECT count(*) FROM alls) AS n_sessions FROM alls),
steps AS (SELECT * FROM (SELECT d, pos, c, ln(c) - lag(ln(c)) OVER (ORDER BY d) AS r FROM hist) x WHERE r IS NOT NULL),
gaps AS (SELECT d FROM daily WHERE isodow(d) < 6 AND c IS NULL AND d < DATE '2001-01-01'),
breaks AS (SELECT DISTINCT p AS pos FROM (SELECT g.d, min(i.pos) AS p FROM gaps g JOIN idx i ON i.d >= g.d GROUP BY g.d) x WHERE p > 0)
"""
