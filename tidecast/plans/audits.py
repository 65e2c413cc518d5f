"""Audit queries: fold geometry as rows, dependencies with a verdict for every group, business days of a table, horizon correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, folds, score, sessions, windows
from ..sources.io import read_table
from .catalogue import _LABELS, _ORIG, _folds, _labels, _r, query

_STEPS = [f"y_{k}" for k in range(1, windows.HORIZON + 1)]


@query(_ORIG + """, p AS (SELECT fold, max(hi - lo + 1) FILTER (role = 'train') AS length, max(lo) FILTER (role = 'val') - max(hi) FILTER (role = 'train') AS gap, max(lo) FILTER (role = 'inner_val') - max(hi) FILTER (role = 'inner_train') AS inner_gap, max(lo) FILTER (role = 'val') AS a, max(hi) FILTER (role = 'val') AS z FROM b GROUP BY fold)
SELECT fold, CAST(length AS BIGINT) AS length, CAST(gap AS BIGINT) AS gap, CAST(inner_gap AS BIGINT) AS inner_gap, coalesce(a = lag(z) OVER (ORDER BY fold) + 1, true) AS contiguous, gap >= 10 AND inner_gap >= 10 AND length = max(length) OVER () AS holds FROM p""", shared=True)
def fold_violations(spark, sf):
    """What the geometry promises, fold by fold: equal lengths, purged gaps, contiguous validation blocks."""
    _, found = _folds(spark, sf)
    return folds.geometry_report(folds.bounds_table(spark, found), windows.HORIZON)


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS targets, count(*) AS n, count(DISTINCT o_orderstatus) <= 1 AS holds FROM orders GROUP BY 1")
def dependency_verdicts(spark, sf):
    """Whether a customer has orders of one status only, for every customer."""
    return audit.dependency_report(read_table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM o)
SELECT s.d, coalesce(n, 0) AS n FROM s LEFT JOIN o ON o.d = s.d WHERE isodow(s.d) < 6 AND s.d NOT IN (DATE '1995-07-04', DATE '1996-07-04')""")
def business_day_orders(spark, sf):
    """Every business day from the first order to the last, with its orders."""
    orders = read_table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    ends = orders.agg(F.min("d").cast("string"), F.max("d").cast("string")).first()
    spine = sessions.business_days(spark, *ends, ("1995-07-04", "1996-07-04"))
    return spine.join(orders, "d", "left").select("d", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(_LABELS + " " + " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS step_a, CAST({j + 1} AS INTEGER) AS step_b, round(corr({a}, {b}), 7) + 0.0 AS r FROM labels" for i, a in enumerate(_STEPS) for j, b in enumerate(_STEPS) if i < j), shared=True)
def horizon_correlation(spark, sf):
    return score.horizon_correlation(_labels(spark, sf), _STEPS).select("step_a", "step_b", *_r("r", digits=7))
