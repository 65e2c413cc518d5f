"""Queries over one long unpartitioned series: scans, windows, runs and as-of joins by dealt ranges of the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges as R
from ..sources.io import read_table
from .catalogue import query

_LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_BY = ", ".join(_LINE)


@query(f"""WITH x AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS back FROM lineitem)
SELECT {_BY}, row_number() OVER w AS place, sum(l_quantity) OVER w AS quantity_so_far, max(l_extendedprice) OVER w AS highest, last_value(back IGNORE NULLS) OVER w AS last_back FROM x WINDOW w AS (ORDER BY {_BY} ROWS UNBOUNDED PRECEDING)""")
def line_scan(spark, sf):
    """Place, running sum, running maximum and forward fill along all lines by shipping date."""
    li = read_table(spark, sf, "lineitem").select(*_LINE, "l_quantity", F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("back"))
    kinds = {"place": ("count", "l_orderkey"), "quantity_so_far": ("sum", "l_quantity"), "highest": ("max", "l_extendedprice"), "last_back": ("last", "back")}
    return R.running(li, _LINE, kinds).select(*_LINE, *kinds)


@query("""SELECT event_id, lag(value) OVER w AS lag_1, lag(value, 20) OVER w AS lag_20, (lead(value) OVER w - lag(value) OVER w) / 2 AS rate,
CASE WHEN count(value) OVER (ORDER BY ts, event_id ROWS 9 PRECEDING) = 10 THEN round(avg(value) OVER (ORDER BY ts, event_id ROWS 9 PRECEDING), 8) END AS mean_10 FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def event_neighbours(spark, sf):
    """Lags, central difference and rolling mean along all events by time."""
    ev = read_table(spark, sf, "events").select("ts", "event_id", "value")
    back = lambda w: w.rowsBetween(-9, 0)
    columns = {"lag_1": lambda w: F.lag("value").over(w), "lag_20": lambda w: F.lag("value", 20).over(w), "rate": lambda w: (F.lead("value").over(w) - F.lag("value").over(w)) / 2, "mean_10": lambda w: F.when(F.count("value").over(back(w)) == 10, F.round(F.avg("value").over(back(w)), 8))}
    return R.over_halo(ev, ["ts", "event_id"], columns, 20, 1).select("event_id", *columns)


@query("""WITH p AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY ts, event_id) AS p FROM events), f AS (SELECT event_id, ts, p IS NOT NULL AND ts - p < INTERVAL 60 SECOND AS close FROM p),
g AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, row_number() OVER (ORDER BY ts, event_id) - row_number() OVER (PARTITION BY close ORDER BY ts, event_id) AS k FROM f)
SELECT event_id, min(i) OVER (PARTITION BY close, k) AS run_start, count(*) OVER (PARTITION BY close, k) AS run_rows FROM g WHERE close""")
def event_runs(spark, sf):
    """Runs of events that follow one another within a minute, over all users."""
    ev = read_table(spark, sf, "events").select("ts", "event_id")
    order = ["ts", "event_id"]
    cuts = R.cut_points(ev, order)
    near = R.over_halo(ev, order, {"before": lambda w: F.lag("ts").over(w)}, 1, cuts=cuts)
    flagged = near.select(*order, F.coalesce(F.col("ts") - F.col("before") < F.expr("INTERVAL 60 SECOND"), F.lit(False)).alias("close"))
    return R.runs(flagged, order, "close", cuts=cuts).where("close").select("event_id", "run_start", "run_rows")


@query("""WITH o AS (SELECT o_orderdate, min(o_orderkey) AS k FROM orders GROUP BY 1), l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_shipdate + INTERVAL 5 HOUR AS at FROM lineitem)
SELECT l.l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o.k AS next_order FROM l ASOF LEFT JOIN o ON l.at <= o.o_orderdate""")
def next_order(spark, sf):
    """The first order placed at or after each line's shipping, both sides whole and without a partition key."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_shipdate") + F.expr("INTERVAL 5 HOURS")).alias("at"))
    orders = read_table(spark, sf, "orders").select("o_orderdate", F.col("o_orderkey").alias("next_order"))
    return R.asof_forward(li, orders, "at", "o_orderdate", "next_order").drop("at")
