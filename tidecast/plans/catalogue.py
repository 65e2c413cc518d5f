"""The query catalogue: thin applications of the operators to the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import circular as C
from ..operators import audit, encoding, folds, schema, score, selection, sessions, windows
from ..sources.io import day, read_table
from ..streaming import events
from . import daily as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, shared: bool = False):
    """Registers a query under its function's name; shared: the SQL continues the daily adapter's WITH list."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (D.SQL + sql) if shared else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _r(*names: str, digits: int = 9) -> list:
    """Columns rounded for comparison, without negative zeros."""
    return [(F.round(n, digits) + 0.0).alias(n) for n in names]


LEVELS = {
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"],
    "o_orderstatus": ["F", "O", "P", "X"],
}
EVENT_LEVELS = ["view", "click", "purchase", "signup", "logout", "refund", "never"]


# --- sessions, returns, horizons -----------------------------------------------------------------------------------


@query("SELECT pos, d, is_history FROM idx", shared=True)
def session_index(spark, sf):
    return D.index(spark, sf).select("pos", "d", "is_history")


@query("SELECT d, round(r, 9) + 0.0 AS r FROM steps", shared=True)
def step_log_return(spark, sf):
    return windows.step_returns(D.history(spark, sf)).select("d", *_r("r"))


_LEADS = ", ".join(f"lead(r, {k}) OVER (ORDER BY pos) AS y_{k}" for k in range(1, 11))
_LABELS = f", labels AS (SELECT i.pos, i.d, x.* EXCLUDE (pos) FROM idx i JOIN (SELECT pos, {_LEADS} FROM (SELECT h.pos, s.r FROM hist h LEFT JOIN steps s ON s.pos = h.pos) q) x ON x.pos = i.pos WHERE i.pos BETWEEN 59 AND i.n_history - 11)"


def _labels(spark, sf):
    hist = windows.step_returns(D.history(spark, sf)).select("d", "r")
    idx = D.index(spark, sf)
    rows = idx.where("is_history").join(hist, "d", "left")
    matrix = windows.lead_matrix(rows, "r", windows.HORIZON)
    return matrix.where(windows.trainable(F.col("pos"), F.col("n_history")))


@query(_LABELS + " SELECT pos, d, " + ", ".join(f"round(y_{k}, 9) + 0.0 AS y_{k}" for k in range(1, 11)) + " FROM labels", shared=True)
def horizon_labels(spark, sf):
    return _labels(spark, sf).select("pos", "d", *_r(*[f"y_{k}" for k in range(1, 11)]))


@query(", c AS (SELECT i.pos, i.d, " + ", ".join(f"round(ln(lead(h.c, {k}) OVER (ORDER BY i.pos)) - ln(h.c), 8) + 0.0 AS cum_{k}" for k in range(1, 11)) + ", i.n_history FROM idx i JOIN hist h ON h.pos = i.pos) SELECT * EXCLUDE (n_history) FROM c WHERE pos BETWEEN 59 AND n_history - 11", shared=True)
def horizon_cumulative(spark, sf):
    return windows.cumulative(_labels(spark, sf), windows.HORIZON).select("pos", "d", *_r(*[f"cum_{k}" for k in range(1, 11)], digits=8))


@query("SELECT pos, CAST(unnest(range(1, 11)) AS BIGINT) AS step, round(unnest([" + ", ".join(f"y_{k}" for k in range(1, 11)) + "]), 9) + 0.0 AS value FROM labels")
def labels_long(spark, sf):
    long = schema.matrix_to_long(_labels(spark, sf), ["pos"], "y", windows.HORIZON)
    return long.select("pos", F.col("step").cast("long").alias("step"), *_r("value"))


SQL["labels_long"] = D.SQL + _LABELS + " " + SQL["labels_long"]


@query("SELECT pos, d, CAST(e AS BIGINT) AS elapsed FROM (SELECT pos, d, d - lag(d) OVER (ORDER BY d) AS e FROM idx) x WHERE e IS NOT NULL", shared=True)
def elapsed_steps(spark, sf):
    return windows.elapsed_days(D.index(spark, sf)).select("pos", "d", F.col("elapsed").cast("long").alias("elapsed"))


@query(", e AS (SELECT pos, d, n_history, n_sessions, CAST(d - lag(d) OVER (ORDER BY d) AS BIGINT) AS e FROM idx), m AS (SELECT *, " + ", ".join(f"lead(e, {k}) OVER (ORDER BY pos) AS elapsed_{k}" for k in range(1, 11)) + " FROM e) SELECT pos, d, " + ", ".join(f"elapsed_{k}" for k in range(1, 11)) + " FROM m WHERE pos BETWEEN n_history - 1 AND n_sessions - 31", shared=True)
def forward_elapsed(spark, sf):
    m = windows.lead_matrix(windows.elapsed_days(D.index(spark, sf)), "elapsed", windows.HORIZON, prefix="elapsed")
    return m.where(windows.forward(F.col("pos"), F.col("n_history"), F.col("n_sessions"))).select("pos", "d", *[F.col(f"elapsed_{k}").cast("long").alias(f"elapsed_{k}") for k in range(1, 11)])


@query("""SELECT o.pos AS origin, b.block, CAST(s.pos - o.pos AS BIGINT) AS step, s.d FROM idx o, (VALUES ('past', -59, 0), ('future', 1, 30), ('target', 1, 10)) b(block, lo, hi), idx s
WHERE o.pos BETWEEN 59 AND o.n_history - 11 AND s.pos BETWEEN o.pos + b.lo AND o.pos + b.hi""", shared=True)
def window_blocks(spark, sf):
    idx = D.index(spark, sf)
    origins = idx.where(windows.trainable(F.col("pos"), F.col("n_history")))
    return windows.window_blocks(origins, idx).select("origin", "block", F.col("step").cast("long").alias("step"), "d")


@query("""SELECT kind, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM (SELECT 'trainable' AS kind, d FROM idx WHERE pos BETWEEN 59 AND n_history - 11
UNION ALL SELECT 'plannable', d FROM idx WHERE pos BETWEEN 59 AND n_sessions - 31 UNION ALL SELECT 'forward', d FROM idx WHERE pos BETWEEN n_history - 1 AND n_sessions - 31) x GROUP BY kind""", shared=True)
def origins_by_kind(spark, sf):
    idx = D.index(spark, sf)
    p, h, n = F.col("pos"), F.col("n_history"), F.col("n_sessions")
    kinds = F.array_compact(F.array(F.when(windows.trainable(p, h), "trainable"), F.when(windows.plannable(p, n), "plannable"), F.when(windows.forward(p, h, n), "forward")))
    return idx.select(F.explode(kinds).alias("kind"), "d").groupBy("kind").agg(F.count("*").alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query("SELECT max(n_sessions) - 31 AS last_full, max(n_sessions) - 11 AS last_horizon, max(n_sessions) - max(n_history) AS runway, max(n_sessions) - 30 - max(n_history) + 1 AS forward_origins FROM idx", shared=True)
def runway(spark, sf):
    n, h = F.max("n_sessions"), F.max("n_history")
    return D.index(spark, sf).agg((n - windows.FUTURE - 1).alias("last_full"), (n - windows.HORIZON - 1).alias("last_horizon"), (n - h).alias("runway"), (n - windows.FUTURE - h + 1).alias("forward_origins"))


# --- calendars and gaps --------------------------------------------------------------------------------------------


@query("SELECT d FROM fwd", shared=True)
def business_days(spark, sf):
    return D.forward_days(spark)


@query(""", lim AS (SELECT max(d) AS l FROM daily WHERE c IS NOT NULL), seen AS (SELECT * FROM daily, lim WHERE d <= l)
SELECT count(*) FILTER (isodow(d) < 6 AND c IS NULL) AS closed_all, count(*) FILTER (isodow(d) < 6) AS weekdays_all, round(count(*) FILTER (isodow(d) < 6 AND c IS NULL) / count(*) FILTER (isodow(d) < 6), 5) AS rate_all,
count(*) FILTER (isodow(d) < 6 AND c IS NULL AND year(d) <> 1998) AS closed_kept, count(*) FILTER (isodow(d) < 6 AND year(d) <> 1998) AS weekdays_kept,
round(count(*) FILTER (isodow(d) < 6 AND c IS NULL AND year(d) <> 1998) / count(*) FILTER (isodow(d) < 6 AND year(d) <> 1998), 5) AS rate_kept, count(*) FILTER (isodow(d) > 5 AND c IS NOT NULL) AS weekend_sessions FROM seen""", shared=True)
def weekday_rule_error(spark, sf):
    return sessions.rule_error(D.daily(spark, sf), skip_years=[1998])


@query("SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS closures FROM daily WHERE d <= (SELECT max(d) FROM daily WHERE c IS NOT NULL) AND isodow(d) < 6 AND c IS NULL GROUP BY 1", shared=True)
def closures_per_year(spark, sf):
    return sessions.closures_per_year(D.daily(spark, sf))


_RUNS = """, w AS (SELECT d, c IS NOT NULL AS o FROM daily WHERE isodow(d) < 6 AND d < DATE '2001-01-01'), g AS (SELECT d, o, row_number() OVER (ORDER BY d) - row_number() OVER (PARTITION BY o ORDER BY d) AS i FROM w),
runs AS (SELECT * FROM (SELECT d, min(d) OVER (PARTITION BY i) AS run_start, count(*) OVER (PARTITION BY i) AS run_days FROM g WHERE NOT o) x WHERE run_days >= 2)"""


def _before_cutoff(spark, sf):
    return D.daily(spark, sf).where(F.col("d") < F.to_date(F.lit(D.CUTOFF)))


@query(_RUNS + " SELECT d, run_start, run_days FROM runs", shared=True)
def closed_runs(spark, sf):
    return sessions.closed_runs(_before_cutoff(spark, sf), min_run=2)


@query(_RUNS + """, bad AS (SELECT g.d FROM gaps g WHERE year(g.d) IN (SELECT year(d) FROM gaps GROUP BY 1 HAVING count(*) >= 40)), flagged AS (SELECT d FROM bad UNION SELECT d FROM runs)
SELECT d, 'gap' AS rule FROM flagged UNION ALL SELECT d, 'residue' FROM gaps WHERE d NOT IN (SELECT d FROM bad)""", shared=True)
def gap_rules(spark, sf):
    return sessions.gap_dates(_before_cutoff(spark, sf), D.closures(spark, sf), least=40, min_run=2)


@query("SELECT g.d, min(i.pos) AS pos FROM gaps g LEFT JOIN idx i ON i.d >= g.d GROUP BY g.d", shared=True)
def gap_bfill(spark, sf):
    return sessions.asof_forward(D.closures(spark, sf), D.index(spark, sf), "d", "d", "pos")


@query("SELECT pos FROM breaks", shared=True)
def discontinuities(spark, sf):
    return sessions.discontinuities(D.closures(spark, sf), D.index(spark, sf))


@query("""SELECT i.pos, i.d, EXISTS (SELECT 1 FROM breaks b WHERE b.pos > i.pos AND b.pos <= i.pos + 10) AS hits_target, EXISTS (SELECT 1 FROM breaks b WHERE b.pos > i.pos - 59 AND b.pos <= i.pos + 10) AS hits_window
FROM idx i WHERE i.pos BETWEEN 59 AND i.n_history - 11""", shared=True)
def gap_exposure(spark, sf):
    idx = D.index(spark, sf)
    hits = windows.exposure(idx, sessions.discontinuities(D.closures(spark, sf), idx))
    return hits.join(idx.where(windows.trainable(F.col("pos"), F.col("n_history"))).select("pos"), "pos", "left_semi").select("pos", "d", "hits_target", "hits_window")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT d FROM hist)", shared=True)
def restrict_sessions(spark, sf):
    orders = day(read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "d")
    return sessions.restrict(orders, D.history(spark, sf))


@query("SELECT d FROM fwd WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')", shared=True)
def missing_sessions(spark, sf):
    orders = day(read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"), "o_orderdate").select("d")
    return sessions.missing_sessions(orders, D.forward_days(spark))


@query("""SELECT d, 'derived' AS side FROM (SELECT d FROM gaps WHERE d >= DATE '2000-01-01' EXCEPT SELECT d FROM spine WHERE d >= DATE '2000-01-01' AND day(d) = 1) x
UNION ALL SELECT d, 'frozen' FROM (SELECT d FROM spine WHERE d >= DATE '2000-01-01' AND day(d) = 1 EXCEPT SELECT d FROM gaps WHERE d >= DATE '2000-01-01') y""", shared=True)
def holiday_audit(spark, sf):
    frozen = sessions.days(spark, "2000-01-01", D.END).where("day(d) = 1")
    return sessions.holiday_differences(D.closures(spark, sf).where("d >= DATE '2000-01-01'"), frozen)


# --- circular features ---------------------------------------------------------------------------------------------


def _angles(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    return li.select("*", C.modulo(F.col("l_extendedprice"), 360).alias("a"), C.modulo(F.col("l_quantity") * 7.2, 360).alias("b"))


_ANGLES = "WITH x AS (SELECT *, ((l_extendedprice % 360) + 360) % 360 AS a, (((l_quantity * 7.2) % 360) + 360) % 360 AS b FROM lineitem) "
_KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
_K = "l_orderkey, l_linenumber, l_partkey, "


@query(_ANGLES + "SELECT " + _K + "round(sin(2 * pi() * a / 360), 8) + 0.0 AS a_sin, round(cos(2 * pi() * a / 360), 8) + 0.0 AS a_cos FROM x")
def sin_cos_pairs(spark, sf):
    s, c = C.sin_cos(F.col("a"), 360)
    return _angles(spark, sf).select(*_KEYS, (F.round(s, 8) + 0.0).alias("a_sin"), (F.round(c, 8) + 0.0).alias("a_cos"))


@query(_ANGLES + "SELECT count(*) FILTER (abs(sqrt(pow(sin(radians(a)), 2) + pow(cos(radians(a)), 2)) - 1) > 1e-9) AS bad, count(*) AS n FROM x")
def unit_circle_check(spark, sf):
    s, c = C.sin_cos(F.col("a"), 360)
    return _angles(spark, sf).agg(F.count_if(C.off_unit_circle(s, c)).alias("bad"), F.count("*").alias("n"))


@query(_ANGLES + "SELECT " + _K + "round((((b - a) % 360) + 360) % 360, 6) + 0.0 AS ahead FROM x")
def signed_separation(spark, sf):
    return _angles(spark, sf).select(*_KEYS, (F.round(C.signed_separation(F.col("a"), F.col("b")), 6) + 0.0).alias("ahead"))


@query(_ANGLES + "SELECT " + _K + "round(least(abs(a - b), 360 - abs(a - b)), 6) + 0.0 AS apart, round(abs(((((b - a) + 180) % 360) + 360) % 360 - 180), 6) + 0.0 AS folded FROM x")
def circular_distance(spark, sf):
    return _angles(spark, sf).select(*_KEYS, (F.round(C.circular_distance(F.col("a"), F.col("b")), 6) + 0.0).alias("apart"), (F.round(C.folded_elongation(F.col("b") - F.col("a")), 6) + 0.0).alias("folded"))


@query("SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 9) + 0.0 AS w_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 9) + 0.0 AS w_cos FROM orders")
def weekday_cycle(spark, sf):
    orders = read_table(spark, sf, "orders")
    name = F.date_format("o_orderdate", "E")
    w = C.level_index(name, C.MONDAY_FIRST)
    s, c = C.sin_cos(w, 7)
    return orders.select("o_orderkey", w.alias("weekday"), (F.round(s, 9) + 0.0).alias("w_sin"), (F.round(c, 9) + 0.0).alias("w_cos"))


@query(_ANGLES + "SELECT " + _K + "CAST(floor(a / 30) AS BIGINT) % 12 AS sector, CAST(floor(a / (30.0 / 9.0)) AS BIGINT) % 12 AS ninth FROM x")
def sector_index(spark, sf):
    return _angles(spark, sf).select(*_KEYS, C.sector(F.col("a"), 30, 12).alias("sector"), C.sector(F.col("a"), 30.0 / 9.0, 12).alias("ninth"))


@query(_ANGLES + "SELECT " + _K + "round(1 - abs(a % 30 - 15) / 15, 8) + 0.0 AS ramp FROM x")
def triangular_ramp(spark, sf):
    return _angles(spark, sf).select(*_KEYS, (F.round(C.triangular_ramp(F.col("a"), 30), 8) + 0.0).alias("ramp"))


@query(_ANGLES + "SELECT " + _K + "round(greatest(0, least(100, 100 * (a - CASE WHEN l_returnflag = 'R' THEN 8 ELSE 12 END) / (180.0 - CASE WHEN l_returnflag = 'R' THEN 8 ELSE 12 END))), 6) + 0.0 AS ramp FROM x")
def clipped_ramp(spark, sf):
    low = F.when(F.col("l_returnflag") == "R", 8.0).otherwise(12.0)
    return _angles(spark, sf).select(*_KEYS, (F.round(C.clipped_ramp(F.col("a"), low, 180), 6) + 0.0).alias("ramp"))


@query(_ANGLES + "SELECT " + _K + "round(75 + 25 * cos(radians(a - 33)), 7) + 0.0 AS strength FROM x")
def cosine_strength(spark, sf):
    return _angles(spark, sf).select(*_KEYS, (F.round(C.cosine_strength(F.col("a"), 33), 7) + 0.0).alias("strength"))


@query(_ANGLES + "SELECT " + _K + "round(CASE CAST(floor(a / 30) AS BIGINT) % 12 % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.25 END * (1 - abs(a % 30 - 15) / 15), 8) + 0.0 AS ramp FROM x")
def dignity_ramp(spark, sf):
    return _angles(spark, sf).select(*_KEYS, (F.round(C.dignity_ramp(F.col("a"), 30, 12, [1.0, 0.75, 0.5, 0.25] * 3), 8) + 0.0).alias("ramp"))


@query(_ANGLES + "SELECT " + _K + "round(CASE WHEN l_returnflag = 'R' THEN -2.5 * l_discount + 0.5 ELSE 0 END, 9) + 0.0 AS line, round(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 WHEN 'R' THEN 3.0 END, 3) AS looked_up FROM x")
def conditional_line(spark, sf):
    line = C.conditional_line(F.col("l_returnflag") == "R", F.col("l_discount"), -2.5, 0.5)
    return _angles(spark, sf).select(*_KEYS, (F.round(line, 9) + 0.0).alias("line"), C.lookup(F.col("l_returnflag"), {"A": 1.0, "N": 2.0, "R": 3.0}).alias("looked_up"))


@query(_ANGLES + "SELECT CAST(floor(((((a - b) % 360) + 360) % 360) / 12) AS BIGINT) + 1 AS bin, count(*) AS n FROM x GROUP BY 1")
def tithy_bin(spark, sf):
    return _angles(spark, sf).groupBy(C.lunar_bin(F.col("a"), F.col("b")).alias("bin")).agg(F.count("*").alias("n"))


@query(_ANGLES + "SELECT count(*) FILTER (abs(a - b) > 180 AND least(abs(a - b), 360 - abs(a - b)) < 30) AS misleading, count(*) AS n FROM x")
def misleading_cells(spark, sf):
    apart = F.abs(F.col("a") - F.col("b"))
    return _angles(spark, sf).agg(F.count_if((apart > 180) & (C.circular_distance(F.col("a"), F.col("b")) < 30)).alias("misleading"), F.count("*").alias("n"))


@query(_ANGLES + "SELECT DISTINCT round((((a + 180) % 360 - a) % 360 + 360) % 360, 6) + 0.0 AS turn FROM x")
def antipodal_check(spark, sf):
    return _angles(spark, sf).select((F.round(C.signed_separation(F.col("a"), C.antipode(F.col("a"))), 6) + 0.0).alias("turn")).distinct()


def _phase(spark, sf):
    return D.index(spark, sf).select("pos", "d", C.modulo(F.col("pos") * 77.3, 360).alias("angle"))


_PHASE = ", p AS (SELECT pos, d, ((pos * 77.3) % 360 + 360) % 360 AS angle FROM idx)"


@query(_PHASE + """, s AS (SELECT *, angle - lag(angle) OVER (ORDER BY pos) AS st FROM p), t AS (SELECT *, coalesce(CASE WHEN st > 180 THEN -ceil((st - 180) / 360) WHEN st < -180 THEN ceil((-st - 180) / 360) END, 0) AS turns FROM s)
SELECT pos, round(angle + 360 * sum(turns) OVER (ORDER BY pos), 5) + 0.0 AS angle_unwrapped FROM t""", shared=True)
def unwrap_phase(spark, sf):
    return windows.unwrap(_phase(spark, sf), "angle", "pos").select("pos", *_r("angle_unwrapped", digits=5))


@query(", q AS (SELECT pos, (lead(c) OVER (ORDER BY pos) - lag(c) OVER (ORDER BY pos)) / 2 AS rate FROM hist) SELECT pos, round(rate, 5) + 0.0 AS rate FROM q WHERE rate IS NOT NULL", shared=True)
def central_difference(spark, sf):
    hist = sessions.positions(D.history(spark, sf))
    return windows.central_difference(hist, "c", "pos").select("pos", *_r("rate", digits=5))


@query(_ANGLES + ", s AS (SELECT CAST(floor(a / 90) AS BIGINT) % 4 + 1 AS v, l_returnflag, lag(CAST(floor(a / 90) AS BIGINT) % 4 + 1) OVER (PARTITION BY l_returnflag ORDER BY a, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) AS p FROM x) SELECT l_returnflag, count(*) FILTER (p = 4 AND v = 1) AS transitions FROM s GROUP BY 1")
def wrap_transitions(spark, sf):
    rows = _angles(spark, sf).withColumn("v", C.sector(F.col("a"), 90, 4) + 1)
    return windows.transitions(rows, "v", ["a", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"], 4, 1, ["l_returnflag"])


@query("SELECT p_brand, count(*) FILTER (code < prev) AS violations, count(*) AS n FROM (SELECT p_brand, p_size % 7 AS code, lag(p_size % 7) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS prev FROM part) x GROUP BY 1")
def monotone_bin_violations(spark, sf):
    part = read_table(spark, sf, "part").withColumn("code", F.col("p_size") % 7)
    return windows.monotone_violations(part, "code", ["p_retailprice", "p_partkey"], ["p_brand"])


# --- schema and profiles -------------------------------------------------------------------------------------------


def _part(spark, sf):
    return read_table(spark, sf, "part").select("*", F.lit(7).alias("fixed"), (F.lit(5.0) + F.col("p_partkey") * 1e-12).alias("nearly"), (F.col("p_size") - 2).alias("low_size"))


_PART = """WITH x AS (SELECT *, 7 AS fixed, 5.0::DOUBLE + p_partkey * 1e-12::DOUBLE AS nearly, p_size - 2 AS low_size FROM part),
l AS (SELECT 'p_size' AS "column", CAST(p_size AS DOUBLE) AS v FROM x UNION ALL SELECT 'p_retailprice', p_retailprice FROM x UNION ALL SELECT 'fixed', fixed FROM x UNION ALL SELECT 'nearly', nearly FROM x UNION ALL SELECT 'low_size', low_size FROM x),
g AS (SELECT "column", count(*) AS n, count(*) - count(v) AS nulls, count(DISTINCT v) AS levels, min(v) AS low, max(v) AS high, avg(v) AS mean, stddev_samp(v) AS std FROM l GROUP BY 1) """
_NUMBERS = ["p_size", "p_retailprice", "fixed", "nearly", "low_size"]


@query(_PART + 'SELECT "column", n, nulls, levels, round(low, 6) AS low, round(high, 6) AS high, round(mean, 4) AS mean, round(std, 4) + 0.0 AS std FROM g')
def column_profile(spark, sf):
    p = schema.profile(_part(spark, sf), _NUMBERS)
    return p.select("column", "n", "nulls", "levels", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("mean", 4).alias("mean"), (F.round("std", 4) + 0.0).alias("std"))


@query(_PART + 'SELECT "column", levels, round(high - low, 9) + 0.0 AS span FROM g WHERE levels <= 1 OR high - low < 1e-6')
def constant_columns(spark, sf):
    return schema.constant_columns(_part(spark, sf), _NUMBERS).select("column", "levels", *_r("span"))


@query(_PART + 'SELECT "column", levels, round(mean, 6) AS mean FROM g WHERE levels > 1 AND high - low < 1e-6')
def degenerate_columns(spark, sf):
    return schema.degenerate_columns(_part(spark, sf), _NUMBERS).select("column", "levels", F.round("mean", 6).alias("mean"))


@query(_PART + 'SELECT "column", low FROM g WHERE low <= -1')
def log_unsafe_columns(spark, sf):
    return schema.log_unsafe(_part(spark, sf), _NUMBERS)


@query("""SELECT "column" FROM (SELECT 'toxic' AS "column", toxic AS v FROM labels UNION ALL SELECT 'quality', quality FROM labels UNION ALL SELECT 'doc_id', doc_id FROM labels) x GROUP BY 1 HAVING count(DISTINCT v) = 2""")
def binary_columns(spark, sf):
    return schema.binary_columns(read_table(spark, sf, "labels"), ["toxic", "quality", "doc_id"])


_LATE = "CASE WHEN o_orderdate < TIMESTAMP '2000-06-01' THEN o_totalprice END"


@query(f"""SELECT "column", count(*) FILTER (v IS NULL) AS nulls FROM (SELECT 'late' AS "column", CAST({_LATE} AS VARCHAR) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') x GROUP BY 1 HAVING count(*) FILTER (v IS NULL) > 0""")
def availability_after_cutoff(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("late", F.expr(_LATE.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    return schema.availability(orders, ["late", "o_orderpriority"], "o_orderdate", "2000-01-01")


@query("SELECT n_name, 'left' AS side FROM (SELECT n_name FROM nation WHERE n_regionkey < 3 EXCEPT SELECT n_name FROM nation WHERE n_regionkey > 1) a UNION ALL SELECT n_name, 'right' FROM (SELECT n_name FROM nation WHERE n_regionkey > 1 EXCEPT SELECT n_name FROM nation WHERE n_regionkey < 3) b")
def symmetric_difference(spark, sf):
    nation = read_table(spark, sf, "nation")
    return schema.symmetric_difference(nation.where("n_regionkey < 3").select("n_name"), nation.where("n_regionkey > 1").select("n_name"))


# --- encodings -----------------------------------------------------------------------------------------------------


_PRI = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']"


@query(f"SELECT o_orderkey, CAST(coalesce(list_position({_PRI}, o_orderpriority), 0) - 1 AS INTEGER) AS priority, CAST(coalesce(list_position(['F', 'O', 'P', 'X'], o_orderstatus), 0) - 1 AS INTEGER) AS status FROM orders")
def level_codes(spark, sf):
    orders = read_table(spark, sf, "orders")
    return orders.select("o_orderkey", encoding.level_code(F.col("o_orderpriority"), LEVELS["o_orderpriority"]).alias("priority"), encoding.level_code(F.col("o_orderstatus"), LEVELS["o_orderstatus"]).alias("status"))


@query("SELECT event_id, CAST(coalesce(list_position(list_sort(['view', 'click', 'purchase', 'signup', 'logout', 'refund', 'never']), event_type), 0) AS INTEGER) AS code FROM events")
def label_codes_reserved0(spark, sf):
    return read_table(spark, sf, "events").select("event_id", encoding.reserved_code(F.col("event_type"), EVENT_LEVELS).alias("code"))


@query("SELECT o_orderkey, CAST(coalesce(list_position(['None', 'F', 'O'], coalesce(CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 2 = 0 THEN o_orderstatus END, 'None')), 0) - 1 AS INTEGER) AS code FROM orders")
def ordinal_codes(spark, sf):
    status = F.when((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 2 == 0), F.col("o_orderstatus"))
    return read_table(spark, sf, "orders").select("o_orderkey", encoding.ordinal_code(status, ["None", "F", "O"]).alias("code"))


@query("""SELECT 'o_orderpriority' AS "column", l AS level FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) AS l) x WHERE l NOT IN (SELECT o_orderpriority FROM orders)
UNION ALL SELECT 'o_orderstatus', l FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS l) x WHERE l NOT IN (SELECT o_orderstatus FROM orders)""")
def never_observed_levels(spark, sf):
    return encoding.never_observed(read_table(spark, sf, "orders"), LEVELS)


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def undeclared_levels(spark, sf):
    return encoding.undeclared(read_table(spark, sf, "events"), "event_type", ["view", "click"])


def _nulled(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))


@query("SELECT o_orderkey, o_orderstatus, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, 'none') AS priority FROM orders")
def structural_fill(spark, sf):
    return encoding.fill(_nulled(spark, sf), {"priority": "none"})


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P') <> (o_orderstatus = 'O')")
def null_rule_violations(spark, sf):
    return encoding.null_rule_violations(_nulled(spark, sf), "priority", "o_orderstatus", "O").select("o_orderkey")


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')
SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(CAST((l_quantity - mq) / sq AS FLOAT) AS DOUBLE), 4) + 0.0 AS quantity, round(CAST(CAST((l_discount - md) / sd AS FLOAT) AS DOUBLE), 4) + 0.0 AS discount FROM lineitem, s""")
def fold_scaled(spark, sf):
    li = read_table(spark, sf, "lineitem")
    scaler = encoding.fit_scaler(li.where("l_shipdate < TIMESTAMP_NTZ '1998-01-01'"), ["l_quantity", "l_discount"])
    out = scaler.transform(li.select(*_KEYS, "l_quantity", "l_discount"))
    return out.select(*_KEYS, (F.round(F.col("l_quantity").cast("double"), 4) + 0.0).alias("quantity"), (F.round(F.col("l_discount").cast("double"), 4) + 0.0).alias("discount"))


@query("SELECT c_custkey, CAST(coalesce(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NEVER'], c_mktsegment), 0) - 1 AS INTEGER) AS c_mktsegment, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TINYINT) AS in_debt, round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 2) AS c_acctbal FROM customer")
def typed_view(spark, sf):
    customer = read_table(spark, sf, "customer").withColumn("in_debt", F.col("c_acctbal") < 0)
    out = encoding.view(customer, "tree", {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NEVER"]}, ["in_debt"], ["c_acctbal"], keep=["c_custkey"])
    return out.select("c_custkey", "c_mktsegment", "in_debt", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"))


@query("SELECT count(*) FILTER (NOT abs(x) <= 1) AS s, count(*) FILTER (NOT abs(y) <= 1) AS c FROM (SELECT sin(radians(l_extendedprice)) AS x, cos(radians(l_extendedprice)) AS y FROM lineitem) t")
def cyclic_range_check(spark, sf):
    s, c = C.sin_cos(F.col("l_extendedprice"), 360)
    return encoding.out_of_unit(read_table(spark, sf, "lineitem").select(s.alias("s"), c.alias("c")), ["s", "c"])


@query("WITH m AS (SELECT quantile_cont(v, 0.5) AS med FROM (SELECT CASE WHEN l_discount > 0.02 THEN l_quantity END AS v FROM lineitem) t) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_discount > 0.02 THEN l_quantity END, med) AS quantity, round(ln(1 + l_tax), 9) AS log_tax FROM lineitem, m")
def imputed(spark, sf):
    li = read_table(spark, sf, "lineitem").select(*_KEYS, F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("quantity"), F.round(encoding.log_scaled(F.col("l_tax")), 9).alias("log_tax"))
    return encoding.impute_median(li, ["quantity"])


# --- folds ---------------------------------------------------------------------------------------------------------


@query(", y AS (SELECT year(d) AS y, count(*) AS n FROM hist GROUP BY 1) SELECT CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS per_year FROM y WHERE y > (SELECT min(y) FROM y) AND y < (SELECT max(y) FROM y)", shared=True)
def sessions_per_year(spark, sf):
    return folds.sessions_per_year(D.history(spark, sf))


def _origins(spark, sf):
    """(i, pos, d): trainable origins before the holdout, numbered."""
    idx = D.index(spark, sf)
    rows = idx.where(windows.trainable(F.col("pos"), F.col("n_history")) & (F.col("d") < F.to_date(F.lit(D.HOLDOUT))))
    return sessions.positions(rows.select("pos", "d"), "d", name="i")


def _folds(spark, sf):
    """Geometry from two scalars; a history too short for two training years and five origins raises."""
    origins = _origins(spark, sf)
    n, per_year = origins.count(), folds.sessions_per_year(D.history(spark, sf)).first()[0]
    if n - 2 * per_year - windows.HORIZON < 5:
        raise ValueError(f"{n} origins are too few for two training years of {per_year}")
    return origins, folds.geometry(n, per_year, windows.HORIZON, train_years=2)


_ORIG = """, o AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, pos, d FROM idx WHERE pos BETWEEN 59 AND n_history - 11 AND d < DATE '2000-01-01'),
yr AS (SELECT year(d) AS y, count(*) AS n FROM hist GROUP BY 1), py AS (SELECT CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS p FROM yr WHERE y > (SELECT min(y) FROM yr) AND y < (SELECT max(y) FROM yr)),
k AS (SELECT (SELECT count(*) FROM o) AS n, 2 * p AS len, ((SELECT count(*) FROM o) - 2 * p - 10) AS pool FROM py),
f AS (SELECT CAST(u.f AS INTEGER) AS fold, n, len, pool, pool // 5 AS size, n - pool + (u.f - 1) * (pool // 5) AS v0 FROM k, range(1, 6) u(f)),
g AS (SELECT fold, v0, CASE WHEN fold = 5 THEN n - 1 ELSE v0 + size - 1 END AS v1, v0 - 10 - len + 1 AS t0, v0 - 10 AS t1, CAST(round_even(len * 0.15, 0) AS BIGINT) AS ins FROM f),
b AS (SELECT fold, 'train' AS role, t0 AS lo, t1 AS hi FROM g UNION ALL SELECT fold, 'inner_train', t0, t1 - ins + 1 - 10 FROM g UNION ALL SELECT fold, 'inner_val', t1 - ins + 1, t1 FROM g UNION ALL SELECT fold, 'val', v0, v1 FROM g)"""


@query(_ORIG + " SELECT fold, role, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM b", shared=True)
def fold_bounds(spark, sf):
    return folds.bounds_table(spark, _folds(spark, sf)[1])


@query(_ORIG + " SELECT fold, role, i, pos, d FROM o JOIN b ON o.i BETWEEN b.lo AND b.hi", shared=True)
def fold_membership(spark, sf):
    origins, f = _folds(spark, sf)
    return folds.membership(origins, folds.bounds_table(spark, f)).select("fold", "role", "i", "pos", "d")


@query(_ORIG + " SELECT fold, role, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM o JOIN b ON o.i BETWEEN b.lo AND b.hi WHERE role LIKE 'inner%' GROUP BY ALL", shared=True)
def inner_split(spark, sf):
    origins, f = _folds(spark, sf)
    inner = folds.membership(origins, folds.bounds_table(spark, f)).where("role LIKE 'inner%'")
    return inner.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query(_ORIG + " SELECT fold, i, pos, d FROM o JOIN b ON o.i BETWEEN b.lo AND b.hi WHERE role = 'val'", shared=True)
def oos_series(spark, sf):
    origins, f = _folds(spark, sf)
    return folds.oos(folds.membership(origins, folds.bounds_table(spark, f))).select("fold", "i", "pos", "d")


@query(_ORIG + ", v AS (SELECT count(*) AS n FROM o JOIN b ON o.i BETWEEN b.lo AND b.hi WHERE role = 'val') SELECT n, n // 10 AS effective FROM v", shared=True)
def effective_sample(spark, sf):
    origins, f = _folds(spark, sf)
    val = folds.oos(folds.membership(origins, folds.bounds_table(spark, f)))
    return val.agg(F.count("*").alias("n"), F.floor(F.count("*") / windows.HORIZON).alias("effective"))


@query(_ORIG + """, bp AS (SELECT fold, role, x.pos AS lo, y.pos AS hi FROM b JOIN o x ON x.i = b.lo JOIN o y ON y.i = b.hi), e AS (SELECT fold, role, 'start' AS edge, lo AS boundary FROM bp UNION ALL SELECT fold, role, 'end', hi FROM bp)
SELECT fold, role, edge, boundary, k.pos AS break_pos, abs(k.pos - boundary) AS distance FROM e JOIN breaks k ON abs(k.pos - boundary) <= 69""", shared=True)
def fold_gap_audit(spark, sf):
    origins, f = _folds(spark, sf)
    at = origins.select("i", "pos")
    bounds = folds.bounds_table(spark, f).join(at.toDF("lo", "p_lo"), "lo").join(at.toDF("hi", "p_hi"), "hi").select("fold", "role", F.col("p_lo").alias("lo"), F.col("p_hi").alias("hi"))
    return folds.gap_audit(bounds, sessions.discontinuities(D.closures(spark, sf), D.index(spark, sf)), windows.PAST + windows.HORIZON - 1)


@query(_ORIG + ", h AS (SELECT n, len, CAST(round_even(len * 0.15, 0) AS BIGINT) AS ins, n - pool // 5 AS v0 FROM f LIMIT 1) SELECT role, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM (SELECT 'train' AS role, v0 - 10 - len + 1 AS lo, v0 - 10 AS hi FROM h UNION ALL SELECT 'inner_train', v0 - 10 - len + 1, v0 - 10 - ins + 1 - 10 FROM h UNION ALL SELECT 'inner_val', v0 - 10 - ins + 1, v0 - 10 FROM h UNION ALL SELECT 'val', v0, n - 1 FROM h) q", shared=True)
def holdout_bounds(spark, sf):
    """The refit block before a holdout as long as one validation block."""
    origins, f = _folds(spark, sf)
    n, length = f[-1].val[1] + 1, f[0].train[1] - f[0].train[0] + 1
    first = n - (f[0].val[1] - f[0].val[0] + 1)
    return folds.bounds_table(spark, [folds.holdout(n, first, length, windows.HORIZON, train_years=1)]).select("role", "lo", "hi")


# --- audits, statistics, selection ---------------------------------------------------------------------------------


@query("SELECT p_brand, count(DISTINCT p_type) AS targets FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def fd_violations(spark, sf):
    return audit.dependency_violations(read_table(spark, sf, "part"), ["p_brand"], "p_type")


@query("SELECT n_nationkey, count(DISTINCT n_regionkey) AS targets FROM nation GROUP BY 1 HAVING count(DISTINCT n_regionkey) > 1")
def fd_holds(spark, sf):
    return audit.dependency_violations(read_table(spark, sf, "nation"), ["n_nationkey"], "n_regionkey")


@query("SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY ALL")
def contingency(spark, sf):
    return audit.contingency(read_table(spark, sf, "part"), "p_brand", "p_type").toDF("a", "b", "n")


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY 1""")
def crosstab(spark, sf):
    return audit.crosstab(read_table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("""WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(any_value(slope), 4) AS slope, round(any_value(intercept), 3) AS intercept, round(any_value(r), 8) AS r, any_value(n) AS n, round(max(abs(l_extendedprice - slope * l_quantity - intercept)), 2) AS max_residual FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1""")
def ols_fit(spark, sf):
    out = audit.line(read_table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 8).alias("r"), "n", F.round("max_residual", 2).alias("max_residual"))


@query(_ANGLES + "SELECT l_returnflag, round(max(a) - min(a), 6) AS span FROM x GROUP BY 1")
def group_span(spark, sf):
    return audit.span(_angles(spark, sf), ["l_returnflag"], "a").select("l_returnflag", F.round("span", 6).alias("span"))


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey_at_max FROM part GROUP BY 1")
def argmax_by_group(spark, sf):
    return audit.at_maximum(read_table(spark, sf, "part"), "p_partkey", "p_retailprice", "p_partkey", ["p_brand"])


@query("SELECT round(max(abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount))), 6) + 0.0 AS max_error FROM lineitem")
def recompute_error(spark, sf):
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    return audit.max_error(read_table(spark, sf, "lineitem"), p * (1 - d), p - p * d).select(*_r("max_error", digits=6))


@query(_ANGLES + "SELECT count(*) FILTER ((CAST(floor(a / 30) AS BIGINT) % 12 % 3) IS DISTINCT FROM l_linenumber % 3) AS mismatches, count(*) AS n FROM x")
def recompute_mismatches(spark, sf):
    return audit.mismatches(_angles(spark, sf), C.sector(F.col("a"), 30, 12) % 3, (F.col("l_linenumber") % 3).cast("long"))


@query(", t AS (SELECT r FROM steps) SELECT count(r) AS n, round(avg(r), 8) + 0.0 AS mean, round(stddev_pop(r), 8) AS std, round(min(r), 8) AS low, round(max(r), 8) AS high, round(skewness(r), 6) + 0.0 AS skew, round(kurtosis(r), 6) + 0.0 AS kurt FROM t", shared=True)
def skew_kurt(spark, sf):
    m = audit.moments(windows.step_returns(D.history(spark, sf)), "r")
    return m.select("n", *_r("mean", "std", "low", "high", digits=8), *_r("skew", "kurt", digits=6))


@query(_LABELS + " SELECT round((" + " + ".join(f"sum(CAST(abs(y_{k}) > 0.05 AS INTEGER))" for k in range(1, 11)) + ") / (count(*) * 10), 9) AS cell_share, round(avg(CAST(greatest(" + ", ".join(f"abs(y_{k})" for k in range(1, 11)) + ") > 0.05 AS INTEGER)), 9) AS row_share, count(*) AS n FROM labels", shared=True)
def tail_share(spark, sf):
    return audit.tail_share(_labels(spark, sf), [f"y_{k}" for k in range(1, 11)], 0.05).select(*_r("cell_share", "row_share"), "n")


@query(", e AS (SELECT s.r, CAST(i.d - lag(i.d) OVER (ORDER BY i.pos) AS BIGINT) AS elapsed FROM idx i LEFT JOIN steps s ON s.pos = i.pos) SELECT elapsed, count(r) AS n, round(avg(abs(r)), 8) AS mean_abs, round(stddev_samp(r), 8) AS std FROM e WHERE r IS NOT NULL GROUP BY 1", shared=True)
def elapsed_vol_profile(spark, sf):
    steps = windows.step_returns(D.history(spark, sf)).select("d", "r")
    rows = windows.elapsed_days(D.index(spark, sf)).join(steps, "d")
    return rows.groupBy(F.col("elapsed").cast("long").alias("elapsed")).agg(F.count("r").alias("n"), F.round(F.avg(F.abs("r")), 8).alias("mean_abs"), F.round(F.stddev_samp("r"), 8).alias("std"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT a, b, round(r, 8) + 0.0 AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + ") x")
def pearson_matrix(spark, sf):
    return selection.correlation_table(read_table(spark, sf, "lineitem"), _COLS).select("a", "b", *_r("r", digits=8))


@query("""WITH k AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS s, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS t, rank() OVER (ORDER BY p_partkey) AS p FROM part)
SELECT 'p_size' AS "column", round(corr(CAST(s AS DOUBLE), CAST(t AS DOUBLE)), 8) + 0.0 AS rho FROM k UNION ALL SELECT 'p_partkey', round(corr(CAST(p AS DOUBLE), CAST(t AS DOUBLE)), 8) + 0.0 FROM k""")
def spearman_rank(spark, sf):
    return selection.rank_correlation(read_table(spark, sf, "part"), ["p_size", "p_partkey"], "p_retailprice").select("column", *_r("rho", digits=8))


@query("WITH k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _COLS) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr(CAST({c} AS DOUBLE), CAST(l_extendedprice AS DOUBLE)), 8) + 0.0 AS rho FROM k" for c in _COLS if c != "l_extendedprice"))
def spearman_lineitem(spark, sf):
    return selection.rank_correlation(read_table(spark, sf, "lineitem"), [c for c in _COLS if c != "l_extendedprice"], "l_extendedprice").select("column", *_r("rho", digits=8))


_MI = ["l_quantity", "l_discount", "l_tax"]


@query("WITH q AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {k / 8}) AS {c}_{k}" for c in [*_MI, "l_extendedprice"] for k in range(1, 8)) + " FROM lineitem), x AS (SELECT " + ", ".join("CASE " + " ".join(f"WHEN {c} > {c}_{k} THEN {k}" for k in range(7, 0, -1)) + f" ELSE 0 END AS {c}" for c in [*_MI, "l_extendedprice"]) + " FROM lineitem, q), j AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x, l_extendedprice AS t, count(*) AS n FROM x GROUP BY ALL" for c in _MI)
    + """), p AS (SELECT "column", n, sum(n) OVER (PARTITION BY "column", x) AS nx, sum(n) OVER (PARTITION BY "column", t) AS nt, sum(n) OVER (PARTITION BY "column") AS s FROM j) SELECT "column", round(sum(n / s * ln(n * s / (nx * nt))), 8) + 0.0 AS mi FROM p GROUP BY 1""")
def mi_rank(spark, sf):
    return selection.mutual_information(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select("column", *_r("mi", digits=8))


@query("""SELECT "column", rho, row_number() OVER (ORDER BY abs(rho) DESC, "column") AS place FROM (WITH k AS (SELECT """ + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _COLS) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr(CAST({c} AS DOUBLE), CAST(l_extendedprice AS DOUBLE)), 8) + 0.0 AS rho FROM k" for c in _COLS if c != "l_extendedprice") + ") x ORDER BY place LIMIT 2")
def top_features(spark, sf):
    return selection.top(spearman_lineitem(spark, sf), "rho", 2)


def _pruned_sql() -> str:
    """Pruning in SQL: one step of the ordered pairwise comparison a subquery."""
    units = {"l_quantity": ["l_quantity"], "twice": ["twice"], "cycle": ["q_sin", "q_cos"], "l_discount": ["l_discount"], "l_tax": ["l_tax"]}
    names, cells = list(units), []
    for i, u in enumerate(names):
        cells.append("greatest(" + ", ".join(f"var_samp({c})" for c in units[u]) + f") AS v{i}, false AS g{i}")
        for j in range(i):
            cells.append("greatest(" + ", ".join(f"abs(corr({a}, {b}))" for a in units[u] for b in units[names[j]]) + f") AS r{i}_{j}")
    sql = "SELECT " + ", ".join(cells) + " FROM (SELECT *, l_quantity * 2 + l_tax * 1e-3 AS twice, sin(2 * pi() * l_quantity / 50) AS q_sin, cos(2 * pi() * l_quantity / 50) AS q_cos FROM lineitem) x"
    for i in range(len(names)):
        for j in range(i):
            hit = f"NOT g{i} AND NOT g{j} AND r{i}_{j} >= 0.95"
            sql = f"SELECT * REPLACE (g{i} OR ({hit} AND v{i} < v{j}) AS g{i}, g{j} OR ({hit} AND v{i} >= v{j}) AS g{j}) FROM ({sql}) x"
    return f"WITH k AS ({sql}) " + " UNION ALL ".join(f"SELECT '{u}' AS unit FROM k WHERE NOT g{i}" for i, u in enumerate(names))


@query(_pruned_sql())
def corr_pruned(spark, sf):
    s, c = C.sin_cos(F.col("l_quantity"), 50)
    li = read_table(spark, sf, "lineitem").select("*", (F.col("l_quantity") * 2 + F.col("l_tax") * 1e-3).alias("twice"), s.alias("q_sin"), c.alias("q_cos"))
    kept = selection.prune(li, {"l_quantity": ["l_quantity"], "twice": ["twice"], "cycle": ["q_sin", "q_cos"], "l_discount": ["l_discount"], "l_tax": ["l_tax"]})
    return spark.createDataFrame([(u,) for u in kept], "unit string")


def _vif_sql() -> str:
    """The diagonal of the inverse as minors over the determinant, written out."""
    cell = lambda a, b: "1.0" if a == b else f"r_{min(a, b)}_{max(a, b)}"

    def det(rows: list[int], cols: list[int]) -> str:
        if not rows:
            return "1.0"
        return "(" + " ".join(f"{'+' if k % 2 == 0 else '-'} {cell(rows[0], c)} * {det(rows[1:], cols[:k] + cols[k + 1:])}" for k, c in enumerate(cols)) + ")"

    every = list(range(len(_COLS)))
    corr = ", ".join(f"corr({_COLS[a]}, {_COLS[b]}) AS r_{a}_{b}" for a in every for b in every if a < b)
    rest = lambda k: [x for x in every if x != k]
    return f"WITH k AS (SELECT {corr} FROM lineitem) " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", round({det(rest(k), rest(k))} / {det(every, every)}, 8) AS vif FROM k""" for k, c in enumerate(_COLS))


@query(_vif_sql())
def vif(spark, sf):
    found = selection.variance_inflation(read_table(spark, sf, "lineitem"), _COLS)
    return spark.createDataFrame([(c, round(v, 8)) for c, v in found.items()], "column string, vif double")


@query()
def pca_k(spark, sf):
    vectors = read_table(spark, sf, "embeddings")
    sizes = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    n = usual.size if usual else 1  # vectors of another size than the commonest have no components
    element = lambda k: F.when(F.size("embedding") == n, F.get("embedding", F.lit(k)))
    return selection.components(vectors.select(*[element(k).alias(f"e{k}") for k in range(n)]), [f"e{k}" for k in range(n)])[0]


def _rates(spark, sf):
    turn = F.col("pos") * 37 + 20 * F.sin(F.col("pos") / 9)
    return D.index(spark, sf).select("pos", C.modulo(turn, 360).alias("angle"), (37 + 20 / 9 * F.cos(F.col("pos") / 9)).alias("reported"))


@query(""", p AS (SELECT pos, ((pos * 37 + 20 * sin(pos / 9.0)) % 360 + 360) % 360 AS a, 37 + 20 / 9.0 * cos(pos / 9.0) AS reported FROM idx), s AS (SELECT *, a - lag(a) OVER (ORDER BY pos) AS st FROM p), t AS (SELECT *, coalesce(CASE WHEN st > 180 THEN -ceil((st - 180) / 360) WHEN st < -180 THEN ceil((-st - 180) / 360) END, 0) AS turns FROM s),
u AS (SELECT *, a + 360 * sum(turns) OVER (ORDER BY pos) AS w FROM t), v AS (SELECT reported, (lead(w) OVER (ORDER BY pos) - lag(w) OVER (ORDER BY pos)) / 2 AS rate FROM u)
SELECT count(*) AS n, round(corr(rate, reported), 6) AS r, round(regr_slope(rate, reported), 5) AS slope, corr(rate, reported) >= 0.999 AS consistent FROM v WHERE rate IS NOT NULL""", shared=True)
def rate_consistency(spark, sf):
    return audit.rate_consistency(_rates(spark, sf), "angle", "reported", "pos").select("n", *_r("r", digits=6), *_r("slope", digits=5), "consistent")


def _cycles(spark, sf):
    """Sines and cosines of the size in two cycles beside a column that follows one of them."""
    pairs = {k: C.sin_cos(F.col("p_size"), k) for k in (50, 7)}
    cells = [c.alias(f"{n}{k}") for k, p in pairs.items() for n, c in zip(("s", "c"), p, strict=True)]
    return read_table(spark, sf, "part").select("*", *cells, (2 * C.sin_cos(F.col("p_size"), 50)[0] + 1).alias("follows"))


_CYCLES = "WITH k AS (SELECT *, " + ", ".join(f"{f}(2 * pi() * p_size / {k}) AS {f[0]}{k}" for k in (50, 7) for f in ("sin", "cos")) + ", 2 * sin(2 * pi() * p_size / 50) + 1 AS follows FROM part) "


@query(_CYCLES + "SELECT body, round(strength, 8) AS strength, strength < 0.95 AS survives FROM (" + " UNION ALL ".join(f"SELECT 'cycle_{k}' AS body, greatest(abs(corr(follows, s{k})), abs(corr(follows, c{k}))) AS strength FROM k" for k in (50, 7)) + ") x")
def prune_survival(spark, sf):
    found = audit.prune_survival(_cycles(spark, sf), "follows", {f"cycle_{k}": (f"s{k}", f"c{k}") for k in (50, 7)})
    return found.select("body", *_r("strength", digits=8), "survives")


@query(_CYCLES + "SELECT 's50' AS a, 'c50' AS b, round(max(abs(s50 - c50)), 8) AS max_difference, false AS duplicate FROM k UNION ALL SELECT 's50', 'half', round(max(abs(s50 - (follows - 1) / 2)), 8), true FROM k")
def duplicate_columns(spark, sf):
    rows = _cycles(spark, sf).withColumn("half", (F.col("follows") - 1) / 2)
    return audit.duplicates(rows, [("s50", "c50"), ("s50", "half")]).select("a", "b", *_r("max_difference", digits=8), "duplicate")


@query("SELECT verdict, count(*) AS n FROM (SELECT p_brand, p_type, CASE WHEN count(DISTINCT p_size) = 1 THEN 'determined' WHEN count(DISTINCT p_size) < 5 THEN 'few' ELSE 'free' END AS verdict FROM part GROUP BY 1, 2) x GROUP BY ROLLUP (verdict)")
def verdict_rollup(spark, sf):
    found = read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("item")).agg(F.count_distinct("p_size").alias("k"))
    return audit.verdicts(found.withColumn("verdict", F.when(F.col("k") == 1, "determined").when(F.col("k") < 5, "few").otherwise("free")))


# --- rolling and legacy operators ----------------------------------------------------------------------------------


@query(", w AS (SELECT pos, " + ", ".join(f"CASE WHEN count(c) OVER (ORDER BY pos ROWS {k - 1} PRECEDING) = {k} THEN round(avg(c) OVER (ORDER BY pos ROWS {k - 1} PRECEDING), 8) END AS mean_{k}, CASE WHEN count(c) OVER (ORDER BY pos ROWS {k - 1} PRECEDING) = {k} THEN round(stddev_samp(c) OVER (ORDER BY pos ROWS {k - 1} PRECEDING), 3) END AS std_{k}" for k in (5, 10, 20)) + " FROM hist) SELECT * FROM w", shared=True)
def rolling_stats(spark, sf):
    out = windows.rolling(sessions.positions(D.history(spark, sf)), "c", order="pos")
    return out.select("pos", *[c for k in (5, 10, 20) for c in (F.round(f"mean_{k}", 8).alias(f"mean_{k}"), F.round(f"std_{k}", 3).alias(f"std_{k}"))])


@query("SELECT pos, " + ", ".join(f"lag(c, {k}) OVER (ORDER BY pos) AS c_lag{k}" for k in (1, 2, 5, 10, 20)) + " FROM hist", shared=True)
def lags(spark, sf):
    return windows.lags(sessions.positions(D.history(spark, sf)), "c", order="pos").drop("d", "c")


@query(", w AS (SELECT pos, c, lag(c, 20) OVER (ORDER BY pos) AS c_lag20 FROM hist) SELECT pos, c, c_lag20 FROM w WHERE c_lag20 IS NOT NULL", shared=True)
def complete_lags(spark, sf):
    lagged = windows.lags(sessions.positions(D.history(spark, sf)), "c", [20], order="pos")
    return schema.complete_rows(lagged, ["c_lag20"]).select("pos", "c", "c_lag20")


@query("SELECT * FROM ((SELECT 'head' AS side, o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5) UNION ALL (SELECT 'tail', o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)) x")
def head_tail(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    order = ["o_orderdate", "o_orderkey"]
    return schema.head(orders, order, 5).select(F.lit("head").alias("side"), "*").unionByName(schema.tail(orders, order, 5).select(F.lit("tail").alias("side"), "*"))


@query("SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM part GROUP BY 1")
def sorted_sets(spark, sf):
    return schema.sorted_sets(read_table(spark, sf, "part"), ["p_type"], "p_brand").select("p_type", F.array_join("values", ",").alias("brands"))


@query("SELECT d, last_value(c IGNORE NULLS) OVER (ORDER BY d) AS c_filled FROM daily", shared=True)
def ffill(spark, sf):
    return windows.forward_fill(D.daily(spark, sf), "c").select("d", "c_filled")


@query(", p AS (SELECT pos, round(100 * (c - lag(c) OVER (ORDER BY pos)) / lag(c) OVER (ORDER BY pos), 4) AS pct, round(100 * (c - lag(c, 5) OVER (ORDER BY pos)) / lag(c, 5) OVER (ORDER BY pos), 4) AS roc FROM hist) SELECT pos, pct + 0.0 AS pct, roc + 0.0 AS roc, CASE WHEN count(pct) OVER (ORDER BY pos ROWS 4 PRECEDING) = 5 THEN round(avg(pct) OVER (ORDER BY pos ROWS 4 PRECEDING), 6) + 0.0 END AS pct_mean FROM p", shared=True)
def pct_change(spark, sf):
    out = windows.changes(sessions.positions(D.history(spark, sf)), "c", order="pos")
    return out.select("pos", (F.col("pct") + 0.0).alias("pct"), (F.col("roc") + 0.0).alias("roc"), (F.col("pct_mean") + 0.0).alias("pct_mean"))


@query("SELECT pos, CAST(coalesce(sign(c - lag(c) OVER (ORDER BY pos)), 0) AS TINYINT) AS direction FROM hist", shared=True)
def direction(spark, sf):
    hist = sessions.positions(D.history(spark, sf))
    return hist.withColumn("step", F.col("c") - F.lag("c").over(windows.along("pos"))).select("pos", windows.direction(F.col("step")).alias("direction"))


@query("SELECT d, CASE WHEN d < DATE '2001-01-01' THEN isodow(d) > 5 OR c IS NULL ELSE isodow(d) > 5 END AS is_holiday FROM daily", shared=True)
def holiday_flag(spark, sf):
    return windows.holiday_flag(D.daily(spark, sf), D.CUTOFF).select("d", "is_holiday")


# --- scoring -------------------------------------------------------------------------------------------------------


@query(", q AS (SELECT pos, r, sum(r) OVER (ORDER BY pos) AS e FROM steps), m AS (SELECT *, greatest(0, max(e) OVER (ORDER BY pos)) AS k FROM q) SELECT count(*) AS n, round(exp(sum(r)) - 1, 6) AS total_return, round(avg(r) * sqrt(252) / stddev_samp(r), 6) AS sharpe, round(min(exp(e - k) - 1), 6) AS max_drawdown FROM m", shared=True)
def baseline_scorecard(spark, sf):
    steps = windows.step_returns(sessions.positions(D.history(spark, sf)), order="pos")
    return score.scorecard(score.always_up(steps)).select("n", *_r("total_return", "sharpe", "max_drawdown", digits=6))


@query(_ORIG + """, v AS (SELECT fold, o.pos, s.r, CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY o.pos) = 1 THEN 0.0 ELSE 1.0 END AS p FROM o JOIN b ON o.i BETWEEN b.lo AND b.hi JOIN steps s ON s.pos = o.pos WHERE role = 'val'),
t AS (SELECT fold, pos, p * r - 0.001 * abs(p - coalesce(lag(p) OVER (PARTITION BY fold ORDER BY pos), 0)) AS net FROM v), q AS (SELECT *, sum(net) OVER (PARTITION BY fold ORDER BY pos) AS e FROM t), m AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY fold ORDER BY pos)) AS k FROM q)
SELECT fold, count(*) AS n, round(exp(sum(net)) - 1, 6) AS total_return, round(avg(net) * sqrt(252) / stddev_samp(net), 6) AS sharpe, round(min(exp(e - k) - 1), 6) AS max_drawdown FROM m GROUP BY fold""", shared=True)
def fold_scorecard(spark, sf):
    origins, f = _folds(spark, sf)
    val = folds.oos(folds.membership(origins, folds.bounds_table(spark, f)))
    steps = windows.step_returns(D.history(spark, sf)).select("d", "r")
    rows = score.flatten_at_boundaries(score.always_up(val.join(steps, "d")))
    return score.scorecard(rows, cost=0.001, group=["fold"]).select("fold", "n", *_r("total_return", "sharpe", "max_drawdown", digits=6))


@query(_LABELS + ", z AS (SELECT unnest(range(1, 11)) AS step, unnest([" + ", ".join(f"y_{k}" for k in range(1, 11)) + "]) AS y FROM labels), g AS (SELECT step, sqrt(avg(y * y)) AS rmse, stddev_pop(y) AS sd, avg(CAST(sign(y) = 0 AS INTEGER)) AS dir, sum(y * y) AS se FROM z GROUP BY 1) SELECT CAST(step AS INTEGER) AS step, round(rmse, 8) AS rmse, round(rmse / sd, 7) AS nrmse, round(dir, 8) AS direction, round(se / sum(se) OVER (), 8) AS share FROM g", shared=True)
def forecast_errors(spark, sf):
    truth = [f"y_{k}" for k in range(1, 11)]
    rows = _labels(spark, sf).select(*truth, *[F.lit(0.0).alias(f"f_{k}") for k in range(1, 11)])
    return score.errors(rows, truth, [f"f_{k}" for k in range(1, 11)]).select("step", *_r("rmse", digits=8), *_r("nrmse", digits=7), *_r("direction", "share", digits=8))


@query("""SELECT 'orders' AS series_id, pos AS time_idx, d AS trade_date, round(CAST(CAST(r AS FLOAT) AS DOUBLE), 6) + 0.0 AS log_ret, CAST(isodow(d) - 1 AS INTEGER) AS weekday FROM steps""", shared=True)
def long_frame(spark, sf):
    steps = windows.step_returns(sessions.positions(D.history(spark, sf)), order="pos")
    return steps.select(F.lit("orders").alias("series_id"), F.col("pos").alias("time_idx"), F.col("d").alias("trade_date"), (F.round(F.col("r").cast("float").cast("double"), 6) + 0.0).alias("log_ret"), C.weekday_index(F.col("d")).alias("weekday"))


@query(_ORIG + " SELECT fold, round(avg(s.r), 9) + 0.0 AS mean, round(stddev_samp(s.r), 9) AS std, count(*) AS n FROM o JOIN b ON o.i BETWEEN b.lo AND b.hi JOIN steps s ON s.pos = o.pos WHERE role = 'val' GROUP BY fold", shared=True)
def fold_spread(spark, sf):
    origins, f = _folds(spark, sf)
    val = folds.oos(folds.membership(origins, folds.bounds_table(spark, f)))
    rows = val.join(windows.step_returns(D.history(spark, sf)).select("d", "r"), "d")
    return score.per_fold(rows, "r").select("fold", *_r("mean", "std"), "n")


# --- extensions beyond parity --------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return events.windowed_counts(read_table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return events.sessions(read_table(spark, sf, "events"))


@query("SELECT n_regionkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY CUBE (n_regionkey, o_orderstatus)")
def order_cube(spark, sf):
    t = lambda n: read_table(spark, sf, n)
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.cube("n_regionkey", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


from . import audits, learned, ordered, records  # noqa: E402, F401  they register their queries here
