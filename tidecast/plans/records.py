"""Queries of declared contracts over whole tables: a CSV under its schema, roles and types of columns, sessions looked up, replaced angles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import circular as C
from ..operators import schema, selection, sessions
from ..sources.io import read_csv, read_table
from ..sources.scratch import Saved
from . import daily as D
from .catalogue import query


@query("SELECT o_orderkey, o_orderstatus, o_orderdate AS d, o_totalprice FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders) x")
def orders_from_csv(spark, sf):
    """All orders written as CSV and read back under a declared schema, dates parsed by their declared format."""
    folder = Saved(spark, "csv")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("d"), "o_totalprice")
    path = f"{folder.root}/orders"
    orders.write.option("header", True).option("dateFormat", "dd/MM/yyyy").csv(path)
    return read_csv(spark, path, orders.schema, date_format="dd/MM/yyyy")


_DROPPED, _CONSTANT = ("l_tax", "l_discount"), ("shard", "unit")


@query("""SELECT column_name AS "column", CASE column_name WHEN 'l_orderkey' THEN 'key' WHEN 'l_extendedprice' THEN 'target_source' WHEN 'l_tax' THEN 'dropped_price' WHEN 'l_discount' THEN 'dropped_price' WHEN 'shard' THEN 'dropped_constant' WHEN 'unit' THEN 'dropped_constant' ELSE 'feature' END AS role,
CASE WHEN column_name = 'late' THEN 'boolean' WHEN column_name IN ('l_returnflag', 'l_linestatus', 'unit') THEN 'categorical' WHEN column_name = 'l_angle' THEN 'angular' ELSE 'linear_numeric' END AS type,
(SELECT count(*) FROM lineitem) AS n, CASE WHEN column_name = 'l_angle' THEN (SELECT count(*) FROM lineitem WHERE l_quantity > 40) ELSE 0 END AS nulls
FROM (VALUES ('l_orderkey'), ('l_linenumber'), ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('l_returnflag'), ('l_linestatus'), ('late'), ('l_angle'), ('shard'), ('unit')) t(column_name)""")
def column_roles(spark, sf):
    """Role, type, rows and nulls of every column; constants are found in the data, and the roles cover all columns once."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).alias("late"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity") * 7.2).alias("l_angle"), F.lit(1).alias("shard"), F.lit("piece").alias("unit"))
    constants = [r["column"] for r in schema.constant_columns(li).collect()]  # a row a constant column
    by_role = schema.roles(li.columns, "l_orderkey", "l_extendedprice", _DROPPED, constants)
    by_type = schema.types(li.schema, {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"], "unit": ["piece"]}, "_angle$")
    return schema.coverage(li, by_role, by_type)


@query(", o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, o.d, idx.pos, idx.pos IS NOT NULL AS is_session FROM o LEFT JOIN idx ON idx.d = o.d", shared=True)
def order_positions(spark, sf):
    """The session position of every order's day, and whether the day is a session."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return sessions.lookup(orders, D.index(spark, sf))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(sin(2 * pi() * (month(l_shipdate) - 1) / 12), 9) + 0.0 AS ship_sin, round(cos(2 * pi() * (month(l_shipdate) - 1) / 12), 9) + 0.0 AS ship_cos,
round(sin(2 * pi() * (isodow(l_shipdate) - 1) / 7), 9) + 0.0 AS day_sin, round(cos(2 * pi() * (isodow(l_shipdate) - 1) / 7), 9) + 0.0 AS day_cos FROM lineitem""")
def replaced_angles(spark, sf):
    """Shipping dates replaced by their cyclic pairs in one projection; the consumed column goes, and each pair stays one unit."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    pairs = {"ship": C.sin_cos(F.month("l_shipdate") - 1, 12), "day": C.sin_cos(C.weekday_index(F.col("l_shipdate")), 7)}
    cells = {f"{stem}_{part}": F.round(x, 9) + 0.0 for stem, pair in pairs.items() for part, x in zip(("sin", "cos"), pair, strict=True)}
    out = schema.apply(li, cells, drop=["l_shipdate"])
    units = selection.pair_units(out.columns)
    return out.select(*[c for unit in units.values() for c in unit])
