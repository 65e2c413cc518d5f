"""Window operators over one long series: rows are dealt into ranges of the order, and each range is a task.

A sample of the order gives cut points, which change how even the ranges are and nothing else. What a range needs from the
others is small: for running values one carry (how many rows lie before, their sum, extreme or last value), for windows of
k rows the k rows on either side (a halo, which reaches across ranges that are shorter than k or empty). Both come from
a row a range, joined with the ranges after it, so nothing passes through one task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Saved

#: Ranges at least and at most, rows of a range between them, and order values that are sampled for each.
RANGES, MOST, ROWS, SAMPLED = 64, 4096, 1_000_000, 64


def cut_points(df: DataFrame, order: Sequence[str], ranges: int | None = None, sampled: int = SAMPLED) -> list:
    """At most ranges - 1 ascending values of the order, as rows: about `sampled` rows a range are drawn (twice that at most, so
    524,288 rows of the order reach the driver at MOST ranges). Rows are drawn, not values, as a few values may hold all rows.
    Without `ranges` their number follows that of the rows."""
    n = df.count()
    ranges = ranges or max(RANGES, min(MOST, n // ROWS))
    drawn = df.select(*order).sample(fraction=min(1.0, sampled * ranges / max(1, n)), seed=1)
    rows = drawn.orderBy(*order).limit(2 * sampled * ranges).collect()
    at = sorted({len(rows) * k // ranges for k in range(1, ranges)} - {0})
    return list(dict.fromkeys(rows[k] for k in at))


def _cells(order: Sequence[str], cuts: list, schema: T.StructType) -> Column:
    """An array of cut points, with nullable fields as in the table, or each comparison would cast its struct."""
    kind = T.StructType([T.StructField(c, schema[c].dataType) for c in order])
    return F.array(*[F.struct(*[F.lit(v).cast(schema[c].dataType).alias(c) for c, v in zip(order, row, strict=True)]) for row in cuts]).cast(T.ArrayType(kind))


def range_of(order: Sequence[str], cuts: list, schema: T.StructType) -> Column:
    """How many cut points the row's order reaches: coarse cuts first, then the fine ones between two of them."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    mine = F.struct(*[F.col(c).alias(c) for c in order])
    reached = lambda block: F.size(F.filter(block, lambda x: x <= mine))
    coarse = reached(_cells(order, [b[0] for b in blocks], schema))
    fine = F.element_at(F.array(*[_cells(order, b, schema) for b in blocks]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + reached(fine)).cast("int")


def _image(c: Column, kind: T.DataType) -> Column | None:
    """A finite double that never falls as the column rises, null lowest and NaN highest; None for kinds without one."""
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):  # whole seconds: a cast would go through the session's time zone, whose clock turns back
        c = F.unix_date(F.to_date(c)) * F.lit(86400.0) + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))
    elif not isinstance(kind, T.NumericType):
        return None
    most = F.lit(sys.float_info.max)
    return F.greatest(-most, F.least(most, F.coalesce(F.nanvl(c.cast("double"), most), -most))) + F.lit(0.0)


def dealt(df: DataFrame, order: Sequence[str], ranges: int | None = None, cuts: list | None = None) -> DataFrame:
    """df with _range; nulls come first, as in an ascending sort.

    The first column's image is searched among those of the cuts, and only rows that tie with a cut there compare whole orders.
    Where the first column can't tell most cuts apart, all rows do.
    """
    order = list(order)
    cuts = cut_points(df, order, ranges) if cuts is None else cuts
    kind = df.schema[order[0]].dataType
    if not cuts or _image(F.col(order[0]), kind) is None:
        return df.withColumn("_range", range_of(order, cuts, df.schema))
    firsts = list(dict.fromkeys(r[0] for r in cuts))
    values = df.sparkSession.createDataFrame([(v,) for v in firsts], T.StructType([T.StructField("v", kind)]))
    images = [r[0] for r in values.select(_image(F.col("v"), kind)).collect()]
    at, groups = dict(zip(firsts, images, strict=True)), {}
    for r in cuts:
        groups.setdefault(at[r[0]], []).append(r)
    if max(map(len, groups.values())) > 2 * len(cuts) ** 0.5:
        return df.withColumn("_range", range_of(order, cuts, df.schema))
    splits, before = list(groups), [0]
    for g in groups.values():
        before.append(before[-1] + len(g))
    found = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="_image", outputCol="_found").transform(df.withColumn("_image", _image(F.col(order[0]), kind)))
    pick = lambda values, k: F.element_at(F.array(*values), k)
    k = F.col("_found").cast("int")
    mine = F.struct(*[F.col(c).alias(c) for c in order])
    tied = pick([_cells(order, g, df.schema) for g in groups.values()], k)
    below, upto = pick(map(F.lit, before[:-1]), k), pick(map(F.lit, before), k + 1)
    ties = (k > 0) & (pick(map(F.lit, splits), F.greatest(k, F.lit(1))) == F.col("_image"))
    return found.select(*df.columns, F.when(ties, below + F.size(F.filter(tied, lambda x: x <= mine))).otherwise(upto).cast("int").alias("_range"))


def _later(summary: DataFrame, by: Sequence[str], last: int, backwards: bool = False) -> DataFrame:
    """Each range's row, once for every range after it (before it): ranges squared rows a series at most."""
    others = F.sequence(F.lit(0), F.col("_range") - 1) if backwards else F.sequence(F.col("_range") + 1, F.lit(last))
    keep = F.col("_range") > 0 if backwards else F.col("_range") < last
    return summary.where(keep).withColumn("_from", F.col("_range")).withColumn("_range", F.explode(others))


def running(df: DataFrame, order: Sequence[str], values: Mapping[str, tuple[str, str]], partition_by: Sequence[str] = (), ranges: int | None = None, cuts: list | None = None) -> DataFrame:
    """df with running columns along the order, whose columns must break every tie: {name: (kind, column)}.

    Kinds: count (rows up to and with this one; any column), sum, min and max (nulls left out), last (the last value that isn't
    null), next (the first value at or after the row that isn't null), ahead_min (the least value at or after the row).
    """
    by, order = list(partition_by), list(order)
    cuts = cut_points(df, order, ranges) if cuts is None else cuts
    rows, last = dealt(df, order, cuts=cuts), len(cuts)
    at = F.struct(*order)
    upto = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is looking back in the other direction, which costs one step a row
    ahead = Window.partitionBy(*by, "_range").orderBy(*[F.col(c).desc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    least = lambda a, b: F.least(a, b)
    kinds = {  # inside the range, summary of a range, summary of summaries, both together; whether it looks back
        "count": (lambda c: F.count("*").over(upto), lambda c: F.count("*"), lambda s: F.sum(s), lambda x, y: F.coalesce(y, F.lit(0)) + x, False),
        "sum": (lambda c: F.sum(c).over(upto), lambda c: F.sum(c), lambda s: F.sum(s), lambda x, y: F.coalesce(x + y, x, y), False),
        "min": (lambda c: F.min(c).over(upto), lambda c: F.min(c), lambda s: F.min(s), least, False),
        "max": (lambda c: F.max(c).over(upto), lambda c: F.max(c), lambda s: F.max(s), lambda x, y: F.greatest(x, y), False),
        "last": (lambda c: F.last(c, True).over(upto), lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)), lambda s: F.max_by(s, F.when(F.col(s).isNotNull(), F.col("_from"))), lambda x, y: F.coalesce(x, y), False),
        "next": (lambda c: F.last(c, True).over(ahead), lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)), lambda s: F.min_by(s, F.when(F.col(s).isNotNull(), F.col("_from"))), lambda x, y: F.coalesce(x, y), True),
        "ahead_min": (lambda c: F.min(c).over(ahead), lambda c: F.min(c), lambda s: F.min(s), least, True),
    }
    out = rows.select("*", *[kinds[k][0](c).alias(f"_in_{n}") for n, (k, c) in values.items()])
    summary = rows.groupBy(*by, "_range").agg(*[kinds[k][1](c).alias(f"_s_{n}") for n, (k, c) in values.items()])
    for back in (False, True):
        mine = {n: k for n, (k, _) in values.items() if kinds[k][4] == back}
        if mine:
            carry = _later(summary, by, last, back).groupBy(*by, "_range").agg(*[kinds[k][2](f"_s_{n}").alias(f"_c_{n}") for n, k in mine.items()])
            # plain equality on _range, which is never null: rows stay where the windows put them
            keys = [*[F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in by], F.col("_l._range") == F.col("_r._range")]
            both = out.alias("_l").join(carry.alias("_r"), keys, "left")
            out = both.select("_l.*", *[f"_r._c_{n}" for n in mine])
    return out.select(*df.columns, *[kinds[k][3](F.col(f"_in_{n}"), F.col(f"_c_{n}")).alias(n) for n, (k, _) in values.items()])


def with_halo(df: DataFrame, order: Sequence[str], before: int, after: int = 0, partition_by: Sequence[str] = (), ranges: int | None = None, cuts: list | None = None) -> DataFrame:
    """df's rows with _range and _own, and for each range the `before` rows in front of it and the `after` rows behind it as rows
    that aren't its own. Windows over (partition_by, _range) of such reach are then whole; keep _own rows afterwards.

    The edge rows of a range are at most before + after, picked before the shuffle; by their place in the whole series each
    goes to every range whose halo holds it, so short and empty ranges pass them on.
    """
    by, order = list(partition_by), list(order)
    cuts = cut_points(df, order, ranges) if cuts is None else cuts
    rows, last = dealt(df, order, cuts=cuts), len(cuts)
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    every = counts.select(*by).distinct().withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(last))))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    ahead = _later(counts, by, last).groupBy(*by, "_range").agg(F.sum("_n").alias("_start"))
    spans = every.alias("e").join(counts.alias("n"), same("e", "n", [*by, "_range"]), "left").select("e.*", F.coalesce("n._n", F.lit(0)).alias("_n"))
    spans = spans.alias("e").join(ahead.alias("a"), same("e", "a", [*by, "_range"]), "left").select("e.*", F.coalesce("a._start", F.lit(0)).alias("_start"))
    out = rows.withColumn("_own", F.lit(True))
    for reach, forward in ((before, True), (after, False)):
        if reach:
            way = [F.col(c).desc_nulls_last() for c in order] if forward else [F.col(c).asc_nulls_first() for c in order]
            edge = rows.withColumn("_halo_edge", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*way))).where(F.col("_halo_edge") <= reach)
            edge = edge.alias("r").join(spans.alias("s"), same("r", "s", [*by, "_range"])).select("r.*", (F.col("s._start") + (F.col("s._n") - F.col("_halo_edge") if forward else F.col("_halo_edge") - 1)).alias("_halo_place"))
            to = spans.select(*[F.col(c).alias(f"_to_{c}") for c in by], F.col("_range").alias("_to"), F.col("_start").alias("_lo"), (F.col("_start") + F.col("_n")).alias("_hi"))
            moved = _later(edge, by, last, not forward)
            inside = (F.col("_halo_place") >= F.col("_lo") - reach) if forward else (F.col("_halo_place") < F.col("_hi") + reach)
            keys = [F.col(c).eqNullSafe(F.col(f"_to_{c}")) for c in by] + [F.col("_range") == F.col("_to"), inside]
            out = out.unionByName(moved.join(to, keys).select(*df.columns, "_range", F.lit(False).alias("_own")))
    return out


def over_halo(df: DataFrame, order: Sequence[str], columns: Mapping[str, object], before: int, after: int = 0, partition_by: Sequence[str] = (), ranges: int | None = None, cuts: list | None = None) -> DataFrame:
    """df with window columns: {name: function of a window along the order that gives a column}; none may reach over before / after."""
    w = Window.partitionBy(*partition_by, "_range").orderBy(*order)
    out = with_halo(df, order, before, after, partition_by, ranges, cuts).select("*", *[f(w).alias(n) for n, f in columns.items()])
    return out.where("_own").select(*df.columns, *columns)


def runs(df: DataFrame, order: Sequence[str], flag: str, partition_by: Sequence[str] = (), ranges: int | None = None, cuts: list | None = None, saved: Saved | None = None) -> DataFrame:
    """df with run_start and run_rows: place (from 0) of the first row of the unbroken run of equal flags that the row is in, and the
    run's length. A run may cover many ranges.

    Rows are dealt and saved once. A range is then one row: how many rows it has, its first and last flag, and its first and
    last break inside. From those come each range's start, whether its first row breaks the run before it, and the nearest
    breaks on either side; a second pass over the saved rows puts both together.
    """
    by, order, own = list(partition_by), list(order), saved or Saved(df.sparkSession, "runs")
    cuts = cut_points(df, order, ranges) if cuts is None else cuts
    w = Window.partitionBy(*by, "_range").orderBy(*order)
    now = F.struct(F.col(flag).alias("flag"))  # a struct tells a null flag from no row
    base = own.save(dealt(df, order, cuts=cuts).select("*", F.row_number().over(w).alias("_rn"), (~now.eqNullSafe(F.lag(now).over(w))).alias("_breaks")))
    inner = F.when((F.col("_rn") > 1) & F.col("_breaks"), F.col("_rn"))
    summary = own.save(base.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min_by(now, "_rn").alias("_first"), F.max_by(now, "_rn").alias("_last"), F.min(inner).alias("_lo"), F.max(inner).alias("_hi")))
    keys = [*by, "_range"]
    joined = lambda a, b: a.alias("l").join(b.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys], "left").select("l.*", *[F.col(f"r.{c}") for c in b.columns if c not in keys])
    past = _later(summary, by, len(cuts)).groupBy(*keys).agg(F.sum("_n").alias("_start"), F.max_by("_last", "_from").alias("_before"))
    placed = joined(summary, past).withColumn("_start", F.coalesce("_start", F.lit(0))).withColumn("_new", ~F.col("_first").eqNullSafe(F.col("_before")))
    at = lambda c: F.col("_start") + F.col(c) - 1
    placed = own.save(placed.select(*keys, "_start", "_new", "_n", F.when(F.col("_new"), F.col("_start")).otherwise(at("_lo")).alias("_least"), F.coalesce(at("_hi"), F.when(F.col("_new"), F.col("_start"))).alias("_most")))
    back = _later(placed, by, len(cuts)).groupBy(*keys).agg(F.max("_most").alias("_back"))
    on = _later(placed, by, len(cuts), backwards=True).groupBy(*keys).agg(F.min("_least").alias("_on"), F.max(F.col("_start") + F.col("_n")).alias("_end"))
    carry = joined(joined(placed.select(*keys, "_start", "_new", (F.col("_start") + F.col("_n")).alias("_own_end")), back), on)
    rows = joined(base, carry).withColumn("_break", F.when(F.when(F.col("_rn") == 1, F.col("_new")).otherwise(F.col("_breaks")), F.col("_start") + F.col("_rn") - 1))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*by, "_range").orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start, end = F.coalesce(F.max("_break").over(upto), F.col("_back")), F.coalesce(F.min("_break").over(behind), F.col("_on"), F.col("_end"), F.col("_own_end"))
    return rows.select(*df.columns, start.alias("run_start"), (end - start).alias("run_rows"))


def asof_forward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, value: str, partition_by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """left with the value of the first right row at or after it (of several right rows at one place, of the least value), null where
    there is none; both sides large. They meet in common ranges; where a range has no right row left, the next range that has
    one gives its first. A null place has no right row."""
    by = list(partition_by)
    tagged = left.select("*", F.col(left_on).alias("_at"), F.rand(71).alias("_tie"), F.lit(0).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    # one right row a place (and another seed than the sample, else only small ties are drawn); left rows of one place are dealt over as many ranges as they fill, the right row is in the last of them
    least = F.min(F.struct(F.col(value).isNull().alias("_none"), F.col(value).alias("_value"))).alias("_least")
    places = right.where(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_at")).agg(least)
    fill = [F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    both = tagged.unionByName(places.select(*fill, "_at", F.lit(1.0).alias("_tie"), F.lit(1).alias("_side"), "_least._value"))
    cuts = cut_points(both.select("_at", "_tie"), ["_at", "_tie"], ranges)
    rows = dealt(both, ["_at", "_tie"], cuts=cuts)
    ahead = Window.partitionBy(*by, "_range").orderBy(F.col("_at").desc_nulls_last(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # backwards, right rows of a place come before left ones; what counts is the nearest place, then the least value
    near = F.min(F.when(F.col("_side") == 1, F.struct("_at", F.col("_value").isNull().alias("_none"), "_value"))).over(ahead)
    inside = rows.withColumn("_near", near)
    firsts = rows.where("_side = 1").groupBy(*by, "_range").agg(F.min(F.struct("_at", F.col("_value").isNull().alias("_none"), "_value")).alias("_first"))
    carry = _later(firsts, by, len(cuts), backwards=True).groupBy(*by, "_range").agg(F.min("_first").alias("_next"))
    keys = [*[F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], F.col("l._range") == F.col("r._range")]
    out = inside.where("_side = 0").alias("l").join(carry.alias("r"), keys, "left")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_near", "_next"))
    names = [c for c in left.columns if c != value]
    return out.select(*[F.col(f"l.{c}") for c in names], found["_value"].alias(value))
