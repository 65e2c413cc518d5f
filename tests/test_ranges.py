"""Scans, halos, runs and as-of joins over dealt ranges against plain Python, with short and empty ranges, ties and nulls."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidecast.operators import ranges as R


def series(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(30)]), k, rng.choice([None, 1, 2, 3]), rng.random() < 0.8, "ab"[k % 2]) for k in range(n)]
    df = spark.createDataFrame(rows, "t int, k int, v int, up boolean, g string").repartition(4)
    return df, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("ranges", [1, 150])
def test_running_values_equal_a_plain_scan(spark, ranges):
    df, rows = series(spark)
    kinds = {"pos": ("count", "k"), "total": ("sum", "v"), "least": ("min", "v"), "most": ("max", "k"), "filled": ("last", "v"), "back": ("next", "v"), "low": ("ahead_min", "k")}
    got = {r.k: r for r in R.running(df, ["t", "k"], kinds, ranges=ranges).collect()}
    total, least, most, filled = None, None, -1, None
    for i, (_, k, v, _, _) in enumerate(rows):
        total, least = (total or 0) + v if v is not None else total, v if least is None else min(least, v) if v is not None else least
        most, filled = max(most, k), v if v is not None else filled
        back = next((r[2] for r in rows[i:] if r[2] is not None), None)
        r = got[k]
        assert (r.pos, r.total, r.least, r.most, r.filled, r.back, r.low) == (i + 1, total, least, most, filled, back, min(x[1] for x in rows[i:]))
    panel = {r.k: r.pos for r in R.running(df, ["t", "k"], {"pos": ("count", "k")}, ["g"], ranges=ranges).collect()}
    assert all(panel[k] == sum(1 for x in rows[: i + 1] if x[4] == g) for i, (_, k, _, _, g) in enumerate(rows))


@pytest.mark.parametrize(("by", "ranges"), [([], 200), (["g"], 60)])
def test_windows_over_halos_reach_across_short_and_empty_ranges(spark, by, ranges):
    """With 200 ranges over 400 rows, a window of 13 rows and a lead of 9 pass many of them; a panel leaves ranges empty."""
    df, rows = series(spark)
    columns = {"lag7": lambda w: F.lag("k", 7).over(w), "lead9": lambda w: F.lead("k", 9).over(w), "mean": lambda w: F.avg("k").over(w.rowsBetween(-12, 0)), "n": lambda w: F.count("v").over(w.rowsBetween(-3, 9))}
    got = {r.k: r for r in R.over_halo(df, ["t", "k"], columns, 12, 9, by, ranges=ranges).collect()}
    assert len(got) == len(rows)
    for g in "ab" if by else [None]:
        own = [r for r in rows if g in (None, r[4])]
        for i, row in enumerate(own):
            r, back = got[row[1]], own[max(0, i - 12) : i + 1]
            assert r.lag7 == (own[i - 7][1] if i >= 7 else None) and r.lead9 == (own[i + 9][1] if i + 9 < len(own) else None)
            assert math.isclose(r.mean, sum(x[1] for x in back) / len(back)) and r.n == sum(x[2] is not None for x in own[max(0, i - 3) : i + 10])


@pytest.mark.parametrize(("by", "share"), [([], 0.97), (["g"], 0.5), ([], 1.0)])
def test_runs_cross_ranges(spark, by, share):
    rng = random.Random(7)
    rows = [(k, rng.choice([True, None] if k % 3 == 0 else [True]) if rng.random() < share else False, "ab"[rng.randrange(2)]) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, up boolean, g string").repartition(4)
    got = {r.k: (r.run_start, r.run_rows) for r in R.runs(df, ["k"], "up", by, ranges=40).collect()}
    for g in "ab" if by else [None]:
        own, i = [r for r in rows if g in (None, r[2])], 0
        while i < len(own):
            j = i
            while j < len(own) and own[j][1] == own[i][1]:
                j += 1
            assert all(got[own[x][0]] == (i, j - i) for x in range(i, j))
            i = j


@pytest.mark.parametrize(("by", "ranges"), [([], 90), (["g"], 20)])
def test_asof_takes_the_next_range_that_has_a_row(spark, by, ranges):
    rng = random.Random(3)
    left = [(rng.choice([None, *range(1000)]), k, "ab"[k % 2]) for k in range(300)]
    right = [(rng.choice([None, *range(100, 900, 40)]), rng.choice([None, *range(9)]), "ab"[rng.randrange(2)]) for _ in range(30)]
    df = R.asof_forward(spark.createDataFrame(left, "t int, k int, g string"), spark.createDataFrame(right, "u int, v int, g string"), "t", "u", "v", by, ranges)
    got = {r.k: r.v for r in df.collect()}
    for t, k, g in left:
        ahead = [(u, v is None, v) for u, v, h in right if u is not None and t is not None and u >= t and (not by or g == h)]
        assert got[k] == (min(ahead, key=lambda x: (x[0], x[1], x[2] or 0))[2] if ahead else None)


def test_cut_points_follow_a_skewed_order(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("t"), "id")
    counts = [r["count"] for r in R.dealt(df, ["t", "id"], 16).groupBy("_range").count().collect()]
    assert len(counts) == 16 and max(counts) < 2.5 * 20_000 / 16  # a third of all rows shares its first value
    assert R.dealt(df.limit(0), ["t", "id"]).count() == 0 == R.running(df.limit(0), ["t", "id"], {"n": ("count", "id")}).count()


def test_cut_points_of_few_values_and_a_hot_place_spread_an_asof_join(spark, monkeypatch):
    """Three days hold all rows, and one of them nearly all: no task may get more than a few ranges' share."""
    df = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 3).otherwise(1).cast("int").alias("t"), "id")
    assert len(R.cut_points(df.select("t"), ["t"], 16)) >= 1
    seen = []
    monkeypatch.setattr(R, "dealt", lambda *a, f=R.dealt, **k: seen.append(f(*a, **k)) or seen[-1])
    right = spark.createDataFrame([(1, 7), (1, 5), (2, None), (2, 9)] * 500, "u int, v int")
    got = R.asof_forward(df, right, "t", "u", "v", ranges=16).groupBy("t", "v").count().collect()
    assert sorted((r.t, r.v) for r in got) == [(0, 5), (1, 5), (2, 9)] and sum(r["count"] for r in got) == 20_000
    counts = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(counts) >= 14 and max(counts) < 2.5 * 20_000 / 16


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "float", "decimal(12,2)", "date", "timestamp", "timestamp_ntz", "string"])
def test_ranges_of_any_first_column_follow_the_order(spark, kind):
    """Nulls, NaN, infinities, signed zeros and values whose doubles are equal; every row's range is the number of cuts up to it."""
    rng = random.Random(5)
    odd = {"double": ["NaN", "Infinity", "-Infinity", "-0.0", "0.0"], "float": ["NaN", "-Infinity", "0.0"], "bigint": [str(2**53 + k) for k in range(4)]}.get(kind, [])
    moment = lambda: f"20{rng.randrange(10, 13)}-03-31 02:30:00.00000{rng.randrange(9)}"
    plain = {"date": lambda: f"20{rng.randrange(10, 40)}-03-31", "timestamp": moment, "timestamp_ntz": moment}.get(kind, lambda: str(rng.randrange(40)))
    rows = [(rng.choice([None, *odd, *[plain() for _ in range(9)]]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "s string, k int").select(F.col("s").cast(kind).alias("t"), "k").repartition(3)
    cuts = R.cut_points(df, ["t", "k"], 24)
    assert len(cuts) == 23
    got = R.dealt(df, ["t", "k"], cuts=cuts)
    assert got.columns == ["t", "k", "_range"]
    assert kind not in ("int", "date") or "bucketizer" in got._jdf.queryExecution().toString()  # not an array walked by every row
    ordered = [r._range for r in got.orderBy("t", "k").collect()]
    assert ordered == sorted(ordered) and len(set(ordered)) == 24
    assert got.exceptAll(df.withColumn("_range", R.range_of(["t", "k"], cuts, df.schema))).count() == 0


def test_plans_have_no_single_task(spark, capsys):
    df, _ = series(spark)
    frames = [R.running(df, ["t", "k"], {"n": ("count", "k"), "m": ("ahead_min", "k")}, ranges=8), R.over_halo(df, ["t", "k"], {"p": lambda w: F.lag("k").over(w)}, 1, ranges=8), R.asof_forward(df.select("t", "k"), df.select(F.col("t").alias("u"), "v"), "t", "u", "v", ranges=8)]
    for f in frames:
        f.explain()
        assert "SinglePartition" not in capsys.readouterr().out
