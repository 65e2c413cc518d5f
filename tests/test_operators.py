"""Unit, trap and property tests of the operators on hand-made frames, with expected values from NumPy or plain Python."""

from __future__ import annotations

import datetime as dt
import math
import pickle
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.functions import circular as C
from tidecast.operators import audit, encoding, folds, schema, score, selection, sessions, windows
from tidecast.sources import io


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture
def closes(spark):
    values = [10.0, 11.0, None, 12.5, 12.0, 13.0, None, 14.0, 13.5, 15.0, 16.0, 15.5]
    rows = [(day(k), v) for k, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "d date, c double")


def test_modulo_is_floored(spark):
    r = one(spark, C.modulo(F.lit(-30.0), 360).alias("m"), C.signed_separation(F.lit(350.0), F.lit(10.0)).alias("s"), C.circular_distance(F.lit(359.0), F.lit(1.0)).alias("d"), C.folded_elongation(F.lit(-190.0)).alias("f"))
    assert (r.m, r.s, r.d, r.f) == (330.0, 20.0, 2.0, 170.0)


def test_unit_circle_holds_everywhere(spark):
    df = spark.createDataFrame([(float(x),) for x in np.random.RandomState(2).uniform(-1e4, 1e4, 300)], "x double")
    s, c = C.sin_cos(F.col("x"), 17, 3)
    assert df.where(C.off_unit_circle(s, c)).count() == 0


def test_unknown_levels_raise(spark):
    with pytest.raises(Exception, match="undeclared level"):
        spark.createDataFrame([("Mon",), ("Foo",)], "x string").select(C.level_index(F.col("x"), C.MONDAY_FIRST)).collect()
    with pytest.raises(Exception, match="no entry"):
        spark.createDataFrame([("a",)], "x string").select(C.lookup(F.col("x"), {"b": 1.0})).collect()


def test_two_weekday_orders(spark):
    assert one(spark, C.weekday_index(F.lit(dt.date(2024, 1, 7))).alias("w")).w == 6  # a Sunday


def test_returns_ignore_row_order_and_forward_nulls(spark, closes):
    got = [r.r for r in windows.step_returns(sessions.observed(closes)).orderBy("d").collect()]
    seen = [10.0, 11.0, 12.5, 12.0, 13.0, 14.0, 13.5, 15.0, 16.0, 15.5]
    assert np.allclose(got, np.diff(np.log(seen)))


def test_lead_matrix_and_cumulative(spark, closes):
    hist = sessions.positions(windows.step_returns(sessions.observed(closes)))
    m = windows.cumulative(windows.lead_matrix(hist, "r", 3), 3).orderBy("pos").toPandas()
    r = m.r.to_numpy()
    assert np.allclose(m.y_2[:-2], r[2:]) and math.isnan(m.y_3.iloc[-1]) and np.allclose(m.cum_3[:-3], [r[i + 1 : i + 4].sum() for i in range(len(r) - 3)])


def test_partitioned_windows_equal_runs_of_each_series(spark, closes):
    both = closes.withColumn("s", F.lit("a")).unionByName(closes.withColumn("s", F.lit("b")).withColumn("c", F.col("c") * 2))
    rolled = windows.rolling(sessions.observed(both), "c", (3,), partition_by=("s",))
    alone = windows.rolling(sessions.observed(closes), "c", (3,)).orderBy("d").toPandas()
    assert np.allclose(rolled.where("s = 'b'").orderBy("d").toPandas().mean_3.dropna(), 2 * alone.mean_3.dropna()) and alone.mean_3.isna().sum() == 2


def test_asof_forward(spark):
    s = spark.createDataFrame([(0, day(0)), (1, day(3)), (2, day(7))], "pos long, d date")
    g = spark.createDataFrame([(day(k),) for k in (0, 1, 3, 7, 8)], "d date")
    assert [r.pos for r in sessions.asof_forward(g, s, "d", "d", "pos").orderBy("d").collect()] == [0, 1, 1, 2, None]
    assert {r.pos for r in sessions.discontinuities(g, s).collect()} == {1, 2}


def test_runs(spark):
    start = dt.date(2024, 1, 1)  # a Monday
    shut = {2, 3, 4, 7, 15, 16, 17, 18, 21}
    rows = [(start + dt.timedelta(days=k), None if k in shut else 1.0) for k in range(22)]
    got = sessions.closed_runs(spark.createDataFrame(rows, "d date, c double"), 4).toPandas()
    assert sorted(got.groupby("run_start").size()) == [4, 5]  # across each weekend, and up to the end


def test_restrict_is_idempotent_and_checked(spark, closes):
    s = sessions.observed(closes)
    once = sessions.restrict(closes, s)
    assert once.exceptAll(sessions.restrict(once, s)).count() == 0 and sessions.missing_sessions(closes, s).count() == 0
    with pytest.raises(ValueError):
        sessions.checked_restrict(closes.where("d > DATE '2020-01-03'"), s)
    with pytest.raises(KeyError):
        sessions.position_of(sessions.positions(s), "2020-01-03")


def test_golden_counts_of_the_session_index(spark):
    hist = spark.range(6517).select(F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int")).alias("d"))
    fwd = spark.range(146).select(F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("d"))
    idx = windows.counted(sessions.session_index(hist, fwd))
    p, h, n = F.col("pos"), F.col("n_history"), F.col("n_sessions")
    r = idx.agg(F.count_if(windows.trainable(p, h)).alias("t"), F.count_if(windows.forward(p, h, n)).alias("f"), F.count("*").alias("n")).first()
    assert (r.n, r.t, r.f) == (6663, 6448, 117)


def test_exposure_equals_the_definition(spark):
    rng = random.Random(3)
    idx = spark.createDataFrame([(k, day(k)) for k in range(120)], "pos long, d date")
    breaks = sorted(rng.sample(range(1, 120), 7))
    got = windows.exposure(idx, spark.createDataFrame([(b,) for b in breaks], "pos long"), past=20, horizon=5).where("pos >= 19").toPandas()
    for r in got.itertuples():
        assert r.hits_target == any(r.pos < b <= r.pos + 5 for b in breaks) and r.hits_window == any(r.pos - 19 < b <= r.pos + 5 for b in breaks)


def test_unwrap_equals_numpy(spark):
    x = np.random.RandomState(4).uniform(0, 360, 80)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, x double")
    assert np.allclose(windows.unwrap(df, "x", "k").orderBy("k").toPandas().x_unwrapped, np.degrees(np.unwrap(np.radians(x))))


def test_direction_and_flags(spark):
    df = spark.createDataFrame([(1.5,), (-2.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in df.select(windows.direction(F.col("x"))).collect()] == [1, -1, 0, 0]


# --- folds ---


def test_golden_fold_geometry():
    f = folds.geometry(5847, 247, 10)
    assert f[0].train[1] - f[0].train[0] + 1 == 2470 and f[0].val[1] - f[0].val[0] + 1 == 673 and f[-1].val[1] - f[-1].val[0] + 1 == 675
    assert f[0].train[0] == 1 and f[0].inner_val[1] - f[0].inner_val[0] + 1 == 370 and f[0].inner_train[1] - f[0].inner_train[0] + 1 == 2091


def test_random_geometries_keep_their_promises():
    rng = random.Random(5)
    for _ in range(300):
        n, per_year, purge, k = rng.randint(100, 3000), rng.randint(10, 100), rng.randint(1, 15), rng.randint(2, 8)
        try:
            f = folds.geometry(n, per_year, purge, k, train_years=rng.randint(1, 4))
        except ValueError:
            continue
        assert folds.violations(f, purge) == [] and f[-1].val[1] == n - 1 and f[0].train[0] >= 0
    with pytest.raises(ValueError):
        folds.geometry(300, 30, 10)


# --- encodings ---


def test_codes_of_unknown_and_null(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,)], "x string")
    levels = ["b", "a"]
    got = df.select(encoding.level_code(F.col("x"), levels).alias("l"), encoding.reserved_code(F.col("x"), levels).alias("r"), encoding.ordinal_code(F.col("x"), ["None", "b"]).alias("o")).collect()
    assert [tuple(r) for r in got] == [(0, 2, 1), (-1, 0, -1), (None, 0, 0)]


def test_scaler_sees_training_rows_only(spark):
    df = spark.createDataFrame([(k, float(k), 3.0) for k in range(20)], "k long, x double, same double")
    a = encoding.fit_scaler(df.where("k < 10"), ["x", "same"])
    b = encoding.fit_scaler(df.withColumn("x", F.when(F.col("k") < 10, F.col("x")).otherwise(1e9)).where("k < 10"), ["x", "same"])
    assert a == b and a.stats["x"][1] == pytest.approx(np.arange(10).std()) and a.transform(df).select("same").distinct().first()[0] == 0
    with pytest.raises(TypeError):
        pickle.dumps(a)
    with pytest.raises(ValueError):
        encoding.fit_scaler(df.where("k < 0"), ["x"])
    with pytest.raises(ValueError):
        encoding.view(df, "other", {}, [], [])


def test_schema_rules(spark):
    df = spark.createDataFrame([(1, True, "a", 2.0, 5.0), (2, False, "b", 3.0, 5.0 + 1e-7)], "id long, flag boolean, kind string, moon_longitude double, near double")
    kinds = schema.types(df.drop("id").schema, {"kind": ["a", "b"]}, r"_longitude$")
    assert kinds == {"flag": "boolean", "kind": "categorical", "moon_longitude": "angular", "near": "linear_numeric"}
    role = schema.roles(df.columns, "id", "near", [], ["flag"])
    assert schema.partition(df, role)["feature"].columns == ["kind", "moon_longitude"]
    with pytest.raises(ValueError):
        schema.partition(df.drop("kind"), role)
    assert {r.column for r in schema.constant_columns(df, ["moon_longitude", "near"]).collect()} == {"near"} == {r.column for r in schema.degenerate_columns(df, ["near"]).collect()}
    assert schema.pairs(["sun_moon_dist", "sun_speed_dist", "moon_sun_dist"], ["sun", "moon"]) == [("sun_moon_dist", "sun", "moon"), ("moon_sun_dist", "moon", "sun")]


# --- statistics ---


def test_moments_have_the_small_sample_corrections(spark):
    x = [1.0, 2.0, 4.0, 8.0, 20.0]
    r = audit.moments(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()
    import pandas as pd

    assert r.skew == pytest.approx(pd.Series(x).skew()) and r.kurt == pytest.approx(pd.Series(x).kurt()) and r.std == pytest.approx(np.std(x))


def test_prune_keeps_units_whole(spark):
    rng = np.random.RandomState(6)
    x, z = rng.randn(200), rng.randn(200)
    df = spark.createDataFrame([(float(a), float(2 * a), float(b), float(c)) for a, b, c in zip(x, z, rng.randn(200), strict=True)], "a double, a2 double, s double, c double")
    assert selection.prune(df, {"a": ["a"], "a2": ["a2"], "pair": ["s", "c"]}) == ["a2", "pair"]
    assert min(selection.variance_inflation(df, ["a", "s", "c"]).values()) >= 1
    pcs, shares = selection.components(df, ["a", "a2", "s", "c"])
    assert sum(shares) == pytest.approx(1) and len(pcs.first().pc) == 3


def test_pair_moments_of_240_columns_equal_pandas(spark, tmp_path):
    """Nulls by pair, far offsets, a constant column, an empty one and a near copy, across column blocks; one pass, and pruning over it."""
    import time

    rng = np.random.RandomState(2)
    x = rng.randn(4000, 240) * 10.0 ** rng.randint(-3, 4, 240) + 1000 * rng.randn(240)
    x[:, 200] = x[:, 3] * 2 + 1e-4 * x[:, 3].std() * rng.randn(4000)
    x[rng.rand(*x.shape) < 0.05] = np.nan
    x[:, 9], x[:, 11] = 7, np.nan
    frame = pd.DataFrame(x, columns=[f"k{i}" for i in range(240)])
    frame.to_parquet(f"{tmp_path}/x.parquet", row_group_size=500)
    df = spark.read.parquet(f"{tmp_path}/x.parquet").repartition(4)
    began = time.time()
    r, v = selection.correlation_matrix(df, df.columns)
    assert time.time() - began < 60
    want = frame.corr().to_numpy()
    assert (np.isnan(r) == np.isnan(want)).all() and np.nanmax(np.abs(r - want)) < 1e-6
    assert np.nanmax(np.abs(v / frame.var().to_numpy() - 1)[np.arange(240) != 9]) < 1e-9
    kept = selection.prune(df, {c: [c] for c in df.columns})
    assert len(kept) == 239 and "k3" not in kept  # of the pair the one of lower variance goes


def test_span_components_equal_numpy_on_each_span_and_ignore_other_rows(spark):
    rng = np.random.RandomState(6)
    x = rng.randn(500, 5) @ rng.randn(5, 5) + 100
    x[:, 4] = 3.0
    x[7, 2] = np.nan
    spans = {"a": (0, 199), "b": (100, 349), "c": (50, 399), "none": (900, 950)}
    make = lambda x: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(None, *[9e9] * 5)], "i long, a double, b double, c double, d double, e double").repartition(4)
    df, names = make(x), list("abcde")
    for scaled in (True, False):
        fitted = selection.span_components(df, names, spans, scaled=scaled)
        for k, (lo, hi) in list(spans.items())[:3]:
            own = np.array([r for i, r in enumerate(x) if lo <= i <= hi and np.isfinite(r).all()])
            sd = np.where(own.std(0) > 1e-9, own.std(0, ddof=1), 1.0) if scaled else np.ones(5)
            values = np.linalg.eigvalsh(np.cov(((own - own.mean(0)) / sd).T))[::-1]
            shares = values / values.sum()
            assert fitted[k].shares == pytest.approx(shares, abs=1e-9) and fitted[k].axes.shape[1] == int((np.cumsum(shares) <= 0.95).sum()) + 1
            got = np.array([r.pc for r in selection.project(df.where(F.col("i").between(lo, hi) & (F.col("i") != 7)), names, fitted[k]).collect()])
            assert got.mean(0) == pytest.approx(0, abs=1e-8) and got.var(0, ddof=1) == pytest.approx(values[: got.shape[1]])
        assert fitted["none"].axes.shape == (5, 0)
    changed = x.copy()
    changed[400:] = 1e6
    again = selection.span_components(make(changed), names, spans)
    first = selection.span_components(df, names, spans)
    assert all(np.allclose(first[k].axes, again[k].axes) and np.allclose(first[k].mean, again[k].mean) for k in "abc")
    assert [r.pc for r in selection.project(df.where("i = 7"), names, first["a"]).collect()] == [None]


def test_levels_are_counted_without_shuffling_cells(spark, capsys):
    df = spark.createDataFrame([(k, 5.0 + k * 1e-9, "same", None, k % 2, float(k % 2), str(k % 3), 3 if k % 5 else None, float("nan")) for k in range(60)], "id int, near double, text string, none int, flag int, half double, three string, gap int, odd double")
    assert {(r.column, r.levels) for r in schema.constant_columns(df).collect()} == {("near", 60), ("text", 1), ("none", 0), ("gap", 1), ("odd", 1)}
    assert [(r.column, r.levels) for r in schema.degenerate_columns(df).collect()] == [("near", 60)]
    assert [r.column for r in schema.binary_columns(df, df.columns).collect()] == ["flag"]
    assert schema.constant_columns(df.limit(0)).count() == 9 and schema.binary_columns(df.limit(0), ["id"]).count() == 0


def test_rank_correlation_ranks_rows_in_many_tasks(spark, capsys):
    rng = random.Random(17)
    rows = [(rng.choice([None, float("nan"), *map(float, range(40))]), rng.choice([rng.random(), 0.5]), rng.randint(0, 3)) for _ in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, t int")
    key = lambda v: (v is not None, v != v, 0.0 if v is None or v != v else v)

    def ranks(values):
        keys = [key(v) for v in values]
        return [sum(o < k for o in keys) + (sum(o == k for o in keys) + 1) / 2 for k in keys]

    a, b, t = (ranks(c) for c in zip(*rows, strict=True))
    found = selection.rank_correlation(df, ["a", "b"], "t")
    got = {r["column"]: r.rho for r in found.collect()}
    assert got == {"a": pytest.approx(np.corrcoef(a, t)[0, 1]), "b": pytest.approx(np.corrcoef(b, t)[0, 1])}
    assert selection.rank_correlation(df.limit(0), ["a"], "t").first().rho is None
    found.explain(extended=True)
    lines = [x for x in capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].splitlines() if "Window [" in x]
    assert lines and all("bucket" in x.split("windowspecdefinition", 1)[1] for x in lines)  # never a window over all rows


def test_null_rows_in_prune_vif_and_components(spark):
    rng = np.random.RandomState(16)
    x = rng.randn(300, 3)
    x[:, 1] = x[:, 0] + 0.2 * x[:, 1]
    x[:200, 2], x[270:, 1] = np.nan, -x[270:, 0]
    rows = [tuple(None if i % 2 and np.isnan(v) else float(v) for v in r) for i, r in enumerate(x)]
    df, full = spark.createDataFrame(rows, "a double, b double, c double"), x[200:]
    assert abs(np.corrcoef(full.T)[0, 1]) < 0.6 < np.corrcoef(x[:, :2].T)[0, 1] and x[:, 0].var() < x[:, 1].var()
    assert selection.prune(df, {"a": ["a"], "b": ["b"], "c": ["c"]}, 0.6) == ["b", "c"]  # pairwise, as two columns alone would go
    found = selection.variance_inflation(df, ["a", "b", "c"])
    assert list(found.values()) == pytest.approx(np.diag(np.linalg.inv(np.corrcoef(full.T))))
    pcs, shares = selection.components(df, ["a", "b", "c"])
    got = [r.pc for r in pcs.collect()]
    assert len(got) == 300 and sum(pc is None for pc in got) == 200
    values = np.linalg.eigvalsh(np.cov(full.T))[::-1]
    assert shares == pytest.approx(values / values.sum())
    assert [r.pc for r in selection.components(df.limit(3), ["a", "b", "c"])[0].collect()] == [None] * 3


def test_scorecard_equals_numpy(spark):
    r = np.random.RandomState(7).randn(60) * 0.01
    df = score.always_up(spark.createDataFrame([(k, float(v)) for k, v in enumerate(r)], "pos long, r double"))
    got, path = score.scorecard(df).first(), np.cumsum(r)
    assert got.total_return == pytest.approx(np.exp(path[-1]) - 1) and got.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * np.sqrt(252))
    assert got.max_drawdown == pytest.approx((np.exp(path - np.maximum(np.maximum.accumulate(path), 0)) - 1).min())


def test_horizon_correlation_equals_numpy(spark):
    x = np.random.RandomState(18).randn(80, 3)
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([(*map(float, r), 0.0) for r in x], "f_1 double, f_2 double, f_3 double, f_4 double")
    got = {(r.step_a, r.step_b): r.r for r in score.horizon_correlation(df, ["f_1", "f_2", "f_3", "f_4"]).collect()}
    want = np.corrcoef(x.T)
    assert got == {(a, b): None if b == 4 else pytest.approx(want[a - 1, b - 1]) for a in range(1, 5) for b in range(a + 1, 5)}
    assert selection.prune(df, {c: [c] for c in df.columns}) == df.columns  # a constant column correlates with nothing


def test_boosted_stand_in_learns(spark):
    rng = np.random.RandomState(8)
    df = spark.createDataFrame([(float(a), float(3 * a), float(-a)) for a in rng.randn(200)], "x double, y_1 double, y_2 double")
    out = score.forecast(df, score.boosted_steps(df, ["x"], ["y_1", "y_2"], rounds=5), ["x"])
    assert all(r.nrmse < 0.5 for r in score.errors(out, ["y_1", "y_2"], ["f_y_1", "f_y_2"]).collect())


# --- sources, sinks, streams ---


def test_sources_and_sinks(spark, tmp_path, closes):
    io.write_report(closes, f"{tmp_path}/c")
    assert io.read_csv(spark, f"{tmp_path}/c", "d date, c double").exceptAll(closes).count() == 0
    io.write_table(closes, f"{tmp_path}/closes.parquet")
    assert io.read_table(spark, str(tmp_path), "closes").count() == 12
    checksum = io.write_spec({"a": 1}, f"{tmp_path}/s.json")
    assert io.read_spec(f"{tmp_path}/s.json", checksum) == {"a": 1} and io.checksums(spark, f"{tmp_path}/s.json").first().sha256 == checksum
    with pytest.raises(ValueError):
        io.read_spec(f"{tmp_path}/s.json", "0" * 64)
    with pytest.raises(ValueError):
        io.validate_schema(closes, ["d"])
    assert io.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double")).where("x IS NULL").count() == 1
    assert io.markdown([(1, 2)], ["a", "b"]).splitlines()[-1] == "| 1 | 2 |"


def test_stream_equals_batch(spark, tmp_path, data):
    from tidecast.streaming import events

    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = f"{tmp_path}/in"
    batch.repartition(3).write.parquet(src)
    late = spark.createDataFrame([(10**9, dt.datetime(2030, 1, 1), 1, "end", 0.0, "{}")], batch.schema)  # moves the watermark past all
    late.write.mode("append").parquet(src)
    counts = events.windowed_counts(events.read_stream(spark, src, batch.schema, 100))
    events.run_once(counts, f"{tmp_path}/out", f"{tmp_path}/cp")
    want = events.windowed_counts(batch).select("start", "event_type", "n")
    got = spark.read.parquet(f"{tmp_path}/out").where("event_type <> 'end'").select("start", "event_type", "n")
    assert want.exceptAll(got).count() == 0 == got.exceptAll(want).count()


def test_head_tail_complete_rows_and_sorted_sets(spark):
    rows = spark.createDataFrame([(k, (k * 7) % 5, None if k == 3 else float("nan") if k == 4 else 1.0) for k in range(9)], "k long, g long, v double")
    assert [r.k for r in schema.head(rows, ["g", "k"], 3).collect()] == [0, 5, 3] and [r.k for r in schema.tail(rows, ["k"], 2).collect()] == [8, 7]
    assert {r.k for r in schema.complete_rows(rows, ["v"]).collect()} == {0, 1, 2, 5, 6, 7, 8} and schema.complete_rows(rows, ["k"]).count() == 9
    assert {r.g: r["values"] for r in schema.sorted_sets(rows, ["g"], "k").collect()}[0] == [0, 5]


def test_apply_raises_for_consumed_columns_that_are_missing(spark):
    rows = spark.range(2).withColumn("a", F.lit(1.0))
    assert schema.apply(rows, {"b": F.col("a") + 1}, drop=["a"]).columns == ["id", "b"]
    with pytest.raises(ValueError, match="no such source columns: x"):
        schema.apply(rows, {"b": F.col("a")}, drop=["a", "x"])


def test_quantiles_and_medians_are_exact(spark):
    rng = np.random.RandomState(3)
    x = np.round(rng.randn(997) * 5, 1)
    frame = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)] * 5, "x double, empty double")
    steps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert selection.quantiles(frame, "x", steps) == pytest.approx(np.quantile(x, steps))
    assert selection.quantiles(frame, "empty", [0.5]) == [None]
    filled = encoding.impute_median(frame, ["x", "empty"])
    assert filled.where("x IS NULL").count() == 0 and filled.where("empty IS NULL").count() == 1002
    assert filled.agg(F.sum("x")).first()[0] == pytest.approx(x.sum() + 5 * np.median(x))


def test_transitions_over_ranges_equal_a_plain_walk(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, float(rng.randint(0, 300))]), k, rng.randint(1, 3)) for k in range(2000) for g in "ab"]
    frame = spark.createDataFrame(rows, "g string, at double, k long, v long").repartition(5)
    got = {r.g: r.transitions for r in windows.transitions(frame, "v", ["at", "k"], 3, 1, ["g"]).collect()}
    for g in "ab":
        path = [v for *_, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
        assert got[g] == sum(a == 3 and b == 1 for a, b in zip(path, path[1:]))


def test_rates_survival_duplicates_and_spread(spark):
    n = 400
    turn = [k * 41 + 15 * math.sin(k / 11) for k in range(n)]
    rows = spark.createDataFrame([(k, t % 360, 41 + 15 / 11 * math.cos(k / 11), float(k % 7)) for k, t in enumerate(turn)], "pos long, angle double, good double, bad double")
    good, bad = (audit.rate_consistency(rows, "angle", c, "pos").first() for c in ("good", "bad"))
    assert good.consistent and good.slope == pytest.approx(1, abs=0.01) and good.n == n - 2 and not bad.consistent
    waves = rows.select("*", F.sin("pos").alias("s"), F.cos("pos").alias("c"), (F.sin("pos") * 3).alias("copy"), (F.sin("pos") + 1e-9).alias("near"))
    alive = {r.body: r.survives for r in audit.prune_survival(waves, "copy", {"wave": ("s", "c"), "other": ("bad", "good")}).collect()}
    assert alive == {"wave": False, "other": True}
    assert [r.duplicate for r in audit.duplicates(waves, [("s", "near"), ("s", "c")]).collect()] == [True, False]
    spread = {r.fold: (r.mean, r.std, r.n) for r in score.per_fold(spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "fold int, r double"), "r").collect()}
    assert spread[1] == (2.0, pytest.approx(2**0.5), 2) and spread[2][1] is None


def test_ranking_units_and_builders(spark):
    ranking = spark.createDataFrame([("a", 0.1), ("b", -0.9), ("c", 0.5), ("d", None)], "column string, rho double")
    assert [(r.column, r.place) for r in selection.top(ranking, "rho", 2).collect()] == [("b", 1), ("c", 2)]
    assert selection.pair_units(["x", "m_sin", "m_cos", "y_sin"]) == {"x": ["x"], "m": ["m_sin", "m_cos"], "y_sin": ["y_sin"]}
    assert encoding.takes_no_data(lambda: {}) and not encoding.takes_no_data(lambda df: {})


def test_folds_of_a_short_history_raise(spark):
    from tidecast.plans import catalogue

    short = spark.range(3).select(F.col("id").alias("pos"), F.current_date().alias("d"))
    saved = catalogue._origins, catalogue.D.history
    catalogue._origins, catalogue.D.history = (lambda *a: short), (lambda *a: spark.createDataFrame([(dt.date(1990 + y, 1, 1 + k), 1.0) for y in range(4) for k in range(20)], "d date, c double"))
    try:
        with pytest.raises(ValueError, match="too few"):
            catalogue._folds(spark, "")
    finally:
        catalogue._origins, catalogue.D.history = saved


def test_a_bundle_of_checks_names_those_that_fail(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0), (2, None, None), (3, 1.0, 2.5)], "k long, a double, b double")
    good = schema.formula_violations(rows.where("k < 3"), "b", F.col("a") + 1)
    bad = schema.formula_violations(rows, "b", F.col("a") + 1, 0.1)
    assert good.count() == 0 and [r.k for r in bad.collect()] == [3]
    assert schema.uncovered(["a", "b", "k"], {"x": ["a", "b"], "y": ["b", "z"]}) == ["missing k", "unknown z", "repeated b"]
    schema.require({"formula": good, "coverage": schema.uncovered(["a"], {"x": ["a"]})})
    with pytest.raises(ValueError, match="checks failed: formula, coverage"):
        schema.require({"null rule": encoding.null_rule_violations(rows, "a", "k", 2), "formula": bad, "coverage": ["missing a"]})


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.feature import PCA, VectorAssembler

    rows = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame([(float(k), 2.0 * k + k % 3) for k in range(20)], "x double, y double"))
    model = PCA(k=1, inputCol="features", outputCol="pc").fit(rows)
    io.save_model(model, f"file://{tmp_path}/m")
    io.save_model(model, f"file://{tmp_path}/m")
    assert [r.pc for r in io.load_model(f"file://{tmp_path}/m").transform(rows).collect()] == [r.pc for r in model.transform(rows).collect()]


def test_coverage_counts_nulls_and_refuses_roles_that_differ(spark):
    df = spark.createDataFrame([(1, None, float("nan"), "a"), (None, "x", 2.0, None), (3, "y", None, "b")], "k long, s string, x double, n string")
    by_role, by_type = {"k": "key", "s": "feature", "x": "feature", "n": "feature"}, {"k": "linear_numeric", "s": "categorical", "x": "linear_numeric", "n": "categorical"}
    got = {r["column"]: (r.role, r.type, r.n, r.nulls) for r in schema.coverage(df, by_role, by_type).collect()}
    assert got == {"k": ("key", "linear_numeric", 3, 1), "s": ("feature", "categorical", 3, 1), "x": ("feature", "linear_numeric", 3, 2), "n": ("feature", "categorical", 3, 1)}
    assert {r.nulls for r in schema.coverage(df.limit(0), by_role, by_type).collect()} == {0}
    for wrong in ({**by_role, "z": "feature"}, {c: r for c, r in by_role.items() if c != "s"}):
        with pytest.raises(ValueError):
            schema.coverage(df, wrong, by_type)


def test_lookup_of_days_that_are_no_session(spark):
    d = dt.date(2024, 1, 1)
    days = sessions.positions(spark.createDataFrame([(d,), (d + dt.timedelta(days=2),)], "d date"))
    rows = spark.createDataFrame([(d, 7), (d, 7), (d + dt.timedelta(days=1), 7), (d + dt.timedelta(days=2), 7), (None, 7)], "d date, pos int")
    got = [(r.d and (r.d - d).days, r.pos, r.is_session) for r in sessions.lookup(rows, days).collect()]
    assert sorted(got, key=str) == sorted([(0, 0, True), (0, 0, True), (1, None, False), (2, 1, True), (None, None, False)], key=str)
    assert sessions.lookup(rows.limit(0), days).count() == 0 and sessions.lookup(rows, days.limit(0)).where("is_session").count() == 0
