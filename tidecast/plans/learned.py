"""Queries of fitted models over the fold frames and over raw lines: vector-leaf boosting, walk-forward search, fold-scoped components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import circular as C
from ..operators import boosting as B
from ..operators import folds, information, score, selection, sessions, windows
from ..sources.io import read_table
from ..sources.scratch import Saved
from . import daily as D
from .catalogue import _folds, _labels, _r, query

TARGETS = [f"y_{k}" for k in range(1, windows.HORIZON + 1)]
FORECASTS = [f"f_{k}" for k in range(1, windows.HORIZON + 1)]
FEATURES = ["r", "r_lag1", "r_lag2", "r_lag3", "r_lag4", "mean_5", "std_5", "mean_20", "std_20", "weekday_sin", "weekday_cos"]
SETTINGS = [B.Setting("shallow", rounds=6, depth=2, rate=0.1), B.Setting("deep", rounds=6, depth=3, rate=0.1, patience=3), B.Setting("slow", rounds=6, depth=2, rate=0.03, l2=5.0)]


def fold_frame(spark, sf) -> tuple[DataFrame, list[folds.Fold]]:
    """(i, pos, d, features of the past, y_1 .. y_10) of every origin, saved once as models read it again and again, and the folds."""
    origins, found = _folds(spark, sf)
    steps = windows.step_returns(sessions.positions(D.history(spark, sf)), order="pos")
    known = windows.rolling(windows.lags(steps, "r", [1, 2, 3, 4], order="pos"), "r", (5, 20), order="pos").drop("pos", "c")
    s, c = C.sin_cos(C.weekday_index(F.col("d")), 7)
    labels = _labels(spark, sf).select("d", *TARGETS)
    frame = origins.select("i", "pos", "d").join(known.withColumns({"weekday_sin": s, "weekday_cos": c}), "d").join(labels, "d")
    return Saved(spark, "frame").save(frame), found


def _forecasts(frame: DataFrame, models: list[B.Model], found: list[folds.Fold], edges) -> DataFrame:
    """Every model's forecasts of its own fold's validation block."""
    out, blocks = None, {f.fold: f.val for f in found}
    for m in models:
        name, fold = m.name.split("/")
        block = frame.where(F.col("i").between(*blocks[int(fold)]))
        part = B.predict(block, FEATURES, m, edges[m.name], FORECASTS).select(F.lit(name).alias("setting"), F.lit(int(fold)).alias("fold"), "pos", "d", *TARGETS, *FORECASTS)
        out = part if out is None else out.unionByName(part)
    return out


def walk_forward(spark, sf, settings: list[B.Setting]) -> tuple[DataFrame, list[B.Model]]:
    """Forecasts of every setting over every validation block, each by a model of that fold's inner training rows, stopped on its
    inner validation rows. Bin edges come from the first fold's training rows, which lie before every validation block; the
    binned table is saved once, and all fits share each pass over it."""
    frame, found = fold_frame(spark, sf)
    models = [B.Model(f"{s.name}/{f.fold}", s, f.inner_train, f.inner_val) for s in settings for f in found]
    inside = frame.where(F.col("i") <= found[0].inner_train[1])
    edges = B.fit(frame, FEATURES, TARGETS, models, edges=B.bin_edges(inside, FEATURES))
    return _forecasts(frame, models, found, {m.name: edges for m in models}), models


@query()
def multi_output_forecast(spark, sf):
    """One tree a round for ten steps, forecasts of the whole out-of-sample series."""
    out, _ = walk_forward(spark, sf, SETTINGS[1:2])
    cells = F.array(*[F.struct(F.lit(k + 1).alias("step"), F.col(t).alias("truth"), F.col(f).alias("forecast")) for k, (t, f) in enumerate(zip(TARGETS, FORECASTS, strict=True))])
    return out.select("fold", "pos", F.explode(cells).alias("c")).select("fold", "pos", "c.step", *[(F.round(f"c.{n}", 9) + 0.0).alias(n) for n in ("truth", "forecast")])


@query()
def walk_forward_scorecard(spark, sf):
    """The out-of-sample scorecard of each setting: long or short by the forecast next step, flat at fold boundaries, with costs."""
    out, models = walk_forward(spark, sf, SETTINGS)
    rows = out.withColumn("position", F.signum("f_1")).withColumn("r", F.col("y_1"))
    kept = {s.name: sum(m.best for m in models if m.setting.name == s.name) for s in SETTINGS}
    flat = score.flatten_at_boundaries(rows.withColumn("run", F.concat_ws("/", "setting", F.col("fold").cast("string"))), fold="run")
    card = score.scorecard(flat, cost=0.001, group=["setting"])
    error = rows.groupBy("setting").agg(F.sqrt(F.avg(sum(F.pow(F.col(t) - F.col(f), 2) for t, f in zip(TARGETS, FORECASTS, strict=True)) / len(TARGETS))).alias("rmse"))
    trees = F.element_at(F.create_map(*[F.lit(x) for kv in kept.items() for x in kv]), F.col("setting")).alias("trees")
    return card.join(error, "setting").select("setting", "n", *_r("total_return", "sharpe", "max_drawdown", digits=6), *_r("rmse", digits=8), trees)


@query()
def fold_components(spark, sf):
    """Components of each fold's inner training rows, all folds in one pass, applied to the fold's validation rows."""
    frame, found = fold_frame(spark, sf)
    fitted = selection.span_components(frame, FEATURES, {f.fold: f.inner_train for f in found})
    out = None
    for f in found:
        block = frame.where(F.col("i").between(*f.val))
        part = selection.project(block, FEATURES, fitted[f.fold]).select(F.lit(f.fold).alias("fold"), "i", "pos", F.transform("pc", lambda x: F.round(x, 6) + 0.0).alias("pc"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def neighbour_information(spark, sf):
    """Mutual information of price and discount with the discounted price over all lines, by nearest neighbours."""
    li = read_table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    found = information.neighbour_information(li, ["l_extendedprice", "l_discount"], "net")
    return found.select("column", "n", F.round("mi", 8).alias("mi"))


_LINE = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "shipped"]


@query()
def boosted_lineitem(spark, sf):
    """Price, discount and tax amount of every line by one forest over the whole table, and each feature's share of the gain."""
    price = F.col("l_extendedprice")
    aims = {"price": price, "off": price * F.col("l_discount"), "tax": price * (1 - F.col("l_discount")) * F.col("l_tax")}
    rows = read_table(spark, sf, "lineitem").withColumns({"shipped": F.unix_date(F.to_date("l_shipdate")).cast("double"), "i": F.lit(0), **aims})
    model = B.Model("lines", B.Setting("lines", rounds=5, depth=3, rate=0.3, least=20), (0, 0))
    B.fit(rows, _LINE, list(aims), [model])
    gains = B.importance(model, _LINE)
    total = sum(gains.values()) or 1.0
    return spark.createDataFrame([(f, round(g / total, 6)) for f, g in gains.items()], "feature string, share double")
