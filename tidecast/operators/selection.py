"""Feature selection: correlation pruning over units, rank correlation, binned mutual information, variance inflation, components.

Statistics are one aggregation each; what reaches the driver is a matrix over columns, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df.select(*[F.col(c).cast("double") for c in columns])).select("features")


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> np.ndarray:
    """The matrix over rows without a null or NaN in any of the columns."""
    return Correlation.corr(_vectors(df, columns), "features", method).first()[0].toArray()


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of all pairs, a before b, in one aggregation; null where one of the two is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    spread = lambda a, b: F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a)))
    row = df.agg(*[F.try_divide(F.covar_pop(a, b), spread(a, b) * spread(b, a)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def pair_moments(df: DataFrame, columns: Sequence[str], block: int = 128) -> DataFrame:
    """(i, j, n, r, v) of every pair i <= j of columns (by place): rows where both have a value, their correlation over those rows, and for
    i = j the sample variance. Nulls, NaN and infinities leave out their own value only.

    One pass: each task adds up the cross products, sums, squares and joint counts of its rows by blocks of columns, as matrix
    products, so a task holds five matrices of columns squared; Spark sums the pairs over tasks. Values are shifted by the
    means of some first rows, which changes nothing but rounding.
    """
    names = list(columns)
    p = len(names)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    first = rows.limit(200).agg(*[F.avg(finite(f"c{k}")).alias(f"c{k}") for k in range(p)]).first()
    shift = np.array([v or 0.0 for v in first])
    at = range(0, p, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((5, p, p))  # joint count; sum of i, sum of j's square, sum of i's square, product: all over joint rows
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float)
            has = np.isfinite(x)
            x, m = np.where(has, x - shift, 0.0), has.astype(float)
            for a in at:
                for b in at:
                    i, j = slice(a, a + block), slice(b, b + block)
                    for k, (left, right) in enumerate(((m, m), (x, m), (m, x * x), (x * x, m), (x, x))):
                        if b >= a or k == 1:  # the sum of j is the transposed sum of i
                            sums[k, i, j] += left[:, i].T @ right[:, j]
        i, j = np.triu_indices(p)
        n, si, sjj, sii, sij = sums[:, i, j]
        sj = sums[1, j, i]
        keep = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (i.astype(np.int32), j.astype(np.int32), n, si, sj, sii, sjj, sij)], names=["i", "j", "n", "si", "sj", "sii", "sjj", "sij"])

    parts = rows.mapInArrow(run, "i int, j int, n double, si double, sj double, sii double, sjj double, sij double")
    whole = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])
    ss = lambda s, q: F.greatest(F.lit(0.0), F.col(q) - F.col(s) * F.col(s) / F.col("n"))
    spread = F.sqrt(ss("si", "sii") * ss("sj", "sjj"))
    r = F.when(spread > 1e-12 * F.sqrt(F.col("sii") * F.col("sjj")), (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / spread)
    return whole.select("i", "j", F.col("n").cast("long").alias("n"), r.alias("r"), F.when((F.col("i") == F.col("j")) & (F.col("n") > 1), ss("si", "sii") / (F.col("n") - 1)).alias("v"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise-complete correlations (NaN where a column is constant or no rows are shared) and variances, on the driver: columns
    squared, never rows."""
    p = len(columns)
    r, v = np.full((p, p), np.nan), np.full(p, np.nan)
    for row in pair_moments(df, columns).collect():
        r[row.i, row.j] = r[row.j, row.i] = np.nan if row.r is None else row.r
        if row.i == row.j:
            v[row.i] = np.nan if row.v is None else row.v
    return r, v


def prune(df: DataFrame, units: Mapping[str, Sequence[str]], threshold: float = 0.95) -> list[str]:
    """Units (one column, or a sine and cosine pair) that stay. In order, each unit meets every earlier one; if their largest
    absolute correlation reaches the threshold and both still stand, the one of lower variance goes, the earlier one at a tie.

    A null or NaN leaves out its own value only: a correlation is over the rows where both columns have values, a variance over all
    values of its column."""
    columns = list(dict.fromkeys(c for u in units.values() for c in u))
    r, v = correlation_matrix(df, columns)
    r, v = np.abs(np.nan_to_num(r)), np.nan_to_num(v)
    at = {c: i for i, c in enumerate(columns)}
    var = {u: max(v[at[c]] for c in cs) for u, cs in units.items()}
    names, gone = list(units), set()
    for i, u in enumerate(names):
        for v in names[:i]:
            if u in gone or v in gone:
                continue
            if max(r[at[a], at[b]] for a in units[u] for b in units[v]) >= threshold:
                gone.add(u if var[u] < var[v] else v)
    return [u for u in names if u not in gone]


def value_places(df: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """(value, n, before) of a numeric column's distinct values: rows that hold it, and rows of smaller values; null is the smallest
    value, NaN the largest.

    Values are counted, dealt into ranges of about equally many distinct values, and summed up inside each range in its own task;
    in one task are only the totals of the ranges.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("value", [k / buckets for k in range(1, buckets)]).alias("cuts"))
    bucket = F.when(F.col("value").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda x: x < F.col("value"))))
    dealt = counts.crossJoin(F.broadcast(cuts)).select("value", "n", bucket.alias("bucket"))
    totals = dealt.groupBy("bucket").agg(F.sum("n").alias("total"))
    before = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("value")) - F.col("n")
    return dealt.join(F.broadcast(before), "bucket").select("value", "n", (F.col("before") + inside).alias("before"))


def mean_ranks(df: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """(value, rank) of a numeric column's distinct values, ties at their mean rank; null is the smallest value, NaN the largest."""
    return value_places(df, column, buckets).select("value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, column: str, steps: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a numeric column by linear interpolation; nulls are left out, and without values each is None. The
    values come from counts by range (value_places), so no task holds all distinct values; the few asked for reach the driver."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = rows.count()
    if not n:
        return [None] * len(steps)
    at = [p * (n - 1) for p in steps]
    wanted = sorted({int(f) for x in at for f in (np.floor(x), np.ceil(x))})
    places = value_places(rows, "v").withColumn("k", F.explode(F.array(*map(F.lit, wanted)))).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n")))
    value = {r.k: r.value for r in places.select("k", "value").collect()}
    return [value[int(np.floor(x))] + (x - np.floor(x)) * (value[int(np.ceil(x))] - value[int(np.floor(x))]) for x in at]


def top(ranking: DataFrame, by: str, n: int, name: str = "column") -> DataFrame:
    """The n columns of a ranking of largest magnitude, ties by name, with their place."""
    order = ranking.where(F.col(by).isNotNull()).orderBy(F.abs(by).desc(), name).limit(n)
    return order.withColumn("place", F.row_number().over(Window.orderBy(F.abs(by).desc(), name)))  # n rows


def pair_units(columns: Sequence[str]) -> dict[str, list[str]]:
    """Units for prune: a sine and its cosine (stem_sin, stem_cos) are one, every other column one of its own, in order."""
    units: dict[str, list[str]] = {}
    for c in columns:
        stem = c[:-4] if c.endswith(("_sin", "_cos")) and {f"{c[:-4]}_sin", f"{c[:-4]}_cos"} <= set(columns) else c
        units.setdefault(stem, []).append(c)
    return units


def rank_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(column, rho): Spearman's correlation with the target, ties at their mean rank. Numeric columns."""
    names = list(dict.fromkeys([*columns, target]))
    rows = values = df.select(*names)
    for k, c in enumerate(names):
        ranks = mean_ranks(values, c).toDF(f"_value{k}", f"_rank{k}")
        rows = rows.join(ranks, F.col(c).eqNullSafe(F.col(f"_value{k}")))
    return correlation_pairs(rows.select(*[F.col(f"_rank{k}").alias(c) for k, c in enumerate(names)]), columns, target, "rho")


def correlation_pairs(df: DataFrame, columns: Sequence[str], target: str, name: str) -> DataFrame:
    row = df.agg(*[F.corr(c, target).alias(f"r{k}") for k, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{k}").alias(name)) for k, c in enumerate(columns)])).alias("p")).select("p.*")


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 8) -> DataFrame:
    """(column, mi) in nats over equal-frequency bins of both sides; bin edges are exact quantiles, fetched once."""
    steps = [k / bins for k in range(1, bins)]
    cuts = {c: quantiles(df, c, steps) for c in [*columns, target]}
    code = lambda c: sum((F.col(c) > F.lit(e)).cast("int") for e in sorted(set(cuts[c])))
    rows = df.select(code(target).alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), code(c).alias("x")) for c in columns])).alias("p")).select("t", "p.*")
    joint = rows.groupBy("column", "x", "t").agg(F.count("*").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("column", *k))
    p = joint.select("column", "n", by("x").alias("nx"), by("t").alias("nt"), by().alias("all"))
    return p.groupBy("column").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("nt")))).alias("mi"))


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix. It stands for regressions on all other columns, so only rows with a value in every
    column (no null, no NaN) count."""
    return dict(zip(columns, np.diag(np.linalg.inv(correlation(df, columns))).tolist(), strict=True))


def components(df: DataFrame, columns: Sequence[str], share: float = 0.95) -> tuple[DataFrame, list[float]]:
    """(pc array<double>) of the fewest components whose variance passes the share, and all their shares; centred first.

    Every row gets a row. Those with a null, NaN or infinite value take no part in the fit, and their pc is null; with fewer than two
    others there are no components, and every pc is null.
    """
    values = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    names = values.columns
    values = values.select(*names, reduce(and_, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in names]).alias("usable"))
    stats = values.where("usable").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    if stats.n < 2:
        return values.select(F.lit(None).cast("array<double>").alias("pc")), []
    centred = values.select("usable", *[(F.col(c) - F.lit(stats[c])).alias(c) for c in names])
    vectors = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(centred).select("usable", "features")
    model = PCA(k=len(names), inputCol="features", outputCol="pc").fit(vectors.where("usable"))
    shares = model.explainedVariance.toArray().tolist()
    k = next((i + 1 for i, s in enumerate(np.cumsum(shares)) if s > share), len(names))
    return model.transform(vectors).select(F.when(F.col("usable"), F.slice(vector_to_array("pc"), 1, k)).alias("pc")), shares


@dataclass(frozen=True)
class Components:
    """Axes (columns by components) of one block of training rows, with the mean and scale that rows get before; shares: of all axes."""

    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    shares: np.ndarray


def span_components(df: DataFrame, columns: Sequence[str], spans: Mapping[object, tuple[int, int]], place: str = "i", share: float = 0.95, scaled: bool = True) -> dict[object, Components]:
    """The fewest components that pass the share of variance, for each span of rows (first and last place), from its own rows alone.

    Spans may overlap: their ends cut the places into disjoint segments, one pass adds up each segment's count, sums and cross
    products, and a span is the sum of its segments, so more spans cost no more passes. Rows with a null, NaN or infinite
    value take no part. scaled: columns are divided by their standard deviation first, constant ones by one. An axis points
    to where its largest weight is positive. A span of fewer than two rows has no components.
    """
    names, p = list(columns), len(columns)
    edges = np.array(sorted({e for lo, hi in spans.values() for e in (lo, hi + 1)}))
    inside = reduce(or_, [F.col(place).between(lo, hi) for lo, hi in spans.values()])
    rows = df.where(inside).select(F.col(place).cast("long").alias("i"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    usable = reduce(and_, [F.coalesce(F.abs(f"c{k}") < float("inf"), F.lit(False)) for k in range(p)])
    first = rows.where(usable).limit(200).agg(*[F.avg(f"c{k}") for k in range(p)]).first()
    shift = np.array([v or 0.0 for v in first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(edges), p + 1, p + 1))
        for batch in batches:
            at, x = batch.column(0).to_numpy(), np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
            segment, x = np.searchsorted(edges, at, "right") - 1, np.concatenate([np.ones((len(at), 1)), x - shift], 1)
            for s in np.unique(segment):
                if 0 <= s < len(edges) - 1:
                    mine = x[segment == s]
                    sums[s] += mine.T @ mine
        s, i, j = np.nonzero(np.triu(np.ones((p + 1, p + 1)))[None] * (sums[:, :1, :1] > 0))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in (s, i, j)] + [pa.array(sums[s, i, j])], names=["s", "i", "j", "v"])

    found = rows.where(usable).mapInArrow(run, "s int, i int, j int, v double").groupBy("s", "i", "j").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((max(1, len(edges)), p + 1, p + 1))
    for r in found:
        sums[r.s, r.i, r.j] = sums[r.s, r.j, r.i] = r.v
    out = {}
    for name, (lo, hi) in spans.items():
        whole = sums[np.searchsorted(edges, lo) : np.searchsorted(edges, hi + 1)].sum(0)
        n = whole[0, 0]
        if n < 2:
            out[name] = Components(np.zeros(p), np.ones(p), np.zeros((p, 0)), np.zeros(p))
            continue
        mean = whole[0, 1:] / n
        cov = (whole[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        scale = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean + shift)), sd, 1.0) if scaled else np.ones(p)
        values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
        values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(p)] < 0, -1.0, 1.0)
        shares = values / (values.sum() or 1.0)
        k = min(p, int((np.cumsum(shares) <= share).sum()) + 1)
        out[name] = Components(mean + shift, scale, axes[:, :k], shares)
    return out


def project(df: DataFrame, columns: Sequence[str], fitted: Components, name: str = "pc") -> DataFrame:
    """df with the array of its components under a fitted model; null for a row with a null, NaN or infinite value."""

    @F.pandas_udf("array<double>")
    def run(*values):
        import pandas as pd

        x = np.stack([v.to_numpy(float) for v in values], 1)
        y = ((x - fitted.mean) / fitted.scale) @ fitted.axes
        return pd.Series([r if ok else None for r, ok in zip(y.tolist(), np.isfinite(x).all(1), strict=True)])

    return df.withColumn(name, run(*[F.col(c).cast("double") for c in columns]))
