"""Every catalogue query against its SQL in an independent engine, and the entry file without the optional subpackage."""

from __future__ import annotations

import datetime as dt
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidecast.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v != v:
        return None
    if isinstance(v, pd.Timestamp) or isinstance(v, dt.datetime):
        return str(v)[:10] if (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0) else str(v)
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def table(frame):
    frame = frame[sorted(frame.columns)].map(plain)
    return sorted(map(tuple, frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, data, name):
    mine = catalogue.queries()[name](spark, data).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert table(mine) == table(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["signed_separation", "tithy_bin"])
def test_angles_at_the_wrap_and_at_bin_edges_equal_sql(spark, tmp_path, name):
    """Prices that lie whole bins from their quantity's angle: the last bit decides between 0 and 360 and between bins."""
    lines = [(k, 1, k, cents / 100, float(q), 0.0, "N") for k, (cents, q) in enumerate((c, q) for c in range(90240, 150000, 120) for q in (2, 4, 29, 36, 37, 42))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert table(catalogue.queries()[name](spark, str(tmp_path)).toPandas()) == table(con.execute(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["misleading_cells", "circular_distance"])
def test_angles_330_apart_equal_sql(spark, tmp_path, name):
    """Prices whose angle lies 330 degrees, give or take a last bit, from their quantity's angle: 29.999999999999943 mustn't become 30."""
    lines = [(k, 1, k, (q * 720 + 33000 + turns * 36000) % 36000 / 100 + 360.0 * turns, float(q), 0.0, "N") for k, (q, turns) in enumerate((q, t) for q in range(1, 51) for t in range(3, 291))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert table(catalogue.queries()[name](spark, str(tmp_path)).toPandas()) == table(con.execute(catalogue.oracle_sql()[name]).df())


def test_pruned_units_vif_and_components_equal_numpy(spark, data):
    """The three queries that SQL can't say, against NumPy over the whole tables."""
    li = pd.read_parquet(f"{data}/lineitem.parquet", columns=["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).astype(float)
    r = np.corrcoef(li.to_numpy().T)
    got = {x["column"]: x.vif for x in catalogue.queries()["vif"](spark, data).collect()}
    assert [got[c] for c in li.columns] == pytest.approx(np.diag(np.linalg.inv(r)), abs=1e-6)
    theta = 2 * np.pi * li.l_quantity / 50
    units = {"l_quantity": [li.l_quantity], "twice": [2 * li.l_quantity + 1e-3 * li.l_tax], "cycle": [np.sin(theta), np.cos(theta)], "l_discount": [li.l_discount], "l_tax": [li.l_tax]}
    var, gone, names = {u: max(np.var(c, ddof=1) for c in cs) for u, cs in units.items()}, set(), list(units)
    for i, u in enumerate(names):
        for v in names[:i]:
            if not {u, v} & gone and max(abs(np.corrcoef(a, b)[0, 1]) for a in units[u] for b in units[v]) >= 0.95:
                gone.add(u if var[u] < var[v] else v)
    assert [x.unit for x in catalogue.queries()["corr_pruned"](spark, data).collect()] == [u for u in names if u not in gone]
    x = np.stack(pd.read_parquet(f"{data}/embeddings.parquet", columns=["embedding"]).embedding.to_numpy()).astype(float)
    values, axes = np.linalg.eigh(np.cov(x.T))
    shares = np.cumsum(values[::-1]) / values.sum()
    mine = np.array([p.pc for p in catalogue.queries()["pca_k"](spark, data).collect()])
    assert mine.shape == (len(x), int((shares <= 0.95).sum()) + 1)
    k = mine.shape[1]
    assert np.sort(mine.var(0, ddof=1))[::-1] == pytest.approx(values[::-1][:k], rel=1e-6)
    want = (x - x.mean(0)) @ axes[:, ::-1][:, :k]
    assert np.sort((mine**2).sum(1)) == pytest.approx(np.sort((want**2).sum(1)), rel=1e-6)


def test_components_of_whole_vectors_and_of_every_row(spark, data, tmp_path):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").select("embedding")
    x = np.array([r.embedding for r in vectors.collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    k = int(np.argmax(np.cumsum(values) / values.sum() > 0.95)) + 1
    odd = spark.createDataFrame([(None,), ([],), ([1.0] * 65,), ([float("nan")] * 64,), ([None] * 64,)], vectors.schema)
    vectors.union(odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r.pc for r in catalogue.queries()["pca_k"](spark, str(tmp_path)).collect()]
    assert len(got) == len(x) + 5 and sum(pc is None for pc in got) == 5
    pcs = np.array([pc for pc in got if pc is not None])
    assert pcs.shape[1] == k and pcs.var(0, ddof=1) == pytest.approx(values[:k])
    odd.where("size(embedding) < 1 OR embedding IS NULL").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert [r.pc for r in catalogue.queries()["pca_k"](spark, f"{tmp_path}/none").collect()] == [None, None]


def test_entry_imports_without_the_training_data_subpackage(tmp_path):
    """A copy of the repository without the optional folders still offers every other query."""
    for p in ("tidecast", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tidecast/llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 80 and not any(q.startswith('op1_') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "tidecast").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
