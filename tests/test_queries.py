"""Every registered query of the library against its SQL in DuckDB on the smallest driver tables."""

import glob
import math
import os

import duckdb
import pytest

from citeloom.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLE:  # held against plain versions in test_operators.py; here it must give rows
        assert got and all(len(set(r)) > 1 or len(columns) == 1 for r in got[:50])
        return
    said = con.execute(ORACLE[name])
    named = [c[0] for c in said.description]
    assert sorted(named) == columns
    want = [tuple(plain(r[named.index(c)]) for c in columns) for r in said.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "i3_top_npmi" in e.queries()


def test_entry_without_the_llm_folder(tmp_path):
    """Without the subpackage and the pipeline the other queries are there; with a broken one the error is heard."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/citeloom", tmp_path / "citeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert run().stdout.split() == [str(len(QUERIES)), "False"]
    (tmp_path / "citeloom/llm").mkdir()
    for name in ("citeloom/llm/__init__.py", "citeloom/llm/queries.py"):
        (tmp_path / name).write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr


@pytest.mark.parametrize("name, key", [("d2_free_text", "doc_id"), ("k5_combined", "query_id"), ("k7_formatted", "query_id")])
def test_all_orders(spark, tmp_path, name, key):
    """No order is left out for its key."""
    orders = [1, 1999, 2000, 3000, 900_000]
    rows = [(o, n, 7 * n, 3, "A", "O") for o in orders for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r[key] for r in QUERIES[name](spark, str(tmp_path)).collect()} == set(orders)


def test_embedded_documents(spark, con):
    """Means of counts of hashed words over each text's chunks, counted by hand."""
    import zlib

    got = {r.doc_id: [r[f"x{i}"] for i in range(8)] for r in QUERIES["h2_embedded"](spark, SF).collect()}
    for doc, text in con.execute("select doc_id, coalesce(text, '') from documents").fetchall():
        parts = [text] if len(text) <= 3000 else [text[o : o + 3000] for o in range(0, len(text), 2800)]
        sums = [0] * 8
        for w in (w for p in parts for w in p.split()):
            sums[zlib.crc32(w.encode()) % 8] += 1
        assert got[doc] == pytest.approx([x / len(parts) for x in sums], abs=1e-6)
