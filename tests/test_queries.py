"""The registry: names, SQL beside it, and a few queries against DuckDB on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_every_query_has_sql_or_says_why():
    no_sql = {"communities", "communities_by_types", "pipeline"} | {q for q in entry.queries() if q.startswith("op")}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) <= no_sql


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["degree_by_types", "csv_roundtrip_h", "to_matrix", "attr_index", "modularity", "sssp_path"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    got = entry.queries()[name](spark, D)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(r) for r in want.select(*columns).fetchall())


@pytest.mark.parametrize("gone", [["arcweft/llm", "tests/llm"], ["arcweft/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_graph_queries_stand_alone(tmp_path, gone):
    """Without the training-data folders, the pipeline or both, the registry still has the graph queries."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("arcweft", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.isdir(f"{here}/{name}"):
            shutil.copytree(f"{here}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(f"{here}/{name}"):
            shutil.copy(f"{here}/{name}", tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
            (path / "__pycache__").mkdir(parents=True)  # what a deletion may leave
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'pagerank' in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert int(out.stdout) >= 75
