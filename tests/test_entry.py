import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from ferrowick.plans import queries as plans

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["qid", "doc_id", "score", "rank", "passage"]


def test_sql_is_of_registered_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    expected = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in expected.description]
    found = plans.QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, expected.fetchall()))


def test_the_rest_stands_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    (copy / "ferrowick" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True, timeout=120)
