"""The entry file without the llm folders, and every query's SQL against its rows."""

import glob
import math
import os
import subprocess
import sys

import pytest

from siltstone.plans import registry

registry.load()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_entry_imports_without_llm():
    code = "import sys; sys.modules['siltstone.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("gone", ["public_tokenizers", "tiktoken", "xxhash"])
def test_entry_keeps_core_queries_without_a_package(gone):
    code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; assert 'file_edges' in e.queries() and 'file_edges' in e.oracle_sql() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True, timeout=120)


def test_no_module_outside_imports_llm():
    for path in glob.glob(f"{ROOT}/siltstone/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "siltstone.llm" not in open(path).read(), path


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    mine = sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    assert mine == sorted(tuple(map(_plain, r)) for r in want.fetchall())
