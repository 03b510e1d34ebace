"""Every raster query against its SQL on the small tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from gridloom.plans import history_queries, more_queries, sampling_queries, store_queries  # noqa: F401  (they register their queries)
from gridloom.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_imports_without_a_session():
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


@pytest.mark.parametrize(("gone", "left"), [(("gridloom.llm",), False), (("corpus_pipeline",), True), (("gridloom.llm", "corpus_pipeline"), False)])
def test_entry_without_optional_modules(gone, left):
    """Each may be absent; a module that is missing inside them is an error."""
    root = Path(__file__).resolve().parent.parent
    if not (root / "gridloom" / "llm").exists():
        left = False
    block = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert "pipeline" not in q and ("op9_jaccard" in q) == {left} and "components_table" in q and set(e.oracle_sql()) <= set(q)
"""
    out = subprocess.run([sys.executable, "-c", block], cwd=root, env=os.environ, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_a_missing_part_of_an_optional_module_is_an_error():
    root = Path(__file__).resolve().parent.parent
    if not (root / "gridloom" / "llm").exists():
        pytest.skip("the optional modules are absent")
    block = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "gridloom.llm.bpe":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__
"""
    out = subprocess.run([sys.executable, "-c", block], cwd=root, env=os.environ, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "gridloom.llm.bpe" in out.stderr
