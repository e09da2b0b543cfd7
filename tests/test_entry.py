"""Every registered query that has SQL, against DuckDB on the smallest tables; and the registry without the llm subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
sys.path.insert(0, REPO)
import __spark_entry__ as entry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ours = entry.queries()[name](spark, SF_DIR)
    theirs = duck.sql(entry.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = [tuple(r[c] for c in columns) for r in ours.collect()]
    want = theirs.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 25


@pytest.fixture(scope="module")
def without_llm(tmp_path_factory):
    """A copy of the repository as the driver makes it: without the subpackage, its tests and the pipeline."""
    import shutil

    copy = tmp_path_factory.mktemp("without") / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    return copy


def run_in(copy, *args):
    return subprocess.run([sys.executable, *args], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_registry_without_llm(without_llm):
    said = run_in(without_llm, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'skeleton_names' in q, any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))")
    assert said.stdout.split()[1:] == ["True", "False", "True"], said.stderr


def test_tests_without_llm(without_llm):
    said = run_in(without_llm, "-m", "pytest", "-x", "-q", "tests/test_text.py", "tests/test_batches.py", "-k", "not every_code_point")
    assert said.returncode == 0 and " passed" in said.stdout, said.stdout[-800:]


def test_a_missing_dependency_is_not_a_missing_subpackage():
    said = subprocess.run([sys.executable, "-c", "import sys, builtins; real = builtins.__import__\ndef no(name, *a, **k):\n    if name.split('.')[0] == 'numpy': raise ModuleNotFoundError('x', name='numpy')\n    return real(name, *a, **k)\nbuiltins.__import__ = no\nimport __spark_entry__"], cwd=REPO, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": REPO})
    assert said.returncode and "numpy" in said.stderr
