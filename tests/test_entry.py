"""The driver's contract."""

import __spark_entry__ as entry
from tidemark import catalog


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(catalog.queries()) <= set(queries)
    assert set(oracles) <= set(queries)


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_imports_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
