"""Every query against its SQL in DuckDB, on the smallest tables."""

import pytest
from oracle import connect, difference

from tidewire import registry


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, sf_small, name):
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], sf_small) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_small, name):
    assert registry.QUERIES[name](spark, sf_small).count() > 0


def test_entry_runs_without_the_corpus_subpackage(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", None)
    monkeypatch.setattr(entry, "_pipeline", None)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > len(e.oracle_sql()) > 100"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
