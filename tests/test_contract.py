"""Every registered query with SQL against DuckDB, and the driver's entry points."""

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.plans import QUERIES
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def base(folder):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n in QUERIES))
def test_query_equals_sql(spark, folder, base, name):
    df = contract.queries()[name](spark, folder)
    relation = base.execute(contract.oracle_sql()[name])
    want = rows_of([d[0] for d in relation.description], relation.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", ["i05_lasso_cv", "i06_forest", "i11_score_panel", "i14_tuning_table"])
def test_query_without_sql_runs(spark, folder, name):
    """The widest of the model queries that have no SQL; their operators have tests of their own."""
    df = contract.queries()[name](spark, folder)
    assert df.columns == [c for c, _ in QUERIES[name].columns] and len(df.collect()) > 0


def test_entry(spark, folder):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_corpus_queries_keep_to_their_names():
    own = set(contract.queries()) - set(QUERIES)
    assert all(n == "pipeline" or n.startswith("op") for n in own)
    assert not any(n == "pipeline" or n.startswith("op") for n in QUERIES)
