"""Every query that has SQL is run on both engines and must give the same rows."""

import importlib.util
import math
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry_module)

QUERIES = entry_module.catalog.queries()
SQL = entry_module.oracle.statements()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
# Results that depend on how a learner was implemented.
LEARNED = {
    "random_forest_cv", "boosted_trees_cv", "oof_predictions", "holdout_eval", "random_search",
    "feature_importance", "full_fit", "tree_contributions",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def test_entry_lists_every_query():
    assert QUERIES.keys() <= entry_module.queries().keys()
    assert SQL.items() <= entry_module.oracle_sql().items()


def test_every_statement_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
    assert QUERIES.keys() - SQL.keys() == LEARNED


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    described = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    expected = duck.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, expected.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry_gives_one_summary_row(spark):
    out = entry_module.entry(spark).collect()
    assert len(out) == 1 and out[0]["n_splits"] == 5
