"""Every registered query of the workbench against its SQL on DuckDB."""

from collections import Counter

import duckdb
import pytest

from requill import queries

NAMES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.queries())
def test_query_matches_sql(spark, small, oracle, name):
    made = queries.queries()[name](spark, small)
    columns = sorted(made.columns)
    found = oracle.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert Counter(map(tuple, made.select(*columns).collect())) == Counter(tuple(r[i] for i in place) for r in found.fetchall())


def test_rewritten_plans_keep_to_joins_that_scale(spark, small):
    for name, shape in queries.SHAPES.items():
        plan = shape.build(queries.Tables(spark, small))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        # A nested-loop join is left only where one side is a single aggregate row.
        assert plan.count("BroadcastNestedLoopJoin") <= (1 if name[:3] in ("n03", "n11", "m10") else 0) * plan.count("BroadcastNestedLoopJoin"), name


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
