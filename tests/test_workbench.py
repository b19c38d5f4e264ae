"""Guard, engine, catalog, gates, sampling, equivalence."""

import math

import pytest
from pyspark.sql import functions as F

from requill.functions.values import multiset
from requill.operators.equivalence import compare, compare_frames, difference
from requill.operators.sampling import build_sample, dangling, hashed_sample, release, with_parents
from requill.plans.gates import check, fan_out_problems, sargability_problems, static_problems, structural_problems
from requill.plans.guard import StatementRejected, check_statement
from requill.sources.catalog import STAR, Catalog, ForeignKey, from_mapping, from_rows, introspect, short_type
from requill.sources.engine import Engine, get_engine, quote

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def engine(spark, small):
    return Engine(spark.newSession(), small, TABLES)


@pytest.fixture(scope="module")
def catalog(engine):
    return introspect(engine, STAR)


@pytest.mark.parametrize(
    "sql",
    ["SELECT 1", "  with a as (select 1 x) select * from a", "-- a note\nSELECT replace(o_orderstatus, 'drop', 'delete') AS comment FROM orders;", "SELECT * FROM orders TABLESAMPLE (10 PERCENT)", "SELECT a.* FROM (VALUES (1)) a(x) WHERE EXISTS (SELECT 1)"],
)
def test_guard_accepts(engine, sql):
    check_statement(engine.spark, sql)


@pytest.mark.parametrize(
    "sql",
    ["", ";", "DROP TABLE orders", "DELETE FROM orders", "INSERT INTO orders VALUES (1)", "EXPLAIN SELECT 1", "FROM orders", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/tmp/x`", "SELECT reflect('java.lang.System', 'exit', 0)",
     "WITH a AS (SELECT 1) INSERT INTO orders SELECT * FROM a", "SELECT * FROM a.b.c", "SET x = 1", "SELEC 1", "SELECT java_method('java.lang.System', 'gc')", "CREATE TABLE t AS SELECT 1", "SELECT (SELECT reflect('a', 'b'))"],
)
def test_guard_refuses(engine, sql):
    with pytest.raises(StatementRejected):
        check_statement(engine.spark, sql)


def test_engine_fetch_measure_explain(engine):
    assert engine.fetch("SELECT * FROM region", 3).more and not engine.fetch("SELECT * FROM region", 5).more
    assert len(engine.fetch("SELECT * FROM region", 3).rows) == 3
    timing = engine.measure("SELECT count(*) FROM orders", 3)
    assert timing.ok and timing.runs == 3 and timing.median_ms > 0
    assert "no_such" in engine.measure("SELECT no_such FROM orders", 1).error
    plan = engine.explain("SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0")
    assert set(plan.scans) == {"orders", "customer"} and plan.unfiltered_scans == ["orders"] and plan.joins and len(plan.text) <= 4000 and "isFinalPlan=true" in plan.text
    assert quote("a`b") == "`a``b`" and engine.ref("s", "t") == "`s`.`t`"
    with pytest.raises(KeyError, match="spark"):
        get_engine("oracle")
    a, b = (engine.sample_source("orders", 10, seed=3).count() for _ in range(2))
    assert a == b > 0
    topics = engine.catalog_topics()
    assert {r.table_name: r.n_rows for r in topics["row_counts"].collect()}["region"] == 5 and topics["columns"].count() > 20


def test_budget_stops_a_slow_query(engine):
    slow = "SELECT sum(sqrt(a.id * b.id)) FROM range(200000) a JOIN range(200000) b"
    assert "budget" in engine.measure(slow, 1, budget_ms=1500).error


def test_catalog_from_views(engine, catalog):
    assert catalog.rows["region"] == 5 and catalog.columns["orders"]["o_orderkey"] == "BIGINT" and len(catalog.foreign_keys) == 7
    order = catalog.order_for_sampling()
    assert all(order.index(k.parent) < order.index(k.child) for k in catalog.foreign_keys)
    text = catalog.render(engine.spark, "SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", 3)
    assert "CREATE TABLE orders" in text and "3 of 7 tables" in text and "NO INDEX" in text
    assert catalog.tables_in(engine.spark, "WITH orders AS (SELECT * FROM nation) SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM part)") == {"nation", "part"}
    assert catalog.tables_in(engine.spark, "no sql") == set()


def test_catalog_values():
    keys = [("b", "a_id", "a", "id"), {"child_table": "c", "child_column": "b_id", "parent_table": "b", "parent_column": "id"}]
    made = from_mapping({"a": {"id": "integer"}, "b": {"id": "bigint", "a_id": "integer"}, "c": {"b_id": "user-defined"}}, keys, rows={"a": 10, "b": 200, "c": 200}, primary={"a": "id"}, indexed={"b": ["a_id"]})
    assert made.fan_in("b", "a") == 20 and made.fan_in_label(made.foreign_keys[0]).startswith("many-to-one, 20.0")
    assert made.fan_in_label(made.foreign_keys[1]).startswith("roughly") and "UNKNOWN" in made.ddl(["c"]) and "[indexed]" in made.edges()
    assert made.neighbours("b") == ["a", "c"] and made.parents_of("b") == ["a"] and made.children_of("b") == ["c"]
    assert made.scope({"c"}, 2) == ["c", "b"] and made.scope(set(), 2) == ["a", "b"]
    assert made.fan_in("zz", "a") == 0 and Catalog().fan_in_label(made.foreign_keys[0]) == "fan-in unknown"
    assert "id INT -- PRIMARY KEY" in made.ddl(["a"])
    with pytest.raises(ValueError):
        ForeignKey.of(("a", "b"))
    cycle = from_mapping({"a": {}, "b": {}}, [("a", "x", "b", "x"), ("b", "y", "a", "y")])
    assert sorted(cycle.order_for_sampling()) == ["a", "b"]
    assert short_type("Character Varying") == "TEXT" and short_type("jsonb") == "JSONB"


def test_catalog_from_topic_rows():
    made = from_rows({
        "columns": [{"table_name": "t", "column_name": c, "type": "integer", "nullable": n} for c, n in (("a", "NO"), ("b", "YES"))],
        "keys": [{"table_name": "t", "constraint_name": "u", "kind": "UNIQUE", "column_name": c} for c in "ab"] + [{"table_name": "t", "constraint_name": "p", "kind": "PRIMARY KEY", "column_name": "a"}],
        "foreign_keys": [{"child_table": "s", "constraint_name": "f", "parent_table": "t", "child_column": c, "parent_column": c} for c in "ab"],
        "indexed_columns": [{"table_name": "t", "definition": "CREATE INDEX i ON t USING btree (b DESC)"}],
        "row_counts": [{"table_name": "t", "n_rows": 0}, {"table_name": "s", "n_rows": 4}],
    })
    assert made.unique["t"] == {("a", "b")} and made.primary["t"] == ("a",) and made.indexed["t"] == {"b"} and made.rows == {"s": 4}
    assert made.foreign_keys == [ForeignKey("s", ("a", "b"), "t", ("a", "b"))]


def test_static_gate(engine, catalog):
    assert static_problems(engine, "SELECT o_orderkey FROM orders", catalog) == []
    assert static_problems(engine, "SELECT * FROM nope JOIN nix ON 1 = 1", catalog) == ["table 'nix' does not exist", "table 'nope' does not exist"]
    assert "no_such" in static_problems(engine, "SELECT no_such FROM orders", catalog)[0]
    assert static_problems(engine, "DROP TABLE orders", catalog)
    assert static_problems(engine, "SELECT FROM WHERE", catalog)


SOURCE = "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT avg(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)"


def fan(engine, catalog, sql):
    return fan_out_problems(engine.query(sql), catalog)


def test_correlation_is_found_without_qualifiers(engine, catalog):
    assert any("correlated" in p for p in structural_problems(engine, SOURCE, SOURCE, catalog))
    bare = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
    assert any("correlated" in p for p in structural_problems(engine, SOURCE, bare, catalog))


@pytest.mark.parametrize(
    ("sql", "safe"),
    [
        ("WITH g AS (SELECT o_custkey k, avg(o_totalprice) m FROM orders GROUP BY o_custkey) SELECT o_orderkey FROM orders JOIN g ON g.k = o_custkey", True),
        ("SELECT o_orderkey FROM orders JOIN (SELECT o_custkey k, max(o_totalprice) m FROM orders GROUP BY o_custkey) g ON g.k = o_custkey", True),
        ("WITH g AS (SELECT o_custkey k, o_orderstatus s, count(*) n FROM orders GROUP BY o_custkey, o_orderstatus) SELECT o_orderkey FROM orders JOIN g ON g.k = o_custkey", False),
        ("WITH g AS (SELECT l_orderkey k, l_quantity q FROM lineitem WHERE l_tax > 0) SELECT o_orderkey FROM orders JOIN g ON g.k = o_orderkey", False),
        ("WITH g AS (SELECT DISTINCT l_orderkey k, l_partkey p FROM lineitem) SELECT o_orderkey FROM orders JOIN g ON g.k = o_orderkey", False),
        ("WITH g AS (SELECT DISTINCT l_orderkey k FROM lineitem) SELECT o_orderkey FROM orders JOIN g ON g.k = o_orderkey", True),
        ("WITH g AS (SELECT c_custkey k, c_name || '' n FROM customer WHERE c_acctbal > 0) SELECT o_orderkey FROM orders JOIN g ON g.k = o_custkey", True),
        ("WITH g AS (SELECT o_custkey k, sum(o_totalprice) OVER (PARTITION BY o_custkey) s FROM orders) SELECT o_orderkey FROM orders JOIN g ON g.k = o_custkey", False),
        ("WITH g AS (SELECT l_orderkey k, l_quantity * 2 q FROM lineitem) SELECT o_orderkey FROM orders LEFT SEMI JOIN g ON g.k = o_orderkey", True),
        ("SELECT o_orderkey FROM orders CROSS JOIN (SELECT avg(o_totalprice) m FROM orders) a WHERE o_totalprice > m", True),
    ],
)
def test_fan_out(engine, catalog, sql, safe):
    assert (fan(engine, catalog, sql) == []) is safe


def test_composite_keys_count_whole(engine, catalog):
    declared = from_mapping(catalog.columns, primary={"lineitem": ("l_orderkey", "l_linenumber")})
    one = "WITH g AS (SELECT l_orderkey k, l_linenumber n, l_tax * 2 t FROM lineitem) SELECT o_orderkey FROM orders JOIN g ON g.k = o_orderkey"
    assert fan_out_problems(engine.query(one), declared)
    assert not fan_out_problems(engine.query(one + " AND g.n = o_custkey"), declared)


def test_joins_that_only_look_unique(engine, catalog):
    """A column equal to itself, a cast that joins values, a null-safe or outer-free condition prove nothing."""
    grouped = "WITH g AS (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT o.o_orderkey FROM orders o JOIN g ON "
    for unsafe in ("g.k = g.k", "CAST(g.k AS smallint) = o.o_custkey", "g.k % 7 = o.o_custkey", "g.k = g.k + o.o_custkey", "g.m = o.o_totalprice", "g.k = o.o_custkey OR g.m > 5", "CAST(g.k AS double) = o.o_totalprice", "true"):
        assert fan_out_problems(engine.query(grouped + unsafe), catalog), unsafe
    for safe in ("g.k = o.o_custkey", "o.o_custkey + 1 = g.k", "g.k = o.o_custkey AND g.m > 5", "g.k = CAST(o.o_orderstatus AS bigint)", "g.k = 5"):
        assert not fan_out_problems(engine.query(grouped + safe), catalog), safe


def test_only_views_and_plain_functions(engine):
    for refused in ("SELECT * FROM xml.`/etc/passwd`", "SELECT * FROM delta.`/x`", "SELECT * FROM parquet.`/x`", "SELECT * FROM nowhere.t", "SELECT assert_true(false)", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT current_user()", "SELECT raise_error('x')", "SELECT my_own(1)"):
        with pytest.raises(StatementRejected):
            check_statement(engine.spark, refused)
    check_statement(engine.spark, "SELECT typeof(upper(r_name)), count(*) OVER (), percentile(r_regionkey, 0.5) OVER () FROM region")


def test_dropped_clauses_and_not_in(engine, catalog):
    ordered = "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 5"
    lost = structural_problems(engine, ordered, "SELECT count(DISTINCT o_custkey) c, row_number() OVER (ORDER BY o_custkey) r FROM orders GROUP BY o_custkey", catalog)
    assert {"DISTINCT of the source is gone", "ORDER BY of the source is gone", "LIMIT of the source is gone"} <= set(lost)
    assert structural_problems(engine, ordered, ordered, catalog) == []
    found = structural_problems(engine, "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", catalog)
    assert any("NOT IN" in p for p in found)


def test_sargability(engine, catalog):
    assert sargability_problems(engine.query("SELECT 1 FROM orders WHERE abs(o_orderkey) = 5"), catalog)
    assert sargability_problems(engine.query("SELECT 1 FROM orders WHERE CAST(o_custkey AS STRING) LIKE '1%'"), catalog)
    assert not sargability_problems(engine.query("SELECT 1 FROM orders WHERE o_orderkey = 5 AND upper(o_orderstatus) = 'F'"), catalog)


def test_check_composes(engine, catalog):
    good = "WITH g AS (SELECT o_custkey k, avg(o_totalprice) m FROM orders GROUP BY o_custkey) SELECT o.o_orderkey FROM orders o JOIN g ON g.k = o.o_custkey WHERE o.o_totalprice > g.m"
    assert check(engine, SOURCE, good, catalog).ok and check(engine, SOURCE, good, catalog).problems == ()
    assert not check(engine, SOURCE, "SELECT x FROM orders", catalog).ok
    assert compare(engine, SOURCE, good).equal is True


def test_equivalence(engine):
    q = "SELECT o_orderkey, o_custkey FROM orders"
    assert compare(engine, q, q + " ORDER BY o_custkey").equal is True
    different = compare(engine, q, q + " WHERE o_orderkey > 3")
    assert different.equal is False and different.n_missing >= 1 and len(different.missing) <= 3 and "missing" in different.describe()
    assert compare(engine, q, q + " UNION ALL SELECT 1, 1").n_extra == 1
    assert compare(engine, q, "SELECT o_orderkey FROM orders").equal is False
    assert compare(engine, q, q + " WHERE o_orderkey >= -1", limit=10).equal is None
    assert compare(engine, "SELECT bad FROM orders", q).reason.startswith("original failed")
    assert compare(engine, q, "SELECT o_orderkey, 'x' FROM orders").equal is False


def test_values_compare_by_normal_form(spark):
    rows = lambda values, schema: spark.createDataFrame(values, schema)
    same = lambda a, b: compare_frames(a, b).equal
    assert same(rows([(math.nan,), (0.0,), (None,)], "a double"), rows([(None,), (-0.0,), (math.nan,)], "b double"))
    assert same(rows([(0.1 + 0.2,)], "a double"), rows([(0.3,)], "a double"))
    assert same(rows([(1e300,), (math.inf,)], "a double"), rows([(math.inf,), (1e300,)], "a double"))
    assert same(spark.sql("SELECT CAST(5 AS DECIMAL(10,2)) x"), spark.sql("SELECT 5 y"))
    assert same(spark.sql("SELECT map('a', 1, 'b', 2) m"), spark.sql("SELECT map('b', 2, 'a', 1) m"))
    assert same(spark.sql("SELECT array(0.1D + 0.2D) a, struct(1D AS x) s"), spark.sql("SELECT array(0.3D) a, struct(1D AS y) s"))
    assert same(spark.sql("SELECT 1 AS a, 2 AS a"), spark.sql("SELECT 1 AS b, 2 AS c"))
    assert not same(rows([(1,), (1,)], "a int"), rows([(1,)], "a int"))
    assert not same(rows([(True,)], "a boolean"), rows([(1,)], "a int"))
    assert multiset(rows([(1, 2.0), (1, 2.0)], "a int, a2 double")).collect()[0].copies == 2
    assert difference(rows([(1,), (2,)], "a int"), rows([(1,), (3,)], "a int")).count() == 2


def test_sample_keeps_foreign_keys(engine, catalog):
    sample, stats = build_sample(engine, catalog, percent=60, max_rows=400, seed=1)
    try:
        assert not stats.problems and stats.rows > 0 and all(n <= 400 for n in stats.counts.values()) and "rows in 7 tables" in stats.describe()
        for key in catalog.foreign_keys:
            assert dangling(sample.spark.table(key.child), sample.spark.table(key.parent), key).count() == 0
        shadow = "WITH orders AS (SELECT 1 AS n) SELECT n FROM orders"
        assert sample.fetch(shadow).rows == [(1,)] and compare(sample, SOURCE, SOURCE).equal
        again, more = build_sample(engine, catalog, percent=60, max_rows=400, seed=1)
        assert more.counts["region"] == stats.counts["region"]
        release(again)
    finally:
        release(sample)


def test_sampling_details(spark):
    parent = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    child = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (2, 2)], "x int, y int")
    kept = with_parents(child, [ForeignKey("c", ("x", "y"), "p", ("a", "b"))], {"p": parent})
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == ["(1, 1)", "(2, 2)", "(None, 1)"]
    numbers = spark.range(2000)
    assert 100 < hashed_sample(numbers, "id", 0.1).count() < 300
    assert hashed_sample(numbers, "id", 0.1).exceptAll(hashed_sample(numbers.orderBy(F.desc("id")), "id", 0.1)).count() == 0


def test_failed_table_is_reported(engine, catalog):
    broken = from_mapping(catalog.columns | {"gone": {"id": "int"}}, catalog.foreign_keys)
    sample, stats = build_sample(engine, broken, percent=50)
    assert "gone" in stats.errors and len(stats.counts) == 7
    release(sample)
