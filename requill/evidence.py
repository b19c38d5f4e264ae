"""Registered queries that show what the workbench's parts say: verdicts, facts and results as relations.

Statements are fixed; what they are judged by, run on or compared over are the
tables of the folder, whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requill.functions.replies import extract_sql
from requill.models import cheaper, parse_model
from requill.operators.equivalence import compare
from requill.operators.sampling import build_sample, release
from requill.plans.gates import check, sargability_problems, static_problems, structural_problems
from requill.plans.guard import StatementRejected, check_statement
from requill.rewriter import Rewriter
from requill.rules import RULES, rewrite
from requill.sources.catalog import STAR, Catalog, from_rows, introspect, short_type
from requill.sources.engine import Engine
from requill.sources.ingest import from_dump, load_dump, load_order
from requill.sources.workload import parse_sql
from requill.strategies import STRATEGIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL that gives the rows expected of a query over no table."""
    literal = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def evident(oracle: str):
    """Registers a query under its function's name, with the SQL that says what it must give."""

    def keep(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[build.__name__] = build
        ORACLES[build.__name__] = oracle
        return build

    return keep


def _engine(spark: SparkSession, folder: str) -> Engine:
    return Engine(spark.newSession(), folder, TABLES)


def _known(engine: Engine) -> Catalog:
    """The star schema's catalog without its row counts, which would take a scan."""
    return introspect(engine, STAR | {"indexed": {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"]}}, counts=False)


# -- the guard

PERMITTED = ["SELECT 1", "WITH a AS (SELECT * FROM region) SELECT count(*) FROM a", "-- note\nSELECT r_name FROM region ORDER BY 1 LIMIT 2", "SELECT * FROM nation TABLESAMPLE (10 PERCENT)"]
REFUSED = [
    "", "DROP TABLE region", "INSERT INTO region VALUES (1, 'x')", "SELECT 1; SELECT 2", "CREATE TABLE t AS SELECT 1", "SET a = 1", "SHOW TABLES", "TABLE region", "SELECT r_name FROM region WHERE (",
    "SELECT * FROM parquet.`/x`", "SELECT * FROM xml.`/x`", "SELECT * FROM a.b.c", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT assert_true(false)", "SELECT TRANSFORM (r_name) USING 'cat' FROM region",
]


@evident(_values("statement, permitted", [(s, True) for s in PERMITTED] + [(s, False) for s in REFUSED]))
def guard_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)

    def permitted(sql: str) -> bool:
        try:
            check_statement(engine.spark, sql)
        except StatementRejected:
            return False
        return True

    return spark.createDataFrame([(s, permitted(s)) for s in PERMITTED + REFUSED], "statement string, permitted boolean")


# -- the gates

_ABOVE = "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT avg(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)"
_G = "WITH g AS (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT o.o_orderkey FROM orders o JOIN g ON {} WHERE o.o_totalprice > g.m"
_SORTED = "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 5"
_ABSENT = "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"
#: (source, candidate, the gate that refuses it or nothing)
GATED = [
    (_ABOVE, _G.format("g.k = o.o_custkey"), ""), (_ABOVE, _G.format("g.k = g.k"), "fan-out"), (_ABOVE, _G.format("CAST(g.k AS smallint) = o.o_custkey"), "fan-out"), (_ABOVE, _G.format("g.k % 5 = o.o_custkey"), "fan-out"),
    (_ABOVE, _G.format("g.m = o.o_totalprice"), "fan-out"), (_ABOVE, _G.format("g.k = o.o_custkey AND g.m > 0"), ""), (_ABOVE, _ABOVE, "correlated"), (_ABOVE, "SELECT o_orderkey FROM nowhere", "static"), (_ABOVE, "SELECT nope FROM orders", "static"),
    (_ABOVE, "DELETE FROM orders", "static"), (_SORTED, _SORTED, ""), (_SORTED, "SELECT o_custkey FROM orders ORDER BY o_custkey LIMIT 5", "dropped"), (_SORTED, "SELECT DISTINCT o_custkey FROM orders LIMIT 5", "dropped"),
    (_SORTED, "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey", "dropped"), (_ABSENT, "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", "not-in"),
    (_ABSENT, "SELECT o_orderkey FROM orders o LEFT ANTI JOIN lineitem l ON l.l_orderkey = o.o_orderkey", ""), ("SELECT 1 FROM orders WHERE o_orderkey = 5", "SELECT 1 FROM orders WHERE abs(o_orderkey) = 5", "sargability"),
    ("SELECT 1 FROM orders", "SELECT 1 FROM orders o JOIN (SELECT DISTINCT o_custkey AS k FROM orders) d ON d.k = o.o_custkey", ""), ("SELECT 1 FROM orders", "SELECT 1 FROM orders o JOIN (SELECT l_orderkey AS k FROM lineitem) d ON d.k = o.o_orderkey", "fan-out"),
    ("SELECT 1 FROM orders", "SELECT 1 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey", ""),
]
_SIGNS = {"correlated": "correlated reference", "fan-out": "may multiply rows", "not-in": "NOT IN", "dropped": "of the source is gone"}


@evident(_values("place, refused_by, passes", [(i, g, not g) for i, (_, _, g) in enumerate(GATED)]))
def gate_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    catalog = _known(engine)

    def refused_by(source: str, candidate: str) -> str:
        if static_problems(engine, candidate, catalog):
            return "static"
        found = " ".join(structural_problems(engine, source, candidate, catalog))
        by_sign = next((g for g, sign in _SIGNS.items() if sign in found), "")
        return by_sign or ("sargability" if sargability_problems(engine.query(candidate), catalog) else "")

    rows = [(i, refused_by(s, c), check(engine, s, c, catalog).ok) for i, (s, c, _) in enumerate(GATED)]
    return spark.createDataFrame(rows, "place int, refused_by string, passes boolean")


# -- comparison

PAIRS = {
    "same": ("SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE o_orderkey = o_orderkey"),
    "fewer": ("SELECT o_custkey FROM orders", "SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F'"),
    "more": ("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey FROM orders"),
    "copies": ("SELECT o_orderstatus FROM orders", "SELECT DISTINCT o_orderstatus FROM orders"),
    "reordered": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY 1", "SELECT o_orderkey, o_custkey FROM orders ORDER BY 2"),
}
_GAP = "SELECT '{0}' AS pair, CASE WHEN n_missing + n_extra = 0 THEN 'equal' ELSE 'different' END AS status, n_missing, n_extra FROM (SELECT (SELECT count(*) FROM (({1}) EXCEPT ALL ({2}))) AS n_missing, (SELECT count(*) FROM (({2}) EXCEPT ALL ({1}))) AS n_extra)"


@evident(" UNION ALL ".join(_GAP.format(n, a, b) for n, (a, b) in PAIRS.items()))
def compared_statements(spark: SparkSession, folder: str) -> DataFrame:
    engine, rows = _engine(spark, folder), []
    for name, pair in PAIRS.items():
        found = compare(engine, *pair)
        rows.append((name, found.status, found.n_missing, found.n_extra))
    return spark.createDataFrame(rows, "pair string, status string, n_missing long, n_extra long")


# -- rules, the rewriter, and plans

RULED = {
    "preaggregate": _ABOVE,
    "window": "SELECT o.o_custkey, o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)",
    "anti-join": "SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 10)",
    "semi-join": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "pushdown": "SELECT t.o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders) t WHERE t.o_custkey > 50",
    "filter-first": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 100 AND o.o_totalprice > c.c_acctbal",
}


@evident(" UNION ALL ".join(f"SELECT '{t}' AS tactic, true AS rewritten, 'equal' AS status, count(*) AS n_rows FROM ({q})" for t, q in RULED.items()))
def rules_hold(spark: SparkSession, folder: str) -> DataFrame:
    """Each rule's rewrite of a statement, compared with it over the whole tables."""
    engine, rows = _engine(spark, folder), []
    for tactic in RULES:
        made = rewrite(RULED[tactic], tactic)
        found = compare(engine, RULED[tactic], made)
        rows.append((tactic, made not in ("", RULED[tactic]), found.status, found.rows if found.rows >= 0 else engine.query(made).count()))
    return spark.createDataFrame(rows, "tactic string, rewritten boolean, status string, n_rows long")


@evident(f"SELECT 'rules' AS model, 1 AS accepted, count(*) AS n_rows FROM ({RULED['window']}) UNION ALL " + _values("model, accepted, n_rows", [("echo/SELECT nope FROM orders;", 0, 0)]))
def rewriter_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """One statement through models, gates and repair: candidates accepted, and rows of the first."""
    engine, rows = _engine(spark, folder), []
    catalog = _known(engine)
    for spec in ("rules", "echo/SELECT nope FROM orders;"):
        result = Rewriter(engine, catalog, parse_model(spec), "zero-shot", variants=1, attempts=2).rewrite("Q1", RULED["window"])
        rows.append((spec, len(result.accepted), engine.query(result.accepted[0].sql).count() if result.accepted else 0))
    return spark.createDataFrame(rows, "model string, accepted int, n_rows long")


@evident(_values("query, max_loops, scans, unfiltered, joined", [("join", 1, "customer,orders", "orders", True), ("twice", 2, "orders", "", True), ("one", 1, "region", "region", False)]))
def plan_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What the final plans of three statements say of scans, pushed filters and joins."""
    engine = _engine(spark, folder)
    asked = {
        "join": "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0",
        "twice": "SELECT a.o_orderkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_custkey WHERE a.o_totalprice > 5 AND b.o_totalprice > 6",
        "one": "SELECT r_name FROM region",
    }
    facts = {name: engine.explain(sql) for name, sql in asked.items()}
    rows = [(n, f.max_loops, ",".join(sorted(f.scans)), ",".join(sorted(f.unfiltered_scans)), bool(f.joins)) for n, f in facts.items()]
    return spark.createDataFrame(rows, "query string, max_loops int, scans string, unfiltered string, joined boolean")


# -- the catalog

_COLUMNS = "SELECT table_name, column_name, CAST(ordinal_position - 1 AS INTEGER) AS position FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"


@evident(_COLUMNS)
def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = _engine(spark, folder).catalog_topics()["columns"].select("table_name", "column_name", "position")
    return spark.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)


_KEYS = [("key", t, c, "") for t, c in STAR["primary"].items()] + [("foreign", a, x, f"{b}.{y}") for a, x, b, y in STAR["foreign_keys"]] + [("indexed", "orders", "o_orderkey", "")]


@evident(_values("topic, table_name, column_name, parent", _KEYS))
def catalog_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Declared keys through the topics' relations and back into a catalog."""
    topics = _engine(spark, folder).catalog_topics(STAR | {"indexed": {"orders": ["o_orderkey"]}})
    made = from_rows({name: [r.asDict() for r in topics[name].collect()] for name in ("columns", "keys", "foreign_keys", "indexed_columns")})
    rows = [("key", t, c, "") for t, cs in made.primary.items() for c in cs]
    rows += [("foreign", k.child, c, f"{k.parent}.{p}") for k in made.foreign_keys for c, p in zip(k.child_columns, k.parent_columns, strict=True)]
    rows += [("indexed", t, c, "") for t, cs in made.indexed.items() for c in cs]
    return spark.createDataFrame(rows, "topic string, table_name string, column_name string, parent string")


FACTS = [
    ("parents", "lineitem", "orders,part,supplier"), ("children", "nation", "customer,supplier"), ("neighbours", "orders", "customer,lineitem"), ("order", "", "part,region,nation,customer,supplier,orders,lineitem"),
    ("scope", "orders", "orders,customer,lineitem"), ("scope", "", "customer,lineitem,nation"), ("tables in", "WITH orders AS (SELECT * FROM nation) SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM part)", "nation,part"),
    ("tables in", "no sql", ""), ("type", "character varying", "TEXT"), ("type", "double precision", "DOUBLE PRECISION"), ("type", "decimal(5,2)", "DECIMAL(5,2)"), ("type", "user-defined", ""),
    ("ddl", "region", "CREATE TABLE region (|  r_regionkey INT, -- PRIMARY KEY|  r_name STRING -- nullable|);"), ("edges", "nation,region", "nation(n_regionkey) -> region(r_regionkey) [NO INDEX] fan-in unknown"),
    ("effort", "high", "high,medium,low"), ("effort", "odd", "medium,low"), ("reply", "Sure.\n```sql\nSELECT 1;\n```", "SELECT 1"), ("reply", "nothing here", ""), ("strategies", "", "existing,one-shot,reasoning,zero-shot"),
]


@evident(_values("topic, subject, value", FACTS))
def catalog_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Graph, scope, text and prompts' parts, each asked of the tables' own catalog."""
    engine = _engine(spark, folder)
    c = _known(engine)
    c.indexed = {}
    listed = ",".join
    answer = {
        "parents": lambda x: listed(c.parents_of(x)), "children": lambda x: listed(c.children_of(x)), "neighbours": lambda x: listed(c.neighbours(x)), "order": lambda x: listed(c.order_for_sampling()),
        "scope": lambda x: listed(c.scope({x} - {""}, 3)), "tables in": lambda x: listed(sorted(c.tables_in(engine.spark, x))), "type": short_type, "ddl": lambda x: c.ddl([x]).replace("\n", "|"), "edges": lambda x: c.edges(x.split(",")),
        "effort": lambda x: listed(cheaper(x)), "reply": extract_sql, "strategies": lambda x: listed(sorted(STRATEGIES)),
    }
    return spark.createDataFrame([(topic, subject, answer[topic](subject)) for topic, subject, _ in FACTS], "topic string, subject string, value string")


# -- samples, dumps and workloads


@evident(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def sample_of_all(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by table of a sample at 100 %: every foreign key of the whole tables is followed, and nothing may be lost."""
    engine = _engine(spark, folder)
    sample, stats = build_sample(engine, _known(engine), percent=100.0, max_rows=2**31 - 1)
    release(sample)
    return spark.createDataFrame(list(stats.counts.items()), "table_name string, n_rows long")


DUMP = """-- two tables
CREATE TABLE ratings (movie_id INT REFERENCES movies(id), rating double precision, note varchar(20));
CREATE TABLE movies (id integer NOT NULL, title text, year numeric(4,0), PRIMARY KEY (id));
INSERT INTO movies VALUES (1, 'It''s; a (test)', 1999), (2, NULL, 2001);
INSERT INTO ratings VALUES (1, 7.5, 'x'), (2, 3.25, NULL);
"""


@evident(_values("id, title, rating, place", [(1, "It's; a (test)", 7.5, "movies,ratings"), (2, None, 3.25, "movies,ratings")]))
def dump_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A dump's tables, loaded parents first and joined by the key that it declares."""
    _, tables, _ = load_dump(spark, DUMP)
    key = from_dump(DUMP).foreign_keys[0]
    made = tables[key.parent].join(tables[key.child], F.col(key.parent_columns[0]) == F.col(key.child_columns[0]))
    return made.select(F.col("id").cast("int").alias("id"), "title", "rating", F.lit(",".join(load_order(from_dump(DUMP)))).alias("place"))


WORK = "text before\n-- Q1: all regions\nSELECT r_name\n  FROM region;\n-- a comment\n-- Q2: nothing follows\n-- Q3: fenced\n```sql\nSELECT 1\n```\n"


@evident(_values("qid, description, sql", [("Q1", "all regions", "SELECT r_name\n  FROM region"), ("Q3", "fenced", "SELECT 1")]))
def workload_queries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(q.qid, q.description, q.sql) for q in parse_sql(WORK)], "qid string, description string, sql string")


@evident("SELECT 'with nulls' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT CAST(floor(value) AS BIGINT) FROM events) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT CAST(floor(value) AS BIGINT) FROM events WHERE value IS NOT NULL)")
def not_in_and_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """NOT IN as Spark's null-aware anti join: a null in the subquery leaves nothing."""
    engine = Engine(spark.newSession(), folder, ["customer", "events"])
    count = lambda kind, test: f"SELECT '{kind}' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT CAST(floor(value) AS BIGINT) FROM events{test})"
    found = engine.query(f"{count('with nulls', '')} UNION ALL {count('without', ' WHERE value IS NOT NULL')}")
    return spark.createDataFrame([tuple(r) for r in found.collect()], found.schema)
