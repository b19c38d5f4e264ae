"""The registered queries of the workbench and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requill import evidence
from requill.functions.values import multiset
from requill.operators.equivalence import difference
from requill.operators.ranking import by_strategy, ranked, summary
from requill.operators.sampling import dangling, hashed_sample, with_parents
from requill.operators.shapes import SHAPES, Tables
from requill.sources.catalog import STAR, ForeignKey, fan_in_counts

Query = Callable[[SparkSession, str], DataFrame]
KEYS = {f"{k.child}_{k.parent}": k for k in map(ForeignKey.of, STAR["foreign_keys"])}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Orders above their customer's average total: the average grouped first, then joined."""
    orders = Tables(spark, folder).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    mean = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return orders.join(mean, "o_custkey").where("o_totalprice > mean").select("o_orderkey", "o_custkey", "o_totalprice")


FLAGSHIP = "SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o WHERE o.o_totalprice > (SELECT avg(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)"


def catalog_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    t, found = Tables(spark, folder), None
    for name in TABLES:
        one = getattr(t, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        found = one if found is None else found.unionByName(one)
    return found


def catalog_fan_in(spark: SparkSession, folder: str) -> DataFrame:
    t, found = Tables(spark, folder), None
    for name, key in KEYS.items():
        one = fan_in_counts(getattr(t, key.child), getattr(t, key.parent)).select(F.lit(name).alias("edge"), "child_rows", "parent_rows", F.round("fan_in", 6).alias("fan_in"))
        found = one if found is None else found.unionByName(one)
    label = F.when(F.col("fan_in") >= 20, "many-to-one").when(F.col("fan_in") >= 1.5, "one-to-many").when(F.col("fan_in") < 1, "close to unique").otherwise("roughly one-to-one")
    return found.withColumn("label", label)


FAN_IN = " UNION ALL ".join(
    f"SELECT '{n}' AS edge, (SELECT count(*) FROM {k.child}) AS child_rows, (SELECT count(*) FROM {k.parent}) AS parent_rows" for n, k in KEYS.items()
)


def catalog_unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    """For each declared primary key: rows and distinct keys."""
    t, found = Tables(spark, folder), None
    for table, key in STAR["primary"].items():
        one = getattr(t, table).agg(F.lit(table).alias("table_name"), F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))
        found = one if found is None else found.unionByName(one)
    return found


def catalog_dangling(spark: SparkSession, folder: str) -> DataFrame:
    """For each foreign key: rows without their parent."""
    t, found = Tables(spark, folder), None
    for name, key in KEYS.items():
        one = dangling(getattr(t, key.child), getattr(t, key.parent), key).agg(F.lit(name).alias("edge"), F.count("*").alias("n_dangling"))
        found = one if found is None else found.unionByName(one)
    return found


DANGLING = " UNION ALL ".join(
    f"SELECT '{n}' AS edge, count(*) AS n_dangling FROM {k.child} c WHERE c.{k.child_columns[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {k.parent} p WHERE p.{k.parent_columns[0]} = c.{k.child_columns[0]})"
    for n, k in KEYS.items()
)


def sample_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The hashed sample of a tenth of the orders; sampling is what this query shows."""
    return hashed_sample(Tables(spark, folder).orders, "o_orderkey", 0.1).select("o_orderkey", "o_custkey", "o_totalprice")


def sample_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by table of a sample that starts at a third of the customers, parts and suppliers and keeps every foreign key."""
    t = Tables(spark, folder)
    parents = {"customer": hashed_sample(t.customer, "c_custkey", 1 / 3), "part": hashed_sample(t.part, "p_partkey", 1 / 3), "supplier": hashed_sample(t.supplier, "s_suppkey", 1 / 3)}
    parents["orders"] = with_parents(t.orders, [KEYS["orders_customer"]], parents)
    parents["lineitem"] = with_parents(t.lineitem, [k for k in KEYS.values() if k.child == "lineitem"], parents)
    found = None
    for name, rows in parents.items():
        one = rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        found = one if found is None else found.unionByName(one)
    return found


CLOSED = """WITH c AS (SELECT * FROM customer WHERE substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4) < '5555'), p AS (SELECT * FROM part WHERE substr(md5(CAST(p_partkey AS VARCHAR)), 1, 4) < '5555'),
s AS (SELECT * FROM supplier WHERE substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 4) < '5555'), o AS (SELECT * FROM orders WHERE o_custkey IS NULL OR o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT * FROM lineitem WHERE (l_orderkey IS NULL OR l_orderkey IN (SELECT o_orderkey FROM o)) AND (l_partkey IS NULL OR l_partkey IN (SELECT p_partkey FROM p)) AND (l_suppkey IS NULL OR l_suppkey IN (SELECT s_suppkey FROM s)))
SELECT 'customer' AS table_name, count(*) AS n_rows FROM c UNION ALL SELECT 'part', count(*) FROM p UNION ALL SELECT 'supplier', count(*) FROM s UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l"""


def multiset_events(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of each (event_type, value rounded to 0.1), nulls included."""
    rows = Tables(spark, folder).events.select("event_type", F.round("value", 1).alias("value"))
    return multiset(rows).select(F.col("c0").alias("event_type"), F.col("c1").alias("value"), "copies")


def difference_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of (returnflag, linestatus, quantity) before and from line number 3 on, where they differ."""
    lines = Tables(spark, folder).lineitem
    columns = ["l_returnflag", "l_linestatus", "l_quantity"]
    diff = difference(lines.where("l_linenumber < 3").select(*columns), lines.where("l_linenumber >= 3").select(*columns))
    return diff.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "copies_left", "copies_right")


DIFFERENCE = """SELECT l_returnflag, l_linestatus, l_quantity, copies_left, copies_right FROM (SELECT l_returnflag, l_linestatus, l_quantity,
count(*) FILTER (WHERE l_linenumber < 3) AS copies_left, count(*) FILTER (WHERE l_linenumber >= 3) AS copies_right FROM lineitem GROUP BY ALL) WHERE copies_left <> copies_right"""


def arrays_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings that occur more than once, compared as normal forms of arrays."""
    return multiset(Tables(spark, folder).embeddings.select("embedding")).groupBy("copies").agg(F.count("*").alias("n"))


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as measurements: a customer is a query, an order a candidate, its total the time; status and key say how it fared."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return Tables(spark, folder).orders.select(
        F.col("o_custkey").cast("string").alias("qid"), F.col("o_orderpriority").alias("strategy"), key.cast("string").alias("label"), F.lit(150000.0).alias("baseline_ms"), price.alias("median_ms"),
        (key % 100).cast("double").alias("generation_ms"), (150000.0 / price).alias("speedup"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("equivalent"),
        F.when(key % 10 == 0, "failed").otherwise("").alias("error"),
    )


_M = """m AS (SELECT CAST(o_custkey AS VARCHAR) AS qid, o_orderpriority AS strategy, CAST(o_orderkey AS VARCHAR) AS label, o_totalprice AS median_ms, CAST(o_orderkey % 100 AS DOUBLE) AS generation_ms,
150000.0 / o_totalprice AS speedup, CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS equivalent, CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE '' END AS error FROM orders)"""


def rank_measurements(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(_measured(spark, folder)).select("qid", "label", "median_ms", F.col("place").cast("long").alias("place"))


def rank_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary(_measured(spark, folder))


def rank_strategies(spark: SparkSession, folder: str) -> DataFrame:
    return by_strategy(_measured(spark, folder))


_D = lambda x: f"CAST({x} AS DOUBLE)"
_RIGHT = "error = '' AND coalesce(equivalent, false)"
ORACLES = {
    "flagship_above_own_average": FLAGSHIP,
    "catalog_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
    "catalog_fan_in": f"SELECT edge, child_rows, parent_rows, round(child_rows / greatest(parent_rows, 1), 6) AS fan_in, CASE WHEN child_rows / greatest(parent_rows, 1) >= 20 THEN 'many-to-one' WHEN child_rows / greatest(parent_rows, 1) >= 1.5 THEN 'one-to-many' WHEN child_rows / greatest(parent_rows, 1) < 1 THEN 'close to unique' ELSE 'roughly one-to-one' END AS label FROM ({FAN_IN})",
    "catalog_unique_keys": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t}" for t, k in STAR["primary"].items()),
    "catalog_dangling": DANGLING,
    "sample_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) < '199a'",
    "sample_closed": CLOSED,
    "multiset_events": "SELECT event_type, round(value, 1) AS value, count(*) AS copies FROM events GROUP BY event_type, round(value, 1)",
    "difference_of_lines": DIFFERENCE,
    "arrays_equal": "SELECT copies, count(*) AS n FROM (SELECT count(*) AS copies FROM embeddings GROUP BY embedding) GROUP BY copies",
    "rank_measurements": f"WITH {_M} SELECT qid, label, {_D('median_ms')} AS median_ms, row_number() OVER (PARTITION BY qid ORDER BY median_ms, label) AS place FROM m WHERE error = '' AND coalesce(equivalent, true)",
    "rank_summary": f"WITH {_M} SELECT count(DISTINCT qid) AS queries, count(*) FILTER (WHERE error = '') AS timed, count(*) FILTER (WHERE {_RIGHT}) AS correct, count(*) FILTER (WHERE {_RIGHT} AND speedup > 1.05) AS faster, round({_D('quantile_cont(speedup, 0.5) FILTER (WHERE ' + _RIGHT + ')')}, 3) AS median_speedup, round({_D('max(speedup) FILTER (WHERE ' + _RIGHT + ')')}, 3) AS best_speedup FROM m",
    "rank_strategies": f"WITH {_M}, r AS (SELECT *, {_D('median_ms')} AS ms, {_D('speedup')} AS sp FROM m) SELECT strategy, count(DISTINCT qid) AS queries, count(*) AS candidates, count(*) FILTER (WHERE error = '') AS valid, count(*) FILTER (WHERE {_RIGHT}) AS equal, round(avg(ms) FILTER (WHERE {_RIGHT}), 3) AS avg_ms, round(quantile_cont(ms, 0.5) FILTER (WHERE {_RIGHT}), 3) AS median_ms, round(avg(sp) FILTER (WHERE {_RIGHT}), 3) AS avg_speedup, round(quantile_cont(sp, 0.5) FILTER (WHERE {_RIGHT}), 3) AS median_speedup, round(max(sp) FILTER (WHERE {_RIGHT}), 3) AS best_speedup, round(avg({_D('generation_ms')}), 3) AS avg_generation_ms FROM r GROUP BY strategy",
}
OWN = {
    "flagship_above_own_average": flagship, "catalog_row_counts": catalog_row_counts, "catalog_fan_in": catalog_fan_in, "catalog_unique_keys": catalog_unique_keys, "catalog_dangling": catalog_dangling,
    "sample_orders": sample_orders, "sample_closed": sample_closed, "multiset_events": multiset_events, "difference_of_lines": difference_of_lines, "arrays_equal": arrays_equal,
    "rank_measurements": rank_measurements, "rank_summary": rank_summary, "rank_strategies": rank_strategies,
}


def queries() -> dict[str, Query]:
    return OWN | evidence.QUERIES | {name: (lambda spark, folder, s=s: s.build(Tables(spark, folder))) for name, s in SHAPES.items()}


def oracle_sql() -> dict[str, str]:
    return ORACLES | evidence.ORACLES | {name: s.sql for name, s in SHAPES.items()}
