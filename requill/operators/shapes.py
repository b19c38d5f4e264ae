"""The workload's query shapes over the star schema, in their rewritten form, with the nested SQL they replace.

The SQL runs on any engine with ANSI subqueries and is the independent check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Lazy access to the Parquet tables of one folder; Catalyst prunes columns and pushes filters."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Shape:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str


SHAPES: dict[str, Shape] = {}


def shape(sql: str):
    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        SHAPES[build.__name__] = Shape(build.__name__, build, " ".join(sql.split()))
        return build

    return add


def _year(column: str):
    return F.year(column).cast("long")


LINE = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@shape("""SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE l.l_quantity > (SELECT avg(l2.l_quantity) FROM lineitem l2 JOIN orders o2 ON l2.l_orderkey = o2.o_orderkey WHERE year(o2.o_orderdate) = year(o.o_orderdate))""")
def n01_above_year_average(t: Tables) -> DataFrame:
    lines = t.lineitem.select(*LINE).join(t.orders.select("o_orderkey", _year("o_orderdate").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))
    mean = lines.groupBy("y").agg(F.avg("l_quantity").alias("mean"))
    return lines.join(mean, "y").where("l_quantity > mean").select(*LINE)


@shape("""SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l1 WHERE l1.l_orderkey = o.o_orderkey
    AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_partkey = l1.l_partkey AND l2.l_orderkey <> o.o_orderkey))""")
def n02_shared_part(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    spread = lines.groupBy("l_partkey").agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high")).where("low <> high")
    shared = lines.join(spread, "l_partkey", "left_semi")
    return t.orders.select("o_orderkey").join(shared, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@shape("""SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c
    WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) per_customer)""")
def n03_busy_customers(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    mean = counts.agg(F.avg("n_orders").alias("mean"))
    busy = counts.join(F.broadcast(mean), F.col("n_orders") > F.col("mean"))
    return t.customer.select("c_custkey").join(busy, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "n_orders")


@shape("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def n04_not_in(t: Tables) -> DataFrame:
    keys = t.lineitem.select("l_orderkey").where("l_orderkey IS NOT NULL")
    return t.orders.select("o_orderkey", "o_custkey").where("o_orderkey IS NOT NULL").join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@shape("""SELECT o.o_custkey, o.o_orderkey, o.o_totalprice FROM orders o
    WHERE o.o_totalprice = (SELECT max(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)""")
def n05_largest_order(t: Tables) -> DataFrame:
    best = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice").join(best, ["o_custkey", "o_totalprice"], "left_semi")


@shape("""SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey IN
    (SELECT c2.c_nationkey FROM customer c2 JOIN nation n ON c2.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
     WHERE r.r_name ILIKE '%asia%' AND c2.c_custkey <> o.o_custkey)""")
def n06_region_neighbours(t: Tables) -> DataFrame:
    nations = t.nation.join(t.region.where(F.col("r_name").ilike("%asia%")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey")
    customers = t.customer.select("c_custkey", "c_nationkey")
    several = customers.groupBy("c_nationkey").agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")).where("a <> b").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    chosen = customers.join(several, "c_nationkey", "left_semi")
    return t.orders.select("o_orderkey", "o_custkey").join(chosen, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")


@shape("SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def n07_without_lines(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@shape("""SELECT c.c_custkey, c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
    AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW')""")
def n08_both_priorities(t: Tables) -> DataFrame:
    wanted = ["1-URGENT", "5-LOW"]
    both = t.orders.where(F.col("o_orderpriority").isin(wanted)).groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).where("n = 2")
    return t.customer.select("c_custkey", "c_name").join(both, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@shape("""SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
    WHERE l.l_orderkey = o.o_orderkey AND p.p_size <= 10)""")
def n09_no_small_part(t: Tables) -> DataFrame:
    small = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.where("p_size <= 10").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return t.orders.select("o_orderkey").join(small, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@shape("""SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_totalprice >
    (SELECT percentile_cont(0.75) WITHIN GROUP (ORDER BY o2.o_totalprice) FROM orders o2 WHERE year(o2.o_orderdate) = year(o.o_orderdate))""")
def n10_upper_quartile(t: Tables) -> DataFrame:
    """Exact quartiles without a year's totals in one buffer: a sketch brackets the rank, and only what lies between is sorted."""
    orders = t.orders.select("o_orderkey", "o_totalprice", _year("o_orderdate").alias("y"))
    # The sketch's ranks are off by a ten-thousandth at most; small years are taken whole.
    sketch = F.percentile_approx("o_totalprice", F.array(F.lit(0.749), F.lit(0.751)), F.lit(10_000))
    years = orders.groupBy("y").agg(F.count("o_totalprice").alias("n"), sketch.alias("s"))
    years = years.select("y", (F.col("n") - 1).alias("last"), F.when(F.col("n") >= 10_000, F.col("s")[0]).alias("low"), F.when(F.col("n") >= 10_000, F.col("s")[1]).alias("high"))
    placed = orders.where("o_totalprice IS NOT NULL").join(years, "y")
    below = placed.groupBy("y").agg(F.count_if(F.col("o_totalprice") < F.col("low")).alias("below"))
    near = placed.where("low IS NULL OR o_totalprice BETWEEN low AND high").join(below, "y")
    rank = F.col("below") + F.row_number().over(Window.partitionBy("y").orderBy("o_totalprice")) - 1
    at = 0.75 * F.col("last")
    ends = near.select("y", "o_totalprice", (at - F.floor(at)).alias("part"), (rank - F.floor(at)).alias("d")).where("d IN (0, 1)").groupBy("y")
    ends = ends.agg(F.max("part").alias("part"), F.max(F.when(F.col("d") == 0, F.col("o_totalprice"))).alias("a"), F.max(F.when(F.col("d") == 1, F.col("o_totalprice"))).alias("b"))
    quartile = ends.select("y", (F.col("a") + F.col("part") * (F.coalesce("b", "a") - F.col("a"))).alias("q"))
    return orders.join(quartile, "y").where("o_totalprice > q").select("o_orderkey", "o_totalprice")


@shape("""SELECT o.o_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_lines FROM orders o
    WHERE (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) per_order)""")
def n11_long_orders(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    mean = counts.agg(F.avg("n_lines").alias("mean"))
    long = counts.join(F.broadcast(mean), F.col("n_lines") > F.col("mean"))
    return t.orders.select("o_orderkey").join(long, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n_lines")


@shape("""SELECT DISTINCT o.o_orderkey, s.s_suppkey FROM orders o, supplier s WHERE o.o_orderpriority = '1-URGENT' AND s.s_suppkey IN (SELECT l2.l_suppkey FROM lineitem l2 WHERE l2.l_orderkey <> o.o_orderkey
    AND l2.l_quantity > 45 AND l2.l_partkey IN (SELECT l1.l_partkey FROM lineitem l1 WHERE l1.l_orderkey = o.o_orderkey))""")
def n12_reachable_suppliers(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    offers = lines.where("l_quantity > 45").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))
    asked = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey").join(lines.select("l_orderkey", "l_partkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey")
    met = asked.join(offers, "l_partkey").where("low <> o_orderkey OR high <> o_orderkey")
    known = met.join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return known.select("o_orderkey", "s_suppkey").distinct()


@shape("""SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
    WHERE p.p_retailprice > (SELECT avg(p2.p_retailprice) FROM part p2 WHERE p2.p_brand = p.p_brand)""")
def n13_above_brand_average(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", "p_brand", "p_retailprice")
    mean = parts.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"))
    dear = parts.join(mean, "p_brand").where("p_retailprice > mean").select("p_partkey")
    return t.lineitem.select(*LINE).join(dear, F.col("l_partkey") == F.col("p_partkey")).select(*LINE)


@shape("""SELECT o.o_orderkey FROM orders o WHERE (SELECT count(*) FROM orders a WHERE year(a.o_orderdate) = year(o.o_orderdate)) >
    (SELECT count(*) FROM orders b WHERE year(b.o_orderdate) = year(o.o_orderdate) - 1)
    AND EXISTS (SELECT 1 FROM orders b WHERE year(b.o_orderdate) = year(o.o_orderdate) - 1)""")
def n14_growing_years(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", _year("o_orderdate").alias("y"))
    years = orders.groupBy("y").agg(F.count("*").alias("n"))
    before = years.select((F.col("y") + 1).alias("y"), F.col("n").alias("n_before"))
    return orders.join(years.join(before, "y").where("n > n_before"), "y").select("o_orderkey")


@shape("""SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE
    (SELECT count(*) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_totalprice > o.o_totalprice) >= 3""")
def n15_beyond_top_three(t: Tables) -> DataFrame:
    rank = F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_totalprice")))
    return t.orders.where("o_custkey IS NOT NULL AND o_totalprice IS NOT NULL").select("o_orderkey", "o_custkey", rank.alias("r")).where("r > 3").drop("r")


@shape("""SELECT CAST(floor(year(o_orderdate) / 5.0) * 5 AS BIGINT) AS half_decade, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders
    WHERE o_orderdate IS NOT NULL GROUP BY CAST(floor(year(o_orderdate) / 5.0) * 5 AS BIGINT)""")
def m01_half_decades(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate IS NOT NULL").groupBy((F.floor(_year("o_orderdate") / 5) * 5).alias("half_decade")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


@shape("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 40
    ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_partkey, l_linenumber LIMIT 10""")
def m02_top_lines(t: Tables) -> DataFrame:
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]
    return t.lineitem.where("l_quantity > 40").select(*columns).orderBy(F.desc_nulls_last("l_extendedprice"), *columns[:3]).limit(10)


@shape("SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6")
def m03_many_lines(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).where("n_lines > 6")


@shape("""SELECT DISTINCT c.c_custkey, s.s_suppkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE s.s_nationkey = c.c_nationkey""")
def m04_home_trade(t: Tables) -> DataFrame:
    customers = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return customers.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).select("c_custkey", "s_suppkey").distinct()


@shape("SELECT l_orderkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_orderkey")
def m05_distinct_counts(t: Tables) -> DataFrame:
    # Sets of an order's few lines; two distinct counts would double the rows before the shuffle.
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    return t.lineitem.groupBy("l_orderkey").agg(distinct("l_partkey").alias("n_parts"), distinct("l_suppkey").alias("n_suppliers"))


@shape("""SELECT p.p_size, p.p_partkey, p.p_retailprice FROM part p WHERE p.p_size BETWEEN 10 AND 20
    AND p.p_retailprice = (SELECT max(p2.p_retailprice) FROM part p2 WHERE p2.p_size = p.p_size)""")
def m06_priciest_by_size(t: Tables) -> DataFrame:
    # Eleven sizes: their extremes are found by partial aggregates, where a window would sort each size whole.
    parts = t.part.where(F.col("p_size").between(10, 20)).select("p_size", "p_partkey", "p_retailprice")
    best = parts.groupBy("p_size").agg(F.max("p_retailprice").alias("p_retailprice"))
    return parts.join(best, ["p_size", "p_retailprice"], "left_semi")


@shape("""SELECT c.c_custkey, c.c_name, count(*) AS n_orders FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
    GROUP BY c.c_custkey, c.c_name ORDER BY n_orders DESC, c.c_custkey LIMIT 25""")
def m07_top_customers(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return t.customer.select("c_custkey", "c_name").join(counts, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "n_orders").orderBy(F.desc("n_orders"), "c_custkey").limit(25)


@shape("""WITH yearly AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, avg(o_totalprice) AS mean_price FROM orders
    WHERE o_orderdate IS NOT NULL GROUP BY CAST(year(o_orderdate) AS BIGINT)) SELECT y, n, round(mean_price, 2) AS mean_price FROM yearly WHERE n >= 100""")
def m08_full_years(t: Tables) -> DataFrame:
    yearly = t.orders.where("o_orderdate IS NOT NULL").groupBy(_year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))
    return yearly.where("n >= 100").select("y", "n", F.round("mean_price", 2).alias("mean_price"))


@shape("""SELECT nc.n_name AS buyer, ns.n_name AS seller, count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation nc ON nc.n_nationkey = c.c_nationkey JOIN nation ns ON ns.n_nationkey = s.s_nationkey
    WHERE nc.n_nationkey <> ns.n_nationkey GROUP BY nc.n_name, ns.n_name HAVING count(*) > 3""")
def m09_trading_nations(t: Tables) -> DataFrame:
    buyers = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    # Lines are counted by nation keys before the names are joined to the few pairs left.
    pairs = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("k"))
    buyer = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer"))
    seller = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller"))
    return pairs.join(buyer, "c_nationkey").join(seller, "s_nationkey").groupBy("buyer", "seller").agg(F.sum("k").alias("n")).where("n > 3")


@shape("""SELECT o.o_orderkey, o.o_totalprice FROM orders o CROSS JOIN (SELECT avg(o_totalprice) AS mean FROM orders) m
    WHERE o.o_totalprice < m.mean ORDER BY o.o_totalprice, o.o_orderkey LIMIT 100""")
def m10_cheap_orders(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_totalprice")
    mean = orders.agg(F.avg("o_totalprice").alias("mean"))
    return orders.join(F.broadcast(mean), F.col("o_totalprice") < F.col("mean")).select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(100)


@shape("""SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
    CAST(sum(CASE WHEN o_totalprice < 150000 THEN 1 ELSE 0 END) AS BIGINT) AS n_low FROM orders GROUP BY CAST(year(o_orderdate) AS BIGINT)""")
def m11_high_and_low(t: Tables) -> DataFrame:
    high = F.sum(F.when(F.col("o_totalprice") >= 150000, 1).otherwise(0)).alias("n_high")
    low = F.sum(F.when(F.col("o_totalprice") < 150000, 1).otherwise(0)).alias("n_low")
    return t.orders.groupBy(_year("o_orderdate").alias("y")).agg(high, low)


@shape("""SELECT o.o_orderkey FROM orders o WHERE o.o_custkey NOT IN
    (SELECT u.o_custkey FROM orders u WHERE u.o_orderpriority = '1-URGENT' AND u.o_custkey IS NOT NULL)""")
def m12_never_urgent(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL").select(F.col("o_custkey").alias("u"))
    return t.orders.select("o_orderkey", "o_custkey").where("o_custkey IS NOT NULL").join(urgent, F.col("o_custkey") == F.col("u"), "left_anti").select("o_orderkey")
