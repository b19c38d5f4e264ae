"""Running statements on Spark: fetch, timing, plan facts, samples."""

from __future__ import annotations

import re
import statistics
import threading
import time
import uuid
from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from requill.plans.catalyst import message
from requill.plans.guard import check_statement, query

ERROR_TEXT, PLAN_TEXT = 300, 4000


class Page(NamedTuple):
    """The first rows of a result, and whether there are more."""

    columns: list[str]
    rows: list[tuple]
    more: bool


class Timing(NamedTuple):
    """Median milliseconds of full runs, or what went wrong."""

    median_ms: float
    runs: int
    error: str = ""

    @property
    def ok(self) -> bool:
        return not self.error


class PlanFacts(NamedTuple):
    """What Spark did in a run: tables scanned, those without a filter that could skip files, joins, reads of the table read most, and the plan."""

    execution_ms: float
    scans: list[str]
    unfiltered_scans: list[str]
    joins: list[str]
    max_loops: int
    text: str


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Engine:
    """A Spark session over temporary views of Parquet tables."""

    name = "spark"

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: list[str] | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.tables: list[str] = []
        for name in tables or []:
            self.register(name, spark.read.parquet(f"{folder}/{name}.parquet"))

    def register(self, name: str, rows: DataFrame) -> None:
        """Make rows of this engine's own session known under a name."""
        rows.createOrReplaceTempView(name)
        if name not in self.tables:
            self.tables.append(name)

    def ref(self, schema: str | None, table: str) -> str:
        return f"{quote(schema)}.{quote(table)}" if schema else quote(table)

    def check_statement(self, sql: str) -> None:
        check_statement(self.spark, sql)

    def query(self, sql: str) -> DataFrame:
        return query(self.spark, sql)

    def fetch(self, sql: str, limit: int = 1000) -> Page:
        """At most ``limit`` rows; one more is asked for, to tell whether there are more."""
        df = self.query(sql)
        rows = [tuple(r) for r in df.limit(limit + 1).collect()]
        return Page(df.columns, rows[:limit], len(rows) > limit)

    def drain(self, df: DataFrame, budget_ms: float = 0.0, keep_plan: bool = False) -> float:
        """Milliseconds to compute all rows; beyond a budget the jobs are cancelled and TimeoutError raised.

        With ``keep_plan`` the frame's own plan is the one that runs, so that its final adaptive form can be read from it.
        """
        tag = f"requill-{uuid.uuid4().hex}"
        sc = self.spark.sparkContext
        late = threading.Event()
        timer = None
        sc.addJobTag(tag)
        if budget_ms:
            timer = threading.Timer(budget_ms / 1000, lambda: (late.set(), sc.cancelJobsWithTag(tag)))
            timer.daemon = True
            timer.start()
        began = time.perf_counter()
        try:
            if keep_plan:
                df._jdf.queryExecution().toRdd().count()
            else:
                df.write.format("noop").mode("overwrite").save()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"over the budget of {budget_ms:g} ms") from None
            raise e
        finally:
            if timer:
                timer.cancel()
            sc.removeJobTag(tag)
        return (time.perf_counter() - began) * 1000

    def measure(self, sql: str, runs: int = 5, budget_ms: float = 0.0) -> Timing:
        """Median time of full runs; the first of several only warms up. Any failure gives a Timing with its error."""
        self.check_statement(sql)
        try:
            df = self.query(sql)
            took = [self.drain(df, budget_ms) for _ in range(max(1, runs))]
        except Exception as e:
            return Timing(0.0, runs, message(e, ERROR_TEXT) or type(e).__name__)
        return Timing(statistics.median(took[1:] if runs > 1 else took), runs)

    def explain(self, sql: str) -> PlanFacts:
        """Run a query and read the plan that ran, as adaptive execution left it: scans, pushed filters, join strategies."""
        df = self.query(sql)
        took = self.drain(df, keep_plan=True)
        text = df._jdf.queryExecution().executedPlan().toString()
        # The initial plan follows the final one in the text.
        final = text.split("+- == Initial Plan ==")[0]
        reads: Counter[str] = Counter()
        bare: dict[str, None] = {}
        for m in re.finditer(r"FileScan \S+ .*?Location: [^\[]*\[([^\]]*)\], PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", final):
            name = m[1].rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
            reads[name] += 1
            if not m[2] and not re.sub(r"IsNotNull\([^)]*\)[, ]*", "", m[3]):
                bare[name] = None
        joins = re.findall(r"\b((?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)\w*)\b", final)
        return PlanFacts(took, list(reads), list(bare), joins, max(reads.values(), default=1), text[:PLAN_TEXT])

    def sample_source(self, table: str, percent: float, seed: int = 7) -> DataFrame:
        """A Bernoulli sample that a seed repeats."""
        return self.spark.table(quote(table)).sample(max(percent, 0.0001) / 100, seed)

    def catalog_topics(self, declared: dict | None = None) -> dict[str, DataFrame]:
        """Columns, row counts, keys, foreign keys and indexed columns as relations; the last three are as declared, since Parquet has none."""
        declared = declared or {}
        columns = [(t, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", i) for t in self.tables for i, f in enumerate(self.spark.table(quote(t)).schema)]
        listed = lambda x: (x,) if isinstance(x, str) else tuple(x)
        keys = [(t, "primary", "PRIMARY KEY", c) for t, cs in declared.get("primary", {}).items() for c in listed(cs)]
        keys += [(t, f"unique_{i}", "UNIQUE", c) for t, us in declared.get("unique", {}).items() for i, u in enumerate(us) for c in listed(u)]
        foreign = [(a, f"{a}_{p}_{i}", x, p, y) for i, (a, xs, p, ys) in enumerate(declared.get("foreign_keys", ())) for x, y in zip(listed(xs), listed(ys), strict=True)]
        indexed = [(t, c) for t, cs in declared.get("indexed", {}).items() for c in cs]
        counts = [self.spark.table(quote(t)).selectExpr(f"'{t}' AS table_name", "count(*) AS n_rows") for t in self.tables]
        frame = self.spark.createDataFrame
        return {
            "columns": frame(columns, "table_name string, column_name string, type string, nullable string, position int"),
            "keys": frame(keys, "table_name string, constraint_name string, kind string, column_name string"),
            "foreign_keys": frame(foreign, "child_table string, constraint_name string, child_column string, parent_table string, parent_column string"),
            "indexed_columns": frame(indexed, "table_name string, column_name string"),
            "row_counts": reduce(DataFrame.unionByName, counts) if counts else frame([], "table_name string, n_rows long"),
        }

    def isolated(self) -> Engine:
        """An engine of a session of its own: its views are seen by no other."""
        return Engine(self.spark.newSession(), self.folder)


ALIASES = {"spark": Engine, "sparksql": Engine, "parquet": Engine}


def get_engine(name: str) -> type[Engine]:
    try:
        return ALIASES[name.lower()]
    except KeyError:
        raise KeyError(f"unknown engine {name!r}; known: {', '.join(sorted(ALIASES))}") from None
