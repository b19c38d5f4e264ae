"""Only single read-only queries pass: parsed by Spark, then every node is on a list of those that only read."""

from __future__ import annotations

import re
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from requill.plans.catalyst import below, expressions, kind, message, parse, seq, within


class StatementRejected(RuntimeError):
    """Not one statement that only reads."""


class QueryFailed(RuntimeError):
    """Spark can't analyse or run a statement that only reads."""


#: Parsed nodes that only read. Commands, scripts and writes have nodes of their own, which are not listed.
READING = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join Union Except Intersect SubqueryAlias OneRowRelation LocalRelation "
    "UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedSubqueryColumnAliases ResolvedInlineTable "
    "WithWindowDefinition Window Sample Pivot UnresolvedPivot UnresolvedUnpivot Unpivot LateralJoin Generate UnresolvedHint Range Tail RelationTimeTravel View".split()
)
#: Built-in functions of Spark's group for all that fits no other; of these only the ones that depend on their arguments alone.
HARMLESS = frozenset("typeof bitmap_bit_position bitmap_bucket_number bitmap_count equal_null".split())
_COMMENT = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/|\()*", re.S)


def _function_name(e: Any) -> str:
    return ".".join(seq(e.nameParts())).lower() if kind(e) == "UnresolvedFunction" else ""


def _refused_function(spark: SparkSession, name: str) -> bool:
    """Whether a function isn't one of Spark's own, or is of the group that reaches outside the data, fails on purpose or tells of the session."""
    jvm = spark.sparkContext._jvm
    if "." in name:
        return True
    registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    found = registry.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return found.isEmpty() or found.get().getGroup() == "misc_funcs" and name not in HARMLESS


def _refused_relation(spark: SparkSession, parts: list[str]) -> str:
    """Why a table's name is refused: only views and the catalog's tables are there to be read, no paths, whatever the format."""
    if len(parts) > 2:
        return "a table outside the catalog"
    if len(parts) == 2 and not (spark.catalog.databaseExists(parts[0]) and spark.catalog.tableExists(parts[1], parts[0])):
        return "a path is not a table"
    return ""


def check_statement(spark: SparkSession, sql: str) -> Any:
    """The parsed plan of a permitted statement; otherwise StatementRejected with the reason."""
    start = sql[_COMMENT.match(sql).end() :]
    if not start:
        raise StatementRejected("empty statement")
    try:
        plan = parse(spark, sql)
    except (PySparkException, Py4JJavaError) as e:
        raise StatementRejected(f"not one parsable statement: {message(e)}") from None
    if not re.match(r"(?i)(select|with)\b", start):
        raise StatementRejected("a statement must start with SELECT or WITH")
    functions: set[str] = set()
    for node in below(plan):
        name = kind(node)
        if name not in READING:
            raise StatementRejected(f"not a read-only query: {name}")
        if name == "UnresolvedRelation" and (why := _refused_relation(spark, seq(node.multipartIdentifier()))):
            raise StatementRejected(why)
        functions |= {_function_name(e) for expression in expressions(node) for e in within(expression)}
    for name in sorted(functions - {""}):
        if _refused_function(spark, name):
            raise StatementRejected(f"function {name} is not permitted")
    return plan


def query(spark: SparkSession, sql: str) -> DataFrame:
    """The analyzed query of a permitted statement; it has not run yet."""
    check_statement(spark, sql)
    try:
        return spark.sql(sql.rstrip().rstrip(";"))
    except (PySparkException, Py4JJavaError) as e:
        raise QueryFailed(message(e)) from None
