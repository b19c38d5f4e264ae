"""The one place that reaches into Catalyst's plans over py4j."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def seq(scala: Any) -> list:
    """A Scala sequence or set as a list."""
    it = scala.iterator()
    out = []
    while it.hasNext():
        out.append(it.next())
    return out


def kind(node: Any) -> str:
    return node.getClass().getSimpleName()


def message(error: Exception, limit: int = 240) -> str:
    """The first line of an error of Spark's, without what follows it."""
    text = error.getMessage() if isinstance(error, PySparkException) and error.getMessage() else str(error.java_exception.getMessage()) if isinstance(error, Py4JJavaError) else str(error)
    return " ".join(text.split())[:limit]


def parse(spark: SparkSession, sql: str) -> Any:
    """The unresolved plan of one statement; nothing runs."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def analyzed(df: DataFrame) -> Any:
    return df._jdf.queryExecution().analyzed()


def optimized(df: DataFrame) -> Any:
    return df._jdf.queryExecution().optimizedPlan()


def expressions(node: Any) -> list:
    return seq(node.expressions())


def within(expression: Any) -> Iterator[Any]:
    """An expression and all below it."""
    yield expression
    for child in seq(expression.children()):
        yield from within(child)


def below(plan: Any, subqueries: bool = True) -> Iterator[Any]:
    """All plan nodes of a tree, with the plans of subquery expressions and of common table expressions."""
    yield plan
    for child in seq(plan.children()):
        yield from below(child, subqueries)
    for _, inner in cte_relations(plan):
        yield from below(inner, subqueries)
    if subqueries:
        for expression in expressions(plan):
            for e in within(expression):
                if inner := subquery_plan(e):
                    yield from below(inner, subqueries)


def subquery_plan(expression: Any) -> Any | None:
    """The plan inside a subquery expression; IN keeps it in a ListQuery below it."""
    return expression.plan() if kind(expression) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression") else None


def cte_relations(plan: Any) -> list[tuple[str, Any]]:
    """(name, plan) of the common table expressions that a parsed WITH defines, or (id, plan) of resolved ones."""
    if kind(plan) == "UnresolvedWith":
        return [(pair._1(), pair._2()) for pair in seq(plan.cteRelations())]
    if kind(plan) == "WithCTE":
        return [(str(d.id()), d.child()) for d in seq(plan.cteDefs())]
    return []


def any_node(plan: Any, test: Callable[[Any], bool]) -> bool:
    return any(test(n) for n in below(plan))


def same_result(a: DataFrame, b: DataFrame) -> bool:
    """Whether both come to the same optimized plan but for names and ids."""
    return bool(optimized(a).sameResult(optimized(b)))


def table_names(plan: Any) -> set[str]:
    """Tables that a parsed plan names, without its common table expressions where they are in scope."""
    found: set[str] = set()

    def walk(node: Any, hidden: frozenset) -> None:
        inner = hidden
        if kind(node) == "UnresolvedWith":
            for name, sub in cte_relations(node):
                walk(sub, inner)
                inner |= {name.lower()}
        if kind(node) == "UnresolvedRelation":
            parts = seq(node.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in inner:
                found.add(parts[-1].lower())
        for child in seq(node.children()):
            walk(child, inner)
        for expression in expressions(node):
            for e in within(expression):
                if sub := subquery_plan(e):
                    walk(sub, inner)

    walk(plan, frozenset())
    return found


def outer_references(df: DataFrame) -> list[str]:
    """Names of columns of an enclosing query that subqueries of an analyzed plan refer to, sorted."""
    found = set()
    for node in below(analyzed(df)):
        for expression in expressions(node):
            for e in within(expression):
                if kind(e) == "OuterReference":
                    found.add(e.name())
    return sorted(found)
