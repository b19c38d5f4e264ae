"""What a model is told, by strategy."""

from __future__ import annotations

from dataclasses import dataclass

from requill.rules import TACTICS

CONTRACT = """Task: another form of the SQL between the marks, for Spark, over Parquet files.
Your statement is analysed first. It is refused if it
 - is anything but one SELECT (or WITH ... SELECT), or names what the schema hasn't;
 - has a subquery that refers to a row outside of it;
 - joins a grouped or derived relation by columns that don't determine its rows;
 - turns a test for absence into NOT IN;
 - lacks the DISTINCT, ORDER BY or LIMIT of the original;
 - compares a key only after a cast or function of it.
Then both statements run, and a single row too many or too few, or columns in another order, refutes yours.
What is left competes by its time. End the statement with a semicolon."""
QUESTIONS = """No SQL yet. Name every part of this query that is computed once per row though once per key would do, the key, and how a null
in it behaves. Say which table is the largest and what could make it smaller before anything is joined to it."""


@dataclass(frozen=True)
class Strategy:
    """Prompts of one way to ask. ``plans`` tells whether a plan is asked for first."""

    name: str
    plans: bool = False
    preface: str = ""

    def plan(self, schema: str, sql: str) -> str:
        return f"{schema}\n\n<query>\n{sql}\n</query>\n\n{QUESTIONS}"

    def write(self, schema: str, sql: str, plan: str = "", tactic: str = "") -> str:
        parts = [schema, self.preface, f"Plan:\n{plan}" if plan else "", f"Use this tactic [{tactic}]: {TACTICS[tactic]}." if tactic else "", f"<query>\n{sql}\n</query>", "Write the rewritten query."]
        return "\n\n".join(p for p in parts if p)

    def repair(self, schema: str, sql: str, candidate: str, problems: tuple[str, ...]) -> str:
        listed = "\n".join(f"- {p}" for p in problems)
        return f"{schema}\n\nThis rewrite was refused:\n{candidate}\n\nReasons:\n{listed}\n\n<query>\n{sql}\n</query>\n\nWrite another that has none of these faults."


EXAMPLE = """Example. From
SELECT a.id FROM a WHERE a.x > (SELECT avg(b.x) FROM b WHERE b.k = a.k);
to
WITH g AS (SELECT k, avg(x) AS m FROM b GROUP BY k) SELECT a.id FROM a JOIN g ON g.k = a.k WHERE a.x > g.m;"""
STRATEGIES = {
    s.name: s
    for s in (
        Strategy("existing", plans=True),
        Strategy("zero-shot"),
        Strategy("one-shot", preface=EXAMPLE),
        Strategy("reasoning", preface="Think in steps under the heading ANALYSIS, then give the statement under the heading SQL."),
    )
}


def get_strategy(name: str) -> Strategy:
    try:
        return STRATEGIES[name]
    except KeyError:
        raise KeyError(f"unknown strategy {name!r}; known: {', '.join(STRATEGIES)}") from None
