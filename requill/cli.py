"""Command line: show, catalog, verify, rewrite, compare, load."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from requill.models import parse_model
from requill.operators.equivalence import compare
from requill.operators.ranking import compare_strategies, measure_query, render_table, save_json
from requill.operators.sampling import build_sample
from requill.plans.gates import check
from requill.rewriter import Rewriter
from requill.session import session
from requill.sources.catalog import STAR, Catalog, introspect
from requill.sources.engine import Engine
from requill.sources.ingest import from_dump, load_file, write_tables
from requill.sources.workload import Query, format_sql, load
from requill.strategies import STRATEGIES


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="requill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, data: bool = True) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=text)
        if data:
            one.add_argument("--data", required=name != "show", help="folder of Parquet tables")
            one.add_argument("--keys", help="JSON file with declared keys; without it those of the star schema")
        return one

    show = add("show", "print the schema a query is about")
    show.add_argument("--sql")
    show.add_argument("--workload")
    show.add_argument("--dump")
    show.add_argument("--scope", type=int, default=8)
    add("catalog", "print the catalog as JSON")
    verify = add("verify", "compare two statements; exits with 0 only if they are equal")
    verify.add_argument("original")
    verify.add_argument("candidate")
    verify.add_argument("--sample", type=float, default=0.0, help="percent; 0 compares whole tables")
    verify.add_argument("--limit", type=int)
    verify.add_argument("--gates", action="store_true")
    rewrite = add("rewrite", "rewrite, verify, time and rank a workload")
    rewrite.add_argument("workload")
    rewrite.add_argument("--model", default="rules")
    rewrite.add_argument("--strategy", default="existing", choices=list(STRATEGIES))
    rewrite.add_argument("--variants", type=int, default=3)
    rewrite.add_argument("--attempts", type=int, default=2, help="turns a candidate gets, the first included")
    rewrite.add_argument("--runs", type=int, default=5)
    rewrite.add_argument("--sample", type=float, default=0.0)
    rewrite.add_argument("--max-rows", type=int, default=200_000)
    rewrite.add_argument("--limit", type=int, help="queries")
    rewrite.add_argument("--only", nargs="*")
    rewrite.add_argument("--budget-ms", type=float, default=0.0)
    rewrite.add_argument("--out", default=".")
    compared = add("compare", "compare strategies over saved reports", data=False)
    compared.add_argument("reports", nargs="+")
    loaded = add("load", "turn a SQL dump into Parquet tables", data=False)
    loaded.add_argument("dump")
    loaded.add_argument("--out", required=True)
    return parser


def _open(args: argparse.Namespace) -> tuple[Engine, Catalog]:
    spark = session()
    folder = Path(args.data)
    engine = Engine(spark, str(folder), sorted(p.name.removesuffix(".parquet") for p in folder.glob("*.parquet")))
    declared = json.loads(Path(args.keys).read_text()) if args.keys else STAR
    return engine, introspect(engine, declared)


def render_rewrites(reports: list, descriptions: dict[str, str]) -> str:
    """The best verified candidate of each query in workload form; a comment for a query without one."""
    parts = []
    for r in reports:
        best = next((c for c in r.ranked if c.equivalent), None)
        parts.append(format_sql([Query(r.qid, best.sql, descriptions.get(r.qid, ""))]) if best else f"-- {r.qid} FAILED: no candidate was proved equal\n")
    return "\n".join(parts)


def run_rewrite(args: argparse.Namespace) -> int:
    work = load(args.workload).only(args.only).limit(args.limit)
    model = parse_model(args.model)
    engine, catalog = _open(args)
    sample = None
    if args.sample:
        sample, stats = build_sample(engine, catalog, args.sample, args.max_rows)
        print(stats.describe())
        sample = sample if stats.rows else None
    rewriter = Rewriter(engine, catalog, model, args.strategy, args.variants, args.attempts)
    reports = [measure_query(engine, rewriter.rewrite(q.qid, q.sql, q.description), catalog, sample, args.runs, args.budget_ms) for q in work.queries]
    print(render_table(reports))
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    save_json(reports, out / "report.json")
    (out / "rewrites.sql").write_text(render_rewrites(reports, {q.qid: q.description for q in work.queries}), encoding="utf-8")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "show":
        if args.dump:
            catalog, spark = from_dump(Path(args.dump).read_text(encoding="utf-8")), session()
        else:
            engine, catalog = _open(args)
            spark = engine.spark
        for sql in [args.sql] if args.sql else [q.sql for q in load(args.workload).queries] if args.workload else [""]:
            print(catalog.render(spark, sql, args.scope) if sql else catalog.ddl())
    elif args.command == "catalog":
        print(json.dumps(_open(args)[1].to_json(), indent=2))
    elif args.command == "verify":
        engine, catalog = _open(args)
        if args.gates and not (verdict := check(engine, args.original, args.candidate, catalog)).ok:
            print("\n".join(verdict.problems))
            return 1
        target = build_sample(engine, catalog, args.sample)[0] if args.sample else engine
        found = compare(target, args.original, args.candidate, args.limit)
        print(found.describe())
        return 0 if found.equal else 1
    elif args.command == "rewrite":
        return run_rewrite(args)
    elif args.command == "compare":
        compare_strategies(session(), args.reports).show(truncate=False)
    elif args.command == "load":
        found = load_file(session(), args.dump)
        write_tables(found.tables, args.out, found.catalog)
        print(json.dumps({"tables": sorted(found.tables), "repeated_keys": found.duplicates, "failures": found.failures, "examples": found.examples}))
        found.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
