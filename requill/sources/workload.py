"""Workloads: queries with ids and descriptions from .sql files, and what a workload.json adds."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

#: A header line, and all up to the next one.
_BLOCK = re.compile(r"^[ \t]*--[ \t]*([A-Za-z]+\d\w*)[ \t]*:[ \t]*(.*?)[ \t]*$\n?(.*?)(?=^[ \t]*--[ \t]*[A-Za-z]+\d\w*[ \t]*:|\Z)", re.M | re.S)
#: Lines that say nothing to Spark, and the first line that ends in a semicolon with all after it.
_ASIDE, _END = re.compile(r"^[ \t]*(?:--|```).*$\n?", re.M), re.compile(r";[ \t]*$.*", re.M | re.S)


@dataclass(frozen=True)
class Query:
    qid: str
    sql: str
    description: str = ""


@dataclass(frozen=True)
class Workload:
    queries: tuple[Query, ...] = ()
    name: str = ""
    path: str = ""
    engine: str = "spark"
    schema: str = ""
    dsn: str = ""
    hints: str = ""
    tags: tuple[str, ...] = field(default=())

    def limit(self, n: int | None) -> Workload:
        return self if n is None else replace(self, queries=self.queries[:n])

    def only(self, ids: list[str] | None) -> Workload:
        wanted = {i.lower() for i in ids or ()}
        return self if not wanted else replace(self, queries=tuple(q for q in self.queries if q.qid.lower() in wanted))


def parse_sql(text: str) -> tuple[Query, ...]:
    """Queries under headers ``-- Q1: what it asks``; full-line comments and fences are left out, text before a header too."""
    blocks = ((qid, _END.sub("", _ASIDE.sub("", body)).strip(), told) for qid, told, body in _BLOCK.findall(text.replace("\r\n", "\n")))
    return tuple(Query(*b) for b in blocks if b[1])


def load(path: str | Path) -> Workload:
    """A workload from a .sql file, or from a folder with .sql files and perhaps a workload.json."""
    path = Path(path)
    files = sorted(path.glob("*.sql")) if path.is_dir() else [path]
    if not files or not files[0].exists():
        raise FileNotFoundError(f"no .sql file in {path}")
    queries = tuple(q for f in files for q in parse_sql(f.read_text(encoding="utf-8")))
    settings = (path if path.is_dir() else path.parent) / "workload.json"
    known = json.loads(settings.read_text(encoding="utf-8")) if settings.exists() else {}
    given = {k: tuple(v) if k == "tags" else v for k, v in known.items() if k in ("name", "engine", "schema", "dsn", "hints", "tags")}
    return Workload(queries, **({"name": path.stem} | given), path=str(path))


def discover(root: str | Path) -> list[Workload]:
    """All folders below a root that hold .sql files, by name."""
    return [load(p) for p in sorted({f.parent for f in Path(root).rglob("*.sql")})]


def format_sql(queries: list[Query]) -> str:
    return "\n".join(f"-- {q.qid}: {q.description}\n{q.sql.rstrip().rstrip(';')};\n" for q in queries)
