"""SQL dumps: their tables as a catalog, their rows as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from requill.sources.catalog import Catalog, ForeignKey, short_type

#: Lines of a dump that set up its server and say nothing of tables or rows.
_NOISE = re.compile(r"(?i)\s*(?:/\*!.*|--.*|lock\s+tables.*|unlock\s+tables.*|set\s.*|use\s.*|start\s+transaction.*|begin.*|commit.*|pragma\s.*|drop\s+table.*|alter\s+table\s+\S+\s+(?:dis|en)able\s+keys.*)?\Z", re.S)
_TYPE = re.compile(r"(?i)(double\s+precision|character\s+varying|(?:timestamp|time)\s+with(?:out)?\s+time\s+zone|\w+)(\s*\([^)]*\))?")
#: Spark's types of column types in dumps; others are strings.
SPARK_TYPES = {"INT": "int", "SERIAL": "int", "BIGINT": "bigint", "BIGSERIAL": "bigint", "SMALLINT": "smallint", "FLOAT": "float", "DOUBLE": "double", "DOUBLE PRECISION": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp"}


def statements(text: str) -> Iterator[str]:
    """Statements of a script: ends at semicolons outside quotes and comments; comments are dropped."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c in "'\"`":
            j = i + 1
            while j < n and text[j] != c:
                j += 2 if text[j] == "\\" and c == "'" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("--", i):
            i = (text.find("\n", i) + 1) or n
        elif text.startswith("/*", i):
            i = (text.find("*/", i + 2) + 2) if text.find("*/", i + 2) >= 0 else n
        elif c == ";":
            if s := "".join(out).strip():
                yield s
            out, i = [], i + 1
        else:
            out.append(c)
            i += 1
    if s := "".join(out).strip():
        yield s


def clean_dump(text: str) -> list[str]:
    """The statements that make tables and rows."""
    return [s for s in statements(text) if not _NOISE.match(s)]


def _split(body: str) -> list[str]:
    """Parts between commas outside parentheses and quotes."""
    parts, depth, start, mark = [], 0, 0, ""
    i = 0
    while i < len(body):
        c = body[i]
        if mark:
            if c == "\\" and mark == "'":
                i += 1
            elif c == mark:
                mark = ""
        elif c in "'\"`":
            mark = c
        elif c in "(),":
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(body[start:i].strip())
                start = i + 1
        i += 1
    return [p for p in [*parts, body[start:].strip()] if p]


def _name(text: str) -> str:
    return text.strip().split(".")[-1].strip('"`[]')


def _names(text: str) -> tuple[str, ...]:
    return tuple(_name(c) for c in text.split(","))


def from_dump(text: str) -> Catalog:
    """The tables that CREATE TABLE statements describe; key and foreign key columns count as indexed."""
    made = Catalog()

    def refer(child: str, columns: tuple[str, ...], parent: str, target: str | None) -> None:
        key = ForeignKey(child, columns, _name(parent), _names(target) if target else columns)
        if key not in made.foreign_keys:
            made.foreign_keys.append(key)
        made.indexed.setdefault(child, set()).update(columns)

    for s in clean_dump(text):
        head = re.match(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([^\s(]+)\s*\((.*)\)[^)]*\Z", s)
        if not head:
            if m := re.match(r"(?is)create\s+(unique\s+)?index\s+\S*\s*on\s+([^\s(]+)\s*(?:using\s+\w+\s*)?\(([^)]*)\)", s):
                made.indexed.setdefault(_name(m[2]), set()).update(_names(m[3]))
                if m[1]:
                    made.unique.setdefault(_name(m[2]), set()).add(_names(m[3]))
            continue
        table = _name(head[1])
        columns = made.columns.setdefault(table, {})
        for part in _split(head[2]):
            rule = re.sub(r"(?is)\Aconstraint\s+\S+\s+", "", part)
            if m := re.match(r"(?is)(primary\s+key|unique(?:\s+key)?(?:\s+[^\s(]+)?)\s*\(([^)]*)\)", rule):
                listed = _names(m[2])
                if m[1].lower().startswith("primary"):
                    made.primary[table] = listed
                    made.not_null.setdefault(table, set()).update(listed)
                else:
                    made.unique.setdefault(table, set()).add(listed)
                made.indexed.setdefault(table, set()).update(listed)
            elif m := re.match(r"(?is)foreign\s+key\s*\(([^)]*)\)\s*references\s+([^\s(]+)\s*(?:\(([^)]*)\))?", rule):
                refer(table, _names(m[1]), m[2], m[3])
            elif re.match(r"(?is)(?:key|index|check|exclude|fulltext)\b", rule):
                if m := re.match(r"(?is)(?:key|index)\b[^(]*\(([^)]*)\)", rule):
                    made.indexed.setdefault(table, set()).update(_names(m[1]))
            elif m := re.match(r'(?s)("[^"]+"|`[^`]+`|\S+)\s+(.*)', part):
                column, rest = _name(m[1]), m[2]
                kind = _TYPE.match(rest)
                columns[column] = short_type(" ".join(kind[1].split())) if kind else short_type(rest.split()[0])
                if re.search(r"(?i)\bnot\s+null\b|\bprimary\s+key\b", rest):
                    made.not_null.setdefault(table, set()).add(column)
                if re.search(r"(?i)\bprimary\s+key\b", rest):
                    made.primary[table] = (column,)
                    made.indexed.setdefault(table, set()).add(column)
                elif re.search(r"(?i)\bunique\b", rest):
                    made.unique.setdefault(table, set()).add((column,))
                    made.indexed.setdefault(table, set()).add(column)
                if r := re.search(r"(?is)\breferences\s+([^\s(]+)\s*(?:\(([^)]*)\))?", rest):
                    refer(table, (column,), r[1], r[2])
    return made


def load_order(catalog: Catalog) -> list[str]:
    return catalog.order_for_sampling()


def _value(text: str) -> str | None:
    if text.lower() in ("null", "default"):
        return None
    if text[:1] == "'":
        body = text[1:-1].replace("''", "'")
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), body)
    return text


def inserted(text: str) -> Iterator[tuple[str, tuple[str, ...] | None, list[str | None]]]:
    """(table, columns or None, values) of each row that INSERT statements name, over as many lines as they take."""
    for s in clean_dump(text):
        if m := re.match(r"(?is)insert\s+(?:or\s+\w+\s+|ignore\s+)?into\s+([^\s(]+)\s*(?:\(([^)]*)\)\s*)?values\s*(.*)\Z", s):
            for row in _split(m[3]):
                yield _name(m[1]), _names(m[2]) if m[2] else None, [_value(v) for v in _split(row.strip()[1:-1])]


# -- dumps of any size: every worker reads blocks of lines

#: What a line may begin within: nothing, a quoted text or name, a block comment.
_MARKS = ("", "'", '"', "`", "*")
_OPENS = re.compile(r"--|/\*|['\"`;]")
_ENDS = {"'": re.compile(r"(?:[^'\\]|\\.)*+'", re.S), '"': re.compile(r'[^"]*"'), "`": re.compile(r"[^`]*`"), "*": re.compile(r".*?\*/", re.S)}
_LAST = 2**62
_PARTS = "file string, block long, seq long, idx long, kind string, name string, columns array<string>, items array<string>, text string"


def _scan(line: str, mark: str) -> tuple[str, list[int]]:
    """What a line that begins within ``mark`` ends within, and where statements end in it."""
    ends, i = [], 0
    while m := _ENDS[mark].match(line, i) if mark else _OPENS.search(line, i):
        if mark:
            mark = ""
        elif m[0] == "--":
            break
        elif m[0] == ";":
            ends.append(m.end())
        else:
            mark = "*" if m[0] == "/*" else m[0]
        i = m.end()
    return mark, ends


def _lines(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int, int], str]]:
    """Lines with their block: file, start, length."""
    for frame in frames:
        yield from zip(zip(frame["file"], frame["block"], frame["size"], strict=True), frame["value"], strict=True)


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, 2000)):
        yield pd.DataFrame(part, columns=names)


def _survey(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block and each mark that it may begin within: the mark at its end, and whether a statement ends in it."""

    def told() -> Iterator[tuple]:
        key, marks, cut = None, [], []
        for at, line in _lines(frames):
            if key != at:
                if key:
                    yield *key, marks, cut
                key, marks, cut = at, list(_MARKS), [False] * len(_MARKS)
            seen = {m: _scan(line, m) for m in set(marks)}
            cut = [c or bool(seen[m][1]) for c, m in zip(cut, marks, strict=True)]
            marks = [seen[m][0] for m in marks]
        if key:
            yield *key, marks, cut

    return _frames(told(), ["file", "block", "size", "marks", "cut"])


def _parsed(file: str, block: int, seq: int, text: str) -> Iterator[tuple]:
    """The rows that an INSERT names; a CREATE statement as it is."""
    for s in clean_dump(text):
        if re.match(r"(?i)create\b", s):
            yield file, block, seq, 0, "ddl", "", None, None, s
        for i, (table, columns, items) in enumerate(inserted(s)):
            yield file, block, seq, i, "row", table, list(columns) if columns else None, items, None


def _cutter(begins: dict[tuple[str, int, int], tuple[str, int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Parses the statements within each block; what a block's ends cut off comes out as pieces of the block that their statement began in."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            key, mark, owner, seq, held = None, "", -1, 0, []
            piece = lambda: (key[0], owner, key[1], 0, "piece", "", None, None, "\n".join(held))
            for at, line in _lines(frames):
                if key != at:
                    if key:
                        yield piece()
                    key, seq, held = at, 0, []
                    mark, owner = begins[key]
                mark, ends = _scan(line, mark)
                for start, end in zip([0, *ends], ends, strict=False):
                    held.append(line[start:end])
                    if seq:
                        yield from _parsed(key[0], key[1], seq, "\n".join(held))
                    else:
                        yield piece()
                    seq, held, owner = seq + 1, [], key[1]
                held.append(line[ends[-1] if ends else 0 :])
            if key:
                yield piece()

        return _frames(found(), [c.split()[0] for c in _PARTS.split(", ")])

    return cut


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Statements that lie in several blocks; they come after the whole ones of the block that they began in."""
    rows = (r for f in frames for file, block, text in zip(f["file"], f["block"], f["text"], strict=True) for r in _parsed(file, block, _LAST, text))
    return _frames(rows, [c.split()[0] for c in _PARTS.split(", ")])


class Loaded(NamedTuple):
    """A dump's catalog and typed tables; by table, rows lost to repeated primary keys and rows that couldn't be loaded, ten of these as examples."""

    catalog: Catalog
    tables: dict[str, DataFrame]
    duplicates: dict[str, int]
    failures: dict[str, int]
    examples: list[str]
    held: DataFrame

    def release(self) -> None:
        """Give back the parsed rows, which the tables are read from."""
        self.held.unpersist()


def _typed(name: str, kind: str) -> Column:
    base = re.sub(r"\(.*", "", kind)
    return F.col(name).try_cast(SPARK_TYPES.get(base, "double" if base in ("NUMERIC", "DECIMAL") else "string"))


def _table(rows: DataFrame, catalog: Catalog, table: str) -> tuple[DataFrame, DataFrame]:
    """A table's rows with whether each can be loaded, and those that stay: the first of each primary key."""
    columns, primary = catalog.columns[table], catalog.primary.get(table, ())
    named = F.col("columns").isNotNull()
    raw = [F.get("items", F.when(named, F.array_position("columns", F.lit(c)) - 1).otherwise(j).cast("int")).alias(f"r{j}") for j, c in enumerate(columns)]
    known = F.size(F.array_except("columns", F.array(*map(F.lit, columns)))) == 0
    fits = F.size("items") == F.when(named, F.size("columns")).otherwise(len(columns))
    base = rows.filter((F.col("kind") == "row") & (F.col("name") == table)).select(F.struct("file", "block", "seq", "idx").alias("place"), "items", (fits & F.when(named, known).otherwise(True)).alias("fits"), *raw)
    typed = base.select("place", "items", "fits", *(f"r{j}" for j in range(len(columns))), *(_typed(f"r{j}", k).alias(f"t{j}") for j, k in enumerate(columns.values())))
    loads = F.col("fits")
    for j, c in enumerate(columns):
        loads &= F.col(f"t{j}").isNotNull() | (F.col(f"r{j}").isNull() if c not in primary else F.lit(False))
    judged = typed.withColumn("loads", loads)
    whole = judged.filter("loads")
    if primary:
        keys = [f"t{j}" for j, c in enumerate(columns) if c in primary]
        rest = F.struct(*(F.col(f"t{j}").alias(f"v{j}") for j in range(len(columns))))
        whole = whole.groupBy(*keys).agg(F.min_by(rest, "place").alias("first")).select(*(F.col(f"first.v{j}").alias(f"t{j}") for j in range(len(columns))))
    return judged, whole.select(*(F.col(f"t{j}").alias(c) for j, c in enumerate(columns)))


def _load(lines: DataFrame) -> Loaded:
    surveyed = lines.mapInPandas(_survey, "file string, block long, size long, marks array<string>, cut array<boolean>").collect()
    begins, last = {}, None
    for r in sorted(surveyed, key=lambda r: (r.file, r.block)):
        if last != r.file:
            last, mark, owner = r.file, "", -1
        begins[r.file, r.block, r.size] = mark, owner
        i = _MARKS.index(mark)
        mark, owner = r.marks[i], r.block if r.cut[i] else owner
    held = lines.mapInPandas(_cutter(begins), _PARTS).persist(StorageLevel.DISK_ONLY)
    pieces = F.array_sort(F.collect_list(F.struct("seq", "text")))
    across = held.filter("kind = 'piece'").groupBy("file", "block").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    rows = held.filter("kind <> 'piece'").unionByName(across.mapInPandas(_merged, _PARTS))
    ddl = [r.text for r in rows.filter("kind = 'ddl'").select("file", "block", "seq", "text").orderBy("file", "block", "seq").collect()]
    catalog = from_dump(";\n".join(ddl))
    tables, duplicates, examples = {}, {}, []
    failures = {r.name: r.n for r in rows.filter((F.col("kind") == "row") & ~F.col("name").isin(list(catalog.columns))).groupBy("name").agg(F.count("*").alias("n")).collect()}
    for table in load_order(catalog):
        judged, tables[table] = _table(rows, catalog, table)
        total, loads = judged.agg(F.count("*"), F.count_if("loads")).first()
        duplicates[table], failures[table] = loads - tables[table].count() if catalog.primary.get(table) else 0, total - loads
        if failures[table] and len(examples) < 10:
            examples += [f"{table}: {r.shown}" for r in judged.filter("NOT loads").orderBy("place").limit(10 - len(examples)).select(F.substring(F.to_json("items"), 1, 110).alias("shown")).collect()]
    return Loaded(catalog, tables, duplicates, failures, examples, held)


def load_file(spark: SparkSession, path: str) -> Loaded:
    """The tables of a dump file, or of each file of a folder, read by all workers.

    Blocks of lines are first surveyed for the quotes and comments open at their
    ends, as a semicolon ends a statement only outside of those; one row for each
    block reaches the driver. Then each block is parsed by itself, and statements
    across blocks are put together. A worker holds one statement at a time. If
    the file is cut otherwise when it is read again, as the cluster grew or
    shrank in between, the load fails with a KeyError and must be repeated.

    Rows with too few or too many values, an unknown column, a value that its
    column's type can't hold, or a null in the primary key are counted as
    failures and left out. Of repeated primary keys the first in the file stays.
    NOT NULL outside the key and foreign keys aren't enforced, defaults not filled in.
    """
    return _load(spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("size")))


def load_dump(spark: SparkSession, text: str) -> tuple[Catalog, dict[str, DataFrame], dict[str, int]]:
    """``load_file`` for a text: catalog, tables, and how many rows each lost to repeated primary keys."""
    lines = spark.createDataFrame([(line, "", 0, 0) for line in text.split("\n")], "value string, file string, block long, size long").coalesce(1)
    return _load(lines)[:3]


def write_tables(tables: dict[str, DataFrame], folder: str, catalog: Catalog) -> None:
    """Parquet in place of a loaded database, each table sorted within its files by its foreign keys for narrow scans."""
    for name, rows in tables.items():
        keys = [c for k in catalog.foreign_keys if k.child == name for c in k.child_columns]
        (rows.sortWithinPartitions(*dict.fromkeys(keys)) if keys else rows).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
