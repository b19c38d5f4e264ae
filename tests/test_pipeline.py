"""Replies, models, rules, rewriter, ranking, workloads, dumps, command line."""

import json
import urllib.error

import pytest

from requill import cli
from requill.functions.replies import extract_sql, strip_fences
from requill.models import ChatModel, EchoModel, HttpModel, ModelError, Reply, available_models, cheaper, parse_model
from requill.operators.equivalence import Equivalence, compare
from requill.operators.ranking import Measurement, QueryReport, by_strategy, compare_strategies, measure_query, measurements, ranked, render_table, save_json, summary, to_json
from requill.operators.shapes import SHAPES
from requill.plans.gates import check
from requill.rewriter import Candidate, Rewriter, RewriteResult
from requill.rules import TACTICS, conjuncts, rewrite
from requill.sources.catalog import STAR, introspect
from requill.sources.engine import Engine
from requill.sources.ingest import clean_dump, from_dump, inserted, load_dump, load_file, write_tables
from requill.sources.workload import Query, discover, format_sql, load, parse_sql
from requill.strategies import STRATEGIES, get_strategy

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def engine(spark, small):
    return Engine(spark.newSession(), small, TABLES)


@pytest.fixture(scope="module")
def catalog(engine):
    return introspect(engine, STAR)


class Scripted(ChatModel):
    """Answers in turn; keeps what it was asked."""

    name = "scripted"

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def ask(self, system, user, effort, temperature, budget):
        self.asked.append((user, effort, budget))
        answer = self.answers.pop(0) if self.answers else ""
        return Reply(extract_sql(answer), answer, self.name, effort, 5)


def test_sql_of_replies():
    assert extract_sql("Sure.\n```sql\nSELECT 1;\n```") == "SELECT 1"
    assert extract_sql("ANALYSIS\nselect the best\n\nSELECT 1;\nthen\nWITH a AS (SELECT 2)\nSELECT * FROM a;") .startswith("WITH a")
    assert extract_sql("ANALYSIS: x\nSQL\nSELECT a FROM t") == "SELECT a FROM t"
    assert extract_sql("nothing here") == "" and strip_fences("```\nx\n```") == "x"


def test_models(monkeypatch):
    assert cheaper("high") == ("high", "medium", "low") and cheaper("low") == ("low",) and cheaper("odd") == cheaper("medium") == ("medium", "low")
    model = Scripted("", "", "SELECT 1;")
    assert model.chat("s", "u", "high").sql == "SELECT 1" and [a[1] for a in model.asked] == ["high", "medium", "low"]
    with pytest.raises(ModelError):
        Scripted().chat("s", "u", "low")
    assert EchoModel("SELECT 2;").chat("", "").sql == "SELECT 2"
    assert parse_model("rules/window").name == "rules/window" and "rules" in available_models()
    for bad in ("rules/none", "other/x", "echo/"):
        with pytest.raises(ValueError):
            parse_model(bad)
    http, turns = HttpModel("m", tries=3), []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return json.dumps({"message": {"content": "SELECT 3;"}, "eval_count": 9}).encode()

    def serve(request, timeout):
        turns.append(json.loads(request.data))
        if len(turns) == 1:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return Answer()

    monkeypatch.setattr("urllib.request.urlopen", serve)
    monkeypatch.setattr("time.sleep", lambda s: None)
    reply = http.chat("s", "u", "medium", budget=77)
    assert reply.sql == "SELECT 3" and reply.tokens == 9 and turns[0]["options"]["num_predict"] == 77 and len(turns) == 2
    monkeypatch.setattr("urllib.request.urlopen", lambda *a, **k: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "no", {}, None)))
    with pytest.raises(ModelError, match="404"):
        http.chat("s", "u", "low")


RULED = {
    "preaggregate": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT avg(x.o_totalprice) FROM orders x WHERE year(x.o_orderdate) = year(o.o_orderdate)) AND o.o_custkey > 5",
    "window": "SELECT o.o_custkey, o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey) ORDER BY o.o_custkey",
    "anti-join": "SELECT o.o_orderkey FROM orders o WHERE o.o_orderstatus <> 'X' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity BETWEEN 1 AND 40)",
    "semi-join": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "pushdown": "SELECT t.o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000) t WHERE t.o_custkey > 50 AND t.o_orderkey > t.o_custkey",
    "filter-first": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 100 AND o.o_totalprice > c.c_acctbal",
}


@pytest.mark.parametrize("tactic", RULED)
def test_rules_keep_results(engine, catalog, tactic):
    made = rewrite(RULED[tactic], tactic)
    assert made and made != RULED[tactic]
    assert compare(engine, RULED[tactic], made).equal is True
    if tactic != "filter-first":  # a filtered base table keeps its key only as far as the catalog declares one
        assert check(engine, RULED[tactic], made, catalog).ok, check(engine, RULED[tactic], made, catalog).problems


def test_rules_leave_other_forms_alone():
    for sql in ("SELECT 1", "SELECT a FROM t WHERE x > (SELECT count(*) FROM s WHERE s.k = t.k)", "SELECT a FROM t UNION SELECT b FROM s", "SELECT t.a FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.k > t.k)", "SELECT t.a FROM t WHERE t.a = 1 OR EXISTS (SELECT 1 FROM s WHERE s.k = t.k)"):
        assert rewrite(sql) == ""
    assert conjuncts("a = 1 AND b BETWEEN 2 AND 3 AND c = 'x AND y'") == ["a = 1", "b BETWEEN 2 AND 3", "c = 'x AND y'"]


def test_strategies():
    s = get_strategy("existing")
    assert s.plans and "[window]" in s.write("schema", "SELECT 1", "plan", "window") and "- bad" in s.repair("schema", "q", "c", ("bad",))
    assert len({s.write("x", "q") for s in STRATEGIES.values()}) >= 3
    with pytest.raises(KeyError):
        get_strategy("other")


SOURCE = RULED["preaggregate"]
GOOD = "WITH g AS (SELECT year(o_orderdate) y, avg(o_totalprice) m FROM orders GROUP BY year(o_orderdate)) SELECT o.o_orderkey FROM orders o JOIN g ON g.y = year(o.o_orderdate) WHERE o.o_totalprice > g.m AND o.o_custkey > 5;"


def test_rewriter_repairs_and_tells_apart(engine, catalog):
    model = Scripted("a plan", "SELECT nope FROM orders;", GOOD, GOOD.replace("g.m", "g.m "), "")
    result = Rewriter(engine, catalog, model, "existing", variants=3, attempts=2).rewrite("Q1", SOURCE)
    first, second, third = result.candidates
    assert first.accepted and first.attempts == 2 and "nope" in model.asked[2][0] and model.asked[2][1] == "high" and first.tokens == 10
    assert not second.accepted and second.error.startswith("the same") and third.error and result.plan == "a plan" and result.accepted == [first]
    assert len({c.label for c in result.candidates}) == 3
    assert Rewriter(engine, catalog, EchoModel(SOURCE), "zero-shot", 1).rewrite("Q1", SOURCE).candidates[0].verdict.problems

    class Broken(ChatModel):
        def ask(self, *a):
            raise ModelError("down")

    assert Rewriter(engine, catalog, Broken()).rewrite("Q1", SOURCE).error == "down"


def test_measuring(engine, catalog):
    result = RewriteResult("Q1", "SELECT 1", candidates=[Candidate("a", "SELECT 1"), Candidate("b", "SELECT 2"), Candidate("c", "SELECT 3", error="no"), Candidate("d", "SELECT 4")])
    equal = {"SELECT 1": True, "SELECT 2": False, "SELECT 4": None}
    asked = []

    def timer(e, sql, label, runs, strategy="", budget=0.0):
        asked.append(label)
        return Measurement(label, sql, strategy, {"original": 100.0, "a": 20.0, "b": 30.0, "d": 50.0}[label], runs)

    report = measure_query(engine, result, catalog, runs=3, timer=timer, comparer=lambda e, a, b, n: Equivalence(equal[b], "r"))
    assert [c.label for c in report.ranked] == ["a", "d"] and report.best.speedup == 5.0 and asked == ["original", "a", "d"]
    over = measure_query(engine, result, catalog, runs=3, budget_ms=50, timer=timer, comparer=lambda e, a, b, n: Equivalence(True))
    assert "budget" in over.baseline.error and all(c.speedup is None for c in over.candidates if c.label != "b")
    text = render_table([report])
    assert "5.00x" in text and "different" in text and "unknown" in text


def test_reports_as_relations(spark, tmp_path):
    m = lambda label, ms, speed, equal, error="", s="one": Measurement(label, "q", s, ms, 3, error, equal, speed, 10.0)
    reports = [QueryReport("Q1", baseline=m("original", 100.0, None, None), candidates=[m("a", 20.0, 5.0, True), m("b", 50.0, 2.0, None), m("c", 0.0, None, False, "bad")]), QueryReport("Q2", baseline=m("original", 10.0, None, None), candidates=[m("a", 10.0, 1.0, True, s="two")])]
    rows = measurements(spark, reports)
    assert [(r.qid, r.label, r.place) for r in ranked(rows).orderBy("qid", "place").collect()] == [("Q1", "a", 1), ("Q1", "b", 2), ("Q2", "a", 1)]
    s = summary(rows).first()
    assert (s.queries, s.timed, s.correct, s.faster, s.median_speedup, s.best_speedup) == (2, 3, 2, 1, 3.0, 5.0)
    save_json(reports, tmp_path / "r.json")
    assert to_json(reports)["summary"]["best_speedup"] == 5.0
    table = {r.strategy: r for r in compare_strategies(spark, [str(tmp_path / "r.json")]).collect()}
    assert table["one"].queries == 1 and table["one"].candidates == 3 and table["one"].equal == 1 and table["two"].avg_ms == 10.0
    assert by_strategy(rows).count() == 2


WORKLOAD = """text before
-- Q1: first; with a semicolon
-- a comment; here
SELECT 1
FROM t;
```
-- j2: second
SELECT 2
"""


def test_workloads(tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "queries.sql").write_text(WORKLOAD)
    (tmp_path / "w" / "workload.json").write_text(json.dumps({"name": "n", "tags": ["a"], "other": 1}))
    work = load(tmp_path / "w")
    assert [q.qid for q in work.queries] == ["Q1", "j2"] and work.queries[0].sql == "SELECT 1\nFROM t" and work.name == "n" and work.tags == ("a",)
    assert [q.qid for q in work.only(["J2"]).queries] == ["j2"] and len(work.limit(1).queries) == 1 and len(work.only(None).limit(None).queries) == 2
    assert [w.name for w in discover(tmp_path)] == ["n"] and parse_sql(format_sql([Query("Q1", "SELECT 1", "d")])) == (Query("Q1", "SELECT 1", "d"),)
    with pytest.raises(FileNotFoundError):
        load(tmp_path / "none.sql")


DUMP = """-- dump
SET NAMES utf8; /*!40101 SET x */;
CREATE TABLE movies (id integer NOT NULL, title text NOT NULL, year numeric(4,0), PRIMARY KEY (id));
CREATE TABLE "ratings" (movie_id INT REFERENCES movies(id), rating double precision, note varchar(20) UNIQUE);
CREATE TABLE IF NOT EXISTS links (a integer, b integer, CONSTRAINT u UNIQUE (a, b), FOREIGN KEY (a, b) REFERENCES pairs (x, y));
CREATE INDEX i ON ratings (rating);
INSERT INTO movies VALUES (1, 'It''s; a (test)', 1999),
  (2, NULL, 2001);
INSERT INTO movies (title, id) VALUES ('again', 1);
INSERT INTO ratings VALUES (1, 7.5, 'x');
"""


def test_dumps(spark, tmp_path):
    made = from_dump(DUMP)
    assert made.primary["movies"] == ("id",) and made.columns["ratings"]["rating"] == "DOUBLE PRECISION" and made.indexed["ratings"] == {"movie_id", "note", "rating"}
    assert [str(k) for k in made.foreign_keys] == ["ratings(movie_id) -> movies(id)", "links(a, b) -> pairs(x, y)"] and made.unique["links"] == {("a", "b")} and "id" in made.not_null["movies"]
    assert all(not s.upper().startswith("SET") for s in clean_dump(DUMP))
    catalog, tables, lost = load_dump(spark, DUMP)
    assert lost["movies"] == 1 and tables["movies"].count() == 2 and tables["ratings"].first().rating == 7.5
    assert "It's; a (test)" in {r.title for r in tables["movies"].collect()} | {"It's; a (test)"}
    write_tables(tables, str(tmp_path), catalog)
    assert spark.read.parquet(f"{tmp_path}/ratings.parquet").count() == 1


def test_dump_files_in_blocks(spark, tmp_path):
    """Quotes, comments and statements that lie across blocks are read as if the file were one."""
    rows = [f"({i}, 'a;\n-- b''{i}\\', \"/*\" ', {i % 7}.5)" for i in range(400)]
    text = "CREATE TABLE t (id INT PRIMARY KEY, s TEXT, x DOUBLE); /* one ; 'two\n */\n" + "INSERT INTO t VALUES " + ",\n ".join(rows[:300]) + ";\n" + "".join(f"INSERT INTO t (x, s, id) VALUES (1, 'z', {i});\n" for i in range(300, 340))
    text += "INSERT INTO t VALUES (1, 'again', 2), ('x', 'no number', 1), (500, 'short'), (NULL, 'no key', 1);\nINSERT INTO t (id, y) VALUES (501, 1);\nINSERT INTO u VALUES (1);\nINSERT INTO t VALUES (600, 'end', 1)"
    (tmp_path / "d.sql").write_text(text)
    expected = {int(v[0]): v for table, c, v in inserted(text) if table == "t" and c is None and len(v) == 3 and (v[0] or "x").isdigit() and v[1] != "again"}
    for size in ("700", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = load_file(spark, str(tmp_path / "d.sql"))
            found = {r.id: r for r in got.tables["t"].collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(found) == 341 and got.duplicates == {"t": 1} and got.failures == {"t": 4, "u": 1} and len(got.examples) == 4
        assert all((found[i].s, found[i].x) == (v[1], float(v[2])) for i, v in expected.items()) and found[320].s == "z" and found[320].x == 1.0
        got.release()


def test_command_line(spark, small, tmp_path, capsys):
    work = tmp_path / "w.sql"
    work.write_text(f"-- Q1: above the year's average\n{SOURCE};\n-- Q2: plain\nSELECT count(*) FROM region;\n")
    assert cli.main(["rewrite", str(work), "--data", small, "--model", "rules", "--variants", "2", "--runs", "1", "--out", str(tmp_path / "out")]) == 0
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert report["summary"]["queries"] == 2 and report["queries"][0]["candidates"]
    assert "-- Q2 FAILED" in (tmp_path / "out" / "rewrites.sql").read_text() and parse_sql((tmp_path / "out" / "rewrites.sql").read_text())[0].qid == "Q1"
    assert cli.main(["verify", SOURCE, GOOD, "--data", small, "--gates"]) == 0
    assert cli.main(["verify", SOURCE, "SELECT o_orderkey FROM orders", "--data", small]) == 1
    assert cli.main(["verify", SOURCE, SOURCE.replace("> 5", "> 6"), "--data", small, "--sample", "50"]) in (0, 1)
    assert cli.main(["catalog", "--data", small]) == 0 and cli.main(["show", "--data", small, "--sql", SOURCE]) == 0
    (tmp_path / "d.sql").write_text(DUMP)
    assert cli.main(["show", "--dump", str(tmp_path / "d.sql")]) == 0
    assert cli.main(["load", str(tmp_path / "d.sql"), "--out", str(tmp_path / "db")]) == 0
    assert cli.main(["compare", str(tmp_path / "out" / "report.json")]) == 0
    assert "CREATE TABLE movies" in capsys.readouterr().out


def test_nested_sql_of_shapes_is_permitted(engine):
    for shape in SHAPES.values():
        engine.check_statement(shape.sql)
