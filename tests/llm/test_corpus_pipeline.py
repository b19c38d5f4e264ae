"""The pipeline's stages against plain Python, on the small table."""

import gc
import os
import weakref
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from requill.llm import bpe, common, queries
from tests.llm import brute

pytestmark = pytest.mark.filterwarnings("ignore")


def test_stages_keep_decisions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = (lambda made: spark.createDataFrame(made.collect(), made.schema))(stage(spark, docs, small))
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = len(after)
        if name == "quality_rules":
            gone = [i for i in before if i not in after]
            assert all(brute.rule_measures(before[i].text)[0] >= 50 for i in after) and gone
        elif name == "near_dedup":
            groups = brute.near([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        elif name == "decontamination":
            found = {i: bad for i, _, _, _, _, bad in brute.contamination([(i, r.text) for i, r in before.items()], items, 13)}
            assert set(after) == {i for i, bad in found.items() if not bad}
        elif name == "secret_scan":
            assert set(after) == set(before) and not any(brute.secrets(r.text) for r in after.values())
            assert all(after[i].text == before[i].text for i in before if not brute.secrets(before[i].text) and "[SECRET]" not in after[i].text)
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name != "bpe":
            assert docs.columns == columns
    assert len(corpus_pipeline.STAGES) == 5 and seen["bpe"] == seen["secret_scan"] > 0
    final = corpus_pipeline.run(spark, small)
    assert {r.doc_id: r.ids_sha256 for r in final.collect()} == {r.doc_id: r.ids_sha256 for r in docs.collect()}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, secret=""):
    """Some 120 different words that the rules keep."""
    return " ".join(f"word{chr(97 + i % 26)}{chr(97 + seed % 26)} text{chr(97 + (i * 7 + seed) % 26)}{chr(97 + i % 23)}" for i in range(60)) + secret


def test_awkward_documents(spark, small):
    """Rows without an id and rows that share one are judged for themselves; of repeated rows one stays."""
    rows = [(1, None, "en", "s", 0), (None, "word " * 80, "en", "s", 1)]
    rows += [(2, prose(1, " password=abcdefgh1"), "en", "s", 5)] * 2 + [(2, prose(2), "en", "s", 5), (None, prose(3), "en", "s", 5), (None, prose(4), "en", "s", 5), (None, prose(4), "en", "s", 5)]
    rows += [(None, prose(5), "de", "t", 5), (9, prose(5), "de", "t", 5), (8, prose(5), "de", "t", 5)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("votes", F.lit("x")).withColumn("row", F.lit("y"))
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        seen.append(Counter((r.doc_id, getattr(r, "text", None)) for r in docs.collect()))
    assert seen[0] == Counter((r[0], r[1]) for r in rows[2:])
    assert seen[1] == Counter([(2, rows[2][1]), (2, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (8, rows[10][1])]) == seen[2]
    assert seen[3] == Counter((i, prose(1, " [SECRET]") if t == rows[2][1] else t) for i, t in seen[1])
    assert Counter(i for i, _ in seen[4].elements()) == Counter([2, 2, None, None, 8])
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0, name
    assert queries.queries()


def test_very_long_documents(spark, small):
    """A long word, a text of very many secrets and one of very many lines go through all stages."""
    long = [prose(6) + " " + "x" * 100_000, prose(7) + " " + " ".join(f"token=abcdefgh{i} a{i}b" for i in range(5000)), "\n".join(prose(8 + i % 7) + f" line{i}" for i in range(300))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(long)], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, small)
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2]


def test_stages_after_a_shuffle(spark, small):
    """Near-dedup numbers rows, so rows without an order of their own are checkpointed first."""
    docs = spark.createDataFrame([(i % 3, prose(i % 4), "en", "s", 1) for i in range(40)], COLUMNS).repartition(7)
    assert "Exchange" not in common.numbered(docs, "row")._jdf.queryExecution().executedPlan().toString()
    assert corpus_pipeline.near_dedup(spark, docs, small).count() == 4


def test_rules_keep_no_copy_of_the_texts(spark, small):
    """The first stage leaves nothing in the shared folder: a copy of all texts would stand beside what near-dedup shuffles."""
    folder = common.ensure_checkpoint_dir(spark).removeprefix("file:")
    held = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)
    docs, before = spark.read.parquet(f"{small}/documents.parquet"), held()
    made = corpus_pipeline.quality_rules(spark, docs, small)
    assert made.count() > 0 and held() == before
    # The verdicts are those of the query, which measures once.
    assert sorted(r.doc_id for r in made.collect()) == sorted(r.doc_id for r in queries.queries()["op10_quality_rules"](spark, small).where("kept").collect())


def test_coders_go_with_their_tasks():
    """Garbage isn't collected while a worker encodes, so a coder that waited for that would come on top of the next task's."""
    gc.disable()
    try:
        coder = bpe.Coder(bpe.vocabulary_text(queries.vocabulary_path()))
        assert coder.code("two words")[0] == coder.count("two words") > 0
        seen = weakref.ref(coder)
        del coder
        assert seen() is None
    finally:
        gc.enable()


def test_tidy_steps_give_the_same():
    """Whether a step's batches are read to their end or not, and when it fails."""
    ended = []

    def run(batches):
        try:
            for x in batches:
                yield 10 // x
        finally:
            ended.append(1)

    assert list(common.tidy(run)(iter([1, 2, 5]))) == [10, 5, 2]
    some = common.tidy(run)(iter([1, 2]))
    assert next(some) == 10
    some.close()
    with pytest.raises(ZeroDivisionError):
        list(common.tidy(run)(iter([1, 0])))
    assert len(ended) == 3
