"""The operators against plain Python, on texts with every awkward case."""

import inspect
import json
import random
import re
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from requill.llm import bpe, common, compaction, decontam, grades, lengths, neardup, queries, rules, secrets, substrings, urls
from requill.llm.common import workspace
from requill.llm.graph import components
from tests.llm import brute

DOCS = "doc_id long, text string"


def make_rows(seed=0):
    """Unique ids; copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = prose(60), [None, "", " \n\t", "one", "Two words", "same three words", "Same THREE words", "\xa0nbsp\x85x \x1cfs"]
    for _ in range(12):
        base = prose(rng.randint(5, 200))
        texts += [" ".join(base)] * rng.choice((1, 2, 3))
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        texts.append("  ".join(near).upper() if rng.random() < 0.3 else "\n".join(near))
        texts.append(" ".join(prose(30) + passage[rng.randint(0, 20) :] + prose(10)))
    texts += [" ".join(passage * 3), " ".join(prose(3000)), "x " * 100, " ".join(prose(49)), "a\n\nb\na\n a\nb"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def clashing(df):
    """Extra columns whose names the operators use themselves."""
    names = "doc tag bucket rows at k1 key a b root node n row base found votes features copies url2 rep mh strip _arrival n_tokens kept host digest".split()
    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def collected(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# -- 1: secrets

SECRETS = [
    (1, None), (2, ""), (3, "token=secret=abcdefgh12 API_KEY: \"x\" apikey:'12345678' ſecret=abcdefgh"), (4, "😀é token = 12345678 AKIAAKIAAKIAAKIA AKIA123 " + "a" * 31 + " " + "ab" * 16 + "\n" + "f" * 33),
    (5, "token=secret:abcdefgh password=deadbeefdeadbeefdeadbeefdeadbeef1"), (6, "key AbCd3fGhIjKlMn0pQrStUvWx9z81aQ2 k"), (7, "x" * 50_000 + " passwd=abcdefgh"), (8, "word " * 30), (8, "secret=abcdefgh"), (None, "secret=abcdefgh"),
]


def test_secrets_match_brute_force(spark, rows):
    given = SECRETS + [(i + 100, t) for i, t in rows]
    made = secrets.secret_report(clashing(spark.createDataFrame(given, DOCS)))
    expected = Counter()
    for i, text in given:
        found = brute.secrets(text)
        kinds = Counter(k for k, _, _ in found)
        expected[i, kinds["assign"], kinds["access"], kinds["hex"], brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))] += 1
    assert collected(made, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == expected
    spans = {r.doc_id: r.spans for r in made.collect()}
    assert spans[6] == "random:4:35" and spans[5].startswith("assign:22:") and spans[2] == ""


def test_randomness_battery_tells_random_from_words(spark):
    rng = random.Random(5)
    alphabet = secrets.ALPHABETS["base64"]
    good = ["".join(rng.choice(alphabet[:62]) for _ in range(n)) for n in (24, 40, 64, 120) for _ in range(25)]
    bad = [("aB3" * 40)[:n] for n in (24, 40, 64, 100)] * 10 + ["aaaaaaaaaaaaAAAAAAAAAAAA1111111111111", "ThisIsAVeryLongCamelCaseIdentifier2" * 3] * 10
    frame = spark.createDataFrame([(i, f"see {v} there") for i, v in enumerate(good + bad)], DOCS)
    found = {r.doc_id for r in secrets.secret_report(frame).where("n_random > 0").collect()}
    assert len([i for i in found if i < len(good)]) >= 0.85 * len(good) and len([i for i in found if i >= len(good)]) <= 0.05 * len(bad)


def test_lower_case_and_named_strings_are_tested(spark):
    """Lower-case base32 and base36, and values after a name and "=", with the value's place alone."""
    rng = random.Random(6)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alphabets = [secrets.ALPHABETS["base64"][26:62], "abcdefghijklmnopqrstuvwxyz234567", secrets.ALPHABETS["base64"][:62]]
    values = [(before, draw(a, 40)) for before, a in (("see ", alphabets[0]), ("see ", alphabets[1]), ("session=", alphabets[2]), ("?sig=", alphabets[2]), ("a_name_of_twenty_letters=", alphabets[0])) for _ in range(20)]
    frame = spark.createDataFrame([(i, f"{b}{v}== there") for i, (b, v) in enumerate(values)], DOCS)
    made = {r.doc_id: r.spans for r in secrets.secret_report(frame).collect()}
    right = [made[i] in (f"random:{len(b)}:{len(b) + 40}", f"random:{len(b)}:{len(b) + 42}") for i, (b, v) in enumerate(values)]
    assert all(sum(right[k : k + 20]) >= 12 for k in (20, 40, 60)) and sum(right) >= 60
    plain = spark.createDataFrame([(i, f"see {v} there") for i, (_, v) in enumerate(values[:20])], DOCS)
    assert secrets.secret_report(plain).where("n_random > 0").count() >= 15


def encoding_of(value):
    """The narrowest encoding, by plain rules."""
    body = value.rstrip("=")
    if not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
        return None
    for pattern, name, whole in (("[0-9a-f]+|[0-9A-F]+", "hex", value), ("[A-Z2-7]+", "base32", body), ("[A-Z0-9]+", "base36", body), ("[a-z2-7]+", "base32 lower", body), ("[a-z0-9]+", "base36 lower", body)):
        if re.fullmatch(pattern, whole):
            return name
    return "base64" if re.search("[A-Z]", value) and re.search("[a-z]", value) else None


def test_random_spans_match_brute_force(spark):
    rng = random.Random(12)
    draw = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.choice((20, 22, 27, 32, 45, 64, 200))))
    names = ["".join(rng.choice(("user", "Name", "get", "Value", "2", "HTTP", "config", "_", "/", "Path", "Report", "2021")) for _ in range(9)) for _ in range(150)]
    texts = [None, "", *(f"é {rng.choice(names)} = {draw(rng.choice(list(secrets.ALPHABETS.values())))}{'=' * rng.randrange(3)} token={draw('abc123ABC')} {rng.choice(names)}" for _ in range(200))]
    made = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("random")] for r in secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    expected = brute.random_spans(texts, secrets.ALPHABETS, secrets.TEXT, encoding_of)
    assert sum(map(len, expected)) > 60
    different = [k for k in made if made[k] != expected[k]]
    assert len(different) <= 2, [(texts[k], made[k], expected[k]) for k in different]


def test_small_classes_of_names_are_left_alone(spark):
    """Classes of a few strings, none of them random: nothing is found, whatever the lengths; one random string among them is."""
    rng = random.Random(13)
    words = ["invoice", "Total", "customer", "2021", "report", "Q3", "final", "Version2", "draft", "user", "Id42", "export", "Archive", "north"]
    names = ["".join(rng.sample(words, k))[:n] for k in (4, 5, 6, 7) for n in (20, 24, 30, 37, 45) for _ in range(2)] + ["deadbeefdeadbeef0000", "00000000000000000001a", "ABCABCABC123123123ABC", "a1a1a1a1a1a1a1a1a1a1a1a1"]
    given = [(i, f"see {v} there") for i, v in enumerate(names)]
    assert secrets.secret_report(spark.createDataFrame(given, DOCS)).where("n_random > 0").count() <= 1
    random_one = "".join(rng.choice(secrets.ALPHABETS["base64"][:62]) for _ in range(64))
    found = secrets.secret_report(spark.createDataFrame([*given, (999, f"see {random_one} there")], DOCS)).where("n_random > 0").collect()
    assert 999 in {r.doc_id for r in found} and len(found) <= 2


def test_texts_of_very_many_matches(spark):
    """50,000 matches in one text, and one match of a million characters: seconds, as work grows little faster than the text."""
    rng = random.Random(14)
    many = " ".join(f"token=abcdefgh{i} x" for i in range(50_000))
    blob = "".join(rng.choice(secrets.ALPHABETS["base64"]) for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, many), (2, f"é {blob} z"), (3, many[:400_000] + blob[:5000])], DOCS)
    began = time.perf_counter()
    made = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(docs, "#").collect()}
    took = time.perf_counter() - began
    assert made[1].n_assign == 50_000 and made[1].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.secrets(many)))
    assert made[2].spans == "random:2:1000002" and clean[2] == "é # z" and clean[1] == " ".join(["# x"] * 50_000) and took < 90, took


def test_no_python_on_the_way(spark):
    frame = spark.createDataFrame(SECRETS, DOCS)
    for df in (secrets.secret_report(frame), secrets.redact(frame)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_redaction(spark):
    made = {r.doc_id: r.text for r in secrets.redact(clashing(spark.createDataFrame([r for r in SECRETS if r[0]][:7], DOCS)), mark="[X]").collect()}
    assert made[1] is None and made[2] == "" and made[6] == "key [X] k" and made[5] == "token=secret:abcdefgh [X]" and made[7] == "x" * 50_000 + " [X]"
    assert made[4].startswith("😀é [X] [X] AKIA123 ")


# -- 2: near duplicates


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(docs, rows, size, percent):
    made = neardup.near_duplicates(clashing(docs), size, percent)
    expected = brute.near(rows, size, percent)
    assert collected(made, "doc_id", "n_shingles", "component_id", "kept") == Counter((i, n, c, i == c) for i, (n, c) in expected.items())


@pytest.mark.parametrize("pivots", [0, 2, 8])
def test_near_duplicates_in_many_blocks(spark, monkeypatch, pivots):
    """A chain of copies, each a little further on, in blocks so small that links cross them."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    chain = []
    for step in range(60):
        words[step % 160] = f"n{step}"
        words[(step * 7 + 3) % 160] = f"m{step}"
        chain.append((step, " ".join(words)))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    made = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(chain, DOCS), 3, 85).collect()}
    assert made == {i: c for i, (_, c) in brute.near(chain, 3, 85).items()}


def test_near_copies_of_one_text_need_few_rows(spark, monkeypatch):
    """A large group that its pivots link, and texts near enough to be candidates that few or none of them link to."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    given = []
    for i in range(150):
        edited = list(words)
        for _ in range(1 if i < 130 else 5 if i < 140 else 7):
            edited[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        given.append((i, " ".join(edited)))
    monkeypatch.setattr(neardup, "BLOCK", 10)
    made = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(given, DOCS), 3, 85).collect()}
    expected = {i: c for i, (_, c) in brute.near(given, 3, 85).items()}
    assert made == expected and len(set(expected.values())) > 1


def connected(links, ids):
    """Each id with the least id that links connect it to."""
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_links_span_keys(monkeypatch):
    """Batches of any size give links that connect all roots of each key's members and nothing else, and no hub has them all."""
    monkeypatch.setattr(neardup, "HUB", 4)
    rng = np.random.default_rng(3)
    key, doc = np.sort(rng.integers(0, 9, 300)), np.arange(300)
    for rows in (1, 2, 7, 300):
        batches = (b for i in range(0, 300, rows) for b in neardup.batches_of(neardup.KEYED, [x[i : i + rows] for x in (key, doc, doc)]))
        links = [tuple(r.values()) for b in neardup.linker(batches) for r in b.to_pylist()]
        assert connected(links, range(300)) == {i: int(np.flatnonzero(key == key[i])[0]) for i in range(300)}
        assert max(Counter(b for _, b in links).values()) < 25
    batches = neardup.batches_of(neardup.KEYED, [[1] * 5, [1, 2, 3, 4, 5], [1, 1, 3, 1, 3]])
    links = [tuple(r.values()) for b in neardup.linker(batches) for r in b.to_pylist()]
    assert connected([*links, (1, 2), (1, 4), (3, 5)], range(1, 6))[3] == 1 and len(links) < 4


def test_keys_once_a_root():
    mh = np.random.default_rng(1).integers(0, 2**31, (3, 40)).astype(np.int32)[[0, 0, 1, 2, 1]].tolist()
    schema = neardup.pa.schema([("rep", neardup.pa.int64()), ("root", neardup.pa.int64()), ("mh", neardup.pa.list_(neardup.pa.int32()))])
    made = {}
    for which in ("all", "some", "first"):
        batches = neardup.batches_of(schema, [[9, 8, 7, 6, 5], [8, 8, 7, 6, 5], mh])
        made[which] = [tuple(r.values()) for b in neardup.bander(which)(batches) for r in b.to_pylist()]
    assert len(set(made["all"])) == 500 and len(made["some"]) == 50 and set(made["some"]) <= set(made["all"])
    assert sorted(made["first"]) == sorted(r for r in made["all"] if r[1] != 9)


def test_candidates_connect_all_that_agree(spark, monkeypatch):
    """Families that share keys with half-alike strangers, in blocks so small that members meet across them."""
    monkeypatch.setattr(neardup, "ROWS", 3)
    monkeypatch.setattr(neardup, "COLUMNS", 4)
    monkeypatch.setattr(neardup, "HUB", 5)
    rng, least = np.random.default_rng(8), 24
    base = rng.integers(0, 2**31, (3, 40))
    rows = []
    for i in range(90):
        mh = base[i % 3].copy()
        changed = rng.permutation(40)[: (2, 14, 26)[i * 7 % 11 % 3]]
        mh[changed] = rng.integers(0, 5, len(changed)) if i % 2 else rng.integers(0, 2**31, len(changed))
        rows.append((i, mh.astype(np.int32).tolist()))
    mh = np.array([r[1] for r in rows], np.int32)
    keys = [set(k.tolist()) for k in neardup.band_keys(mh.view(np.uint32))]
    links = [(a, b) for a in range(90) for b in range(a) if keys[a] & keys[b] and (mh[a] == mh[b]).sum() >= least]
    expected = connected(links, range(90))
    made = {r.node: r.root for r in neardup.candidates(spark.createDataFrame(rows, "rep long, mh array<int>"), least).collect()}
    got = {i: made.get(i, i) for i in range(90)}
    assert len(set(expected.values())) > 3 and all(got[a] == got[b] for a, b in links)


def test_near_duplicates_without_ids(spark):
    given = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "A b c D"), (8, None), (None, None)]
    made = neardup.near_duplicates(spark.createDataFrame(given, DOCS), 3, 85)
    assert collected(made, "doc_id", "component_id", "kept") == Counter({(7, 7, True): 2, (None, None, False): 2, (9, 7, False): 1, (8, 8, True): 1})


def test_collection_size_and_components(spark):
    for p in (0.8, 0.85):
        m = neardup.collection_size(p)
        assert 1 - (1 - (1 - p * p) ** m) ** 2 <= neardup.MISS < 1 - (1 - (1 - p * p) ** (m - 1)) ** 2
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 200)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}
    assert components(edges.where("false")).count() == 0


# -- 3: decontamination


@pytest.mark.parametrize("block_words", [500_000, 20])
def test_contamination_matches_brute_force(spark, rows, block_words):
    items = [(1, " ".join((rows[10][1] or "a").split()[:40])), (10, next(t for _, t in rows if t and len(t.split()) > 150)), (2, "one"), (3, None), (4, ""), (5, "TWO, words"), (None, "same three words"), (2, "one"), (6, "x x x")]
    given = rows + [(1000, "Two-words\x80é, one; " * 20), (1000, "one"), (None, "two words")]
    made = decontam.find_contamination(clashing(spark.createDataFrame(given, DOCS).repartition(3)), spark.createDataFrame(items, "item_id long, text string"), 13, 5, block_words)
    assert collected(made, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == Counter(brute.contamination(given, items, 13))


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    runs = rng.integers(1, 4, 400)
    runs[rng.integers(0, 400, 20)] = 0
    runs[-1] = 0
    index = decontam.FMIndex(runs.astype(np.int64))
    windows = np.array([[0, 1, 2], [1, 2, 1], [0, 0, 3], [2, 2, 2], [0, 9, 1]], np.int32)
    sizes = np.array([2, 3, 1, 3, 2])
    low, high = index.search(windows, sizes)
    for w, n, a, b in zip(windows, sizes, low, high, strict=True):
        expected = [i for i in range(len(runs) - n + 1) if runs[i : i + n].tolist() == w[3 - n :].tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


# -- 4: sharding


def test_compaction_keeps_rows_and_merges(spark, rows):
    given = spark.createDataFrame(rows + [(None, "a"), (None, None), (3, "again"), (3, "again"), (4, "long " * 200_000)], DOCS)
    given = given.withColumn("arrival", F.lit(1)).withColumn("ARRIVAL_", F.lit(2)).withColumn("shard", F.lit(3)).withColumn("version", F.lit("x"))
    path = workspace(spark)
    made = compaction.compacted(given, path, arrivals=8, target=1 << 20, fanout=2)
    assert collected(made, "doc_id") == collected(given, "doc_id")
    store = compaction.ShardStore(spark, path)
    assert 1 <= len(store.manifest().shards) < 8 and {(r.run, r.shard) for r in made.select("run", "shard").collect()} == {(s.run, s.path.split("/")[-1]) for s in store.manifest().shards}
    columns = ("doc_id", "text", "arrival", "ARRIVAL_", "shard", "version")
    assert collected(store.read(), *columns) == collected(given, *columns) and store.versions() == [store.manifest().version]
    assert compaction.compacted(given.where("false"), workspace(spark)).count() == 0


def test_small_files_of_large_runs_are_merged(spark):
    """Runs of more bytes than the target, in many small files: what matters is the files' sizes."""
    store = compaction.ShardStore(spark, workspace(spark), target=400_000, fanout=4, smallest=20_000)
    for i in range(4):
        store.append(spark.range(i * 16_000, (i + 1) * 16_000, 1, 10).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")))
    before = store.manifest()
    assert all(store.target < sum(s.size for s in before.shards if s.run == run) for run in {s.run for s in before.shards}) and len(before.shards) == 40
    after = store.compact()
    small = [s for s in after.shards if 2 * s.size < store.target]
    assert len(after.shards) < 20 and len(small) < 4 and max(s.size for s in after.shards) < 1.2 * store.target and not store.plan(after)
    assert store.read().count() == store.read().distinct().count() == 64_000
    assert [store.read(v).count() for v in store.versions()[:4]] == [16_000, 32_000, 48_000, 64_000]


def test_plan_matches_brute_force(spark):
    rng = random.Random(9)
    store = compaction.ShardStore(spark, workspace(spark), target=1000, fanout=3, smallest=10)
    for _ in range(50):
        shards = [compaction.Shard(f"r{i}/f", int(2 ** rng.uniform(0, 11)), i) for i in range(rng.randrange(30))]
        bounds = [10, 30, 90, 270, 810, 10**9]
        tiers = [[s for s in shards if 2 * s.size < 1000 and low < s.size <= high] for low, high in zip([0, *bounds], bounds, strict=False)]
        groups = store.plan(compaction.Manifest(1, shards))
        for tier in tiers:
            own = [g for g in groups if g[0] in tier]
            merged = [s for g in own for s in g]
            assert all(len(g) > 1 and sum(s.size for s in g) <= 1000 for g in own) and all(2 * sum(s.size for s in g) > 1000 for g in own[:-1])
            assert merged == [s for s in tier if s in merged] and (not own if len(tier) < 3 else len(tier) - len(merged) <= 1)
        assert sum(map(len, groups)) == len({s.path for g in groups for s in g})


def test_manifests_are_versions_and_conflict(spark):
    store = compaction.ShardStore(spark, workspace(spark), target=1 << 30, fanout=3)
    assert store.manifest().version == 0 and store.compact().version == 0
    for i in range(3):
        store.append(spark.range(i * 10, i * 10 + 10).coalesce(1))
    assert store.append(spark.range(0)).version == 3
    base = store.manifest()
    assert base.version == 3 and store.read(1).count() == 10 and [s.order for s in base.shards] == [1, 2, 3]
    wins = []

    def write():
        try:
            wins.append(store.commit(base, base.shards).version)
        except compaction.VersionConflict:
            pass

    threads = [threading.Thread(target=write) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert wins == [4]
    reader = store.read()
    assert store.compact().version == 5 and len(store.manifest().shards) == 1 and store.read().count() == 30
    assert reader.count() == store.read(3).count() == 30
    with pytest.raises(compaction.VersionConflict):
        store.change([], base.shards)
    store.spark.range(5).write.parquet(f"{store.path}/data/run-lost")
    store.vacuum()
    assert len(store._list("data")) == 6 and store.versions() == [1, 2, 3, 4, 5]
    store.vacuum(versions=2, seconds=0)
    assert store.read(4).count() == 30 and store.versions() == [4, 5]
    store.vacuum(seconds=0)
    assert [s.getPath().getName() for s in store._list("data")] == [store.manifest().shards[0].run.split("/")[0]] and store.read().count() == 30
    with pytest.raises(ValueError):
        store.manifest(4)


def test_columns_that_come_later(spark):
    store = compaction.ShardStore(spark, workspace(spark), fanout=2)
    store.append(spark.range(3).coalesce(1))
    store.append(spark.range(3, 5).coalesce(1).withColumn("x", F.lit("new")))
    store.compact()
    assert collected(store.read(), "id", "x") == Counter([(0, None), (1, None), (2, None), (3, "new"), (4, "new")])


def test_no_python_in_compaction(spark, rows):
    """Neither a plan nor a manifest is read by a Python worker."""
    source = inspect.getsource(compaction)
    made = compaction.compacted(spark.createDataFrame(rows, DOCS), workspace(spark))
    assert not any(x in made._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow")) and not any(x in source for x in (".rdd", "wholeTextFiles", "mapIn", "udf"))


# -- 5: substrings


def test_repeats_of_long_rows(spark):
    """A row of several windows that occurs two or three times, also without an id, loses every word."""
    long = [" ".join(f"{c}{i}" for i in range(200)) for c in "abc"]
    given = [(1, long[0])] * 2 + [(None, long[1])] * 3 + [(2, long[2])] + [(3, long[2] + " more words")]
    for parts in (1, 3):
        made = substrings.remove_repeats(spark.createDataFrame(given, DOCS).repartition(parts))
        assert collected(made, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats(given, 35))


@pytest.mark.parametrize("window", [3, 8, 35])
def test_repeats_match_brute_force(docs, rows, window):
    made = substrings.remove_repeats(clashing(docs), window, with_text=True)
    assert collected(made, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats(rows, window))
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in made.collect())


def test_repeats_of_ids_and_nulls(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    given = [(1, passage), (1, "short text"), (None, passage), (None, None), (2, " ".join(f"v{i}" for i in range(40))), (1, "short text"), (3, ("y " * 36).strip())]
    made = substrings.remove_repeats(spark.createDataFrame(given, DOCS).repartition(3))
    assert collected(made, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats(given, 35))


def test_rows_are_told_apart(spark, tmp_path):
    """Many null ids, among them texts whose 32-bit hashes collide, and rows that a table gives in the same order again."""
    long = " ".join(f"w{i}" for i in range(40))
    colliding = [f"{long} w59 3540", f"{long} s 2504"]
    given = [(None, t) for t in colliding] + [(None, f"only {i} words here") for i in range(300)] + [(5, f"{long} end")] * 2
    spark.createDataFrame(given, DOCS).repartition(7).write.parquet(f"{tmp_path}/t")
    made = substrings.remove_repeats(spark.read.parquet(f"{tmp_path}/t"))
    assert collected(made, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.repeats(given, 35))
    assert "ReusedExchange" in made._jdf.queryExecution().executedPlan().toString() or "AdaptiveSparkPlan" in made._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_the_input(spark, monkeypatch, tmp_path):
    spark.range(20_000).write.parquet(f"{tmp_path}/t")
    frame = spark.read.parquet(f"{tmp_path}/t")
    assert common.buckets_of(frame) == 4
    monkeypatch.setattr(common, "BUCKET_BYTES", 1000)
    assert common.buckets_of(frame) > 50 and common.buckets_of(frame.where("id < 0")) > 50


def test_covers_meet_every_difference():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substrings.period_for(35) == 21 and substrings.period_for(3) == 1


# -- 6 and 7: lengths and encoding


def text_cases():
    rng = random.Random(3)
    pool = "abzAZ019 .,'!?\n\téÉΣσςİıßẞ中文\u200b\u3000 \x1c\x85\U0001f600กำﬁΩK½٥Ⅷͅ\x00﻿"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    return [None, "", "a<|endoftext|>b", "<|startoftext|><|endoftext|>x", "'S it's I'LL don't", "<|ENDOFTEXT|>", "a" * 3000, "é" * 300, "ΑΣ ΑΣ.", *made]


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    given, bpe_counter = list(enumerate(text_cases())), bpe.Coder(bpe.vocabulary_text(path))
    made = {r.doc_id: r for r in bpe.encode_decode(clashing(spark.createDataFrame(given, DOCS)), path, with_ids=True).collect()}
    for i, text in given:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (made[i].n_tokens, made[i].ids, made[i].decoded) == (len(ids), ids, decoded), text
        assert bpe_counter.count(text or "") == len(ids)
        assert made[i].ids_sha256 == brute.sha(" ".join(map(str, ids))) and made[i].decoded_sha256 == brute.sha(decoded)
    assert bpe.encode_decode(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], DOCS), path).count() == 3


def test_very_long_words_equal_the_library():
    from tokenizers import Tokenizer

    path, rng = queries.vocabulary_path(), random.Random(4)
    library, coder = Tokenizer.from_file(path), bpe.Coder(bpe.vocabulary_text(path))
    library.no_truncation()
    library.no_padding()
    for word in ("a" * 200_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "the" * 500 + "é" * 700, "ab" * 33):
        began = time.perf_counter()
        n, ids, decoded = coder.code(f"x {word} y")
        assert time.perf_counter() - began < 15
        expected = library.encode(f"x {word} y", add_special_tokens=False).ids
        assert ids == " ".join(map(str, expected)) and decoded == library.decode(expected, skip_special_tokens=False)
    assert max(map(len, coder.pieces), default=0) <= bpe.CACHE_LENGTH and max(map(len, coder.bpe.fragments), default=0) <= bpe.CACHE_LENGTH


def test_lengths_of_a_table(spark):
    """op6 end to end: the histogram of a table's texts against the library's lengths."""
    from tokenizers import Tokenizer

    path, given = queries.vocabulary_path(), [*enumerate(text_cases()), (3, "again"), (3, "again"), (None, "no id")]
    library = Tokenizer.from_file(path)
    library.no_truncation()
    values = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in given]
    made = lengths.length_histogram(lengths.token_lengths(clashing(spark.createDataFrame(given, DOCS)), path))
    expected = Counter((n, values.count(n), sum(v >= n for v in values), sum(v for v in values if v >= n), sum(min(v, n) for v in values)) for n in set(values))
    assert collected(made, "n_tokens", "n_docs", "n_docs_from", "n_tokens_from", "truncated_total") == expected
    for limit in (0, 1, 7, 1000, 10**6):
        r = lengths.truncated_total(made, limit).first()
        assert (r.n_tokens, r.kept, r.docs_cut) == (sum(values), sum(min(v, limit) for v in values), sum(v > limit for v in values))
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        assert lengths.length_quantile(made, q).first().n_tokens == min(n for n in values if sum(v <= n for v in values) >= q * len(values))


def test_forced_boundaries_never_part_a_token():
    coder = bpe.Coder(bpe.vocabulary_text(queries.vocabulary_path()))
    for token in list(coder.bpe.vocabulary)[::97]:
        symbols = coder.bpe.symbols(token)
        assert all(p in coder.bpe.inside for p in zip(symbols, symbols[1:], strict=False))
    symbols = ["q", "7", "Ġ", "q</w>"]
    whole = coder.bpe.merged(list(symbols))
    assert coder.bpe.encode(symbols) == whole


def test_other_vocabularies_go_to_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path("byte_bpe_50k.json")
    made = bpe.encode_decode(spark.createDataFrame([(1, "Hello  world é")], DOCS), path, with_ids=True).first()
    assert made.ids == Tokenizer.from_file(path).encode("Hello  world é", add_special_tokens=False).ids


def test_length_histogram(spark):
    given = [5, 5, 0, None, 1023, 1024, 1025, 5000, 70_000]
    frame = spark.createDataFrame([(n,) for n in given], "n_tokens long").withColumn("strip", F.lit("x"))
    values = [n or 0 for n in given]
    histogram = lengths.length_histogram(frame)
    expected = Counter()
    for n in set(values):
        longer = [v for v in values if v >= n]
        expected[n, values.count(n), len(longer), sum(longer), sum(min(v, n) for v in values)] += 1
    assert collected(histogram, "n_tokens", "n_docs", "n_docs_from", "n_tokens_from", "truncated_total") == expected
    cut = lengths.truncated_total(histogram, 1024).first()
    assert (cut.n_tokens, cut.kept, cut.docs_cut) == (sum(values), sum(min(v, 1024) for v in values), 3)
    assert lengths.length_quantile(histogram, 0.5).first().n_tokens == sorted(values)[4]
    assert lengths.length_histogram(frame.where("false")).count() == 0 and lengths.truncated_total(lengths.length_histogram(frame.where("false")), 5).first().kept == 0


# -- 8: quality classifier


def test_grades_hold_out(spark):
    rng = random.Random(1)
    words = {0: ["awful", "trash"], 1: ["dull", "plain"], 2: ["fine", "lucid"]}
    given = []
    for i in range(900):
        grade = rng.randrange(3)
        given.append((i, " ".join(rng.choice("the of and to in is it on as by".split()) if rng.random() < 0.8 else rng.choice(words[grade]) for _ in range(rng.randint(30, 60))), grade))
    frame = clashing(spark.createDataFrame([g[:2] for g in given], DOCS))
    labels = spark.createDataFrame([(i, g) for i, _, g in given[:600]] + [(None, 1), (5000, 2), (3, None)], "doc_id long, grade int")
    made = {r.doc_id: r for r in grades.grade_documents(frame, labels, F.col("grade"), 3, 2).collect()}
    test = given[600:]
    assert sum(made[i].kept == (g == 2) for i, _, g in test) > 0.95 * len(test)
    mean = [np.mean([made[i].expected_grade for i, _, g in test if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    again = {r.doc_id: r.score for r in grades.grade_documents(frame, labels, F.col("grade"), 3, 2).collect()}
    assert all(abs(again[i] - made[i].score) < 1e-6 for i in again)


def test_scores_match_brute_force(spark, rows):
    """Scores of every text, awkward ones too, by plain sums over the model's weights; equal texts are graded alike."""
    given = [*rows, (None, rows[0][1]), (7, "MARKED, (words)! "), (7, "MARKED, (words)! "), (8, "x" * 50_000), (9, "long " * 30_000 + "tail")]
    frame = clashing(spark.createDataFrame(given, DOCS))
    labels = spark.createDataFrame([(i, i % 3) for i in range(0, 60, 2)], "doc_id long, grade int")
    model = grades.train(frame, labels, F.col("grade"), 3)
    again = grades.train(frame, labels, F.col("grade"), 3, budget=2000)
    assert np.abs(model.weights).sum() > 0 and not np.array_equal(model.weights, again.weights)
    expected = Counter()
    for i, text in given:
        score = sum(float(model.weights[b]) for w in set(brute.WORD.findall(text or "")) for b in grades.word_features(w.encode()))
        p = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        expected[i, round(score, 6), round(sum(p), 6), round(p[1], 6), bool(p[1] >= 0.4)] += 1
    made = grades.grade_documents(frame, labels, F.col("grade"), 3, 2, threshold=0.4)
    assert Counter((r.doc_id, round(r.score, 6), round(r.expected_grade, 6), round(r.p_keep, 6), r.kept) for r in made.collect()) == expected


def test_grades_without_labels_or_text(spark):
    frame = spark.createDataFrame([(1, None), (None, "a"), (1, "a"), (1, "a")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, grade int")
    made = grades.grade_documents(frame, labels, F.col("grade"), 3, 2)
    assert made.count() == 4 and {r.score for r in made.collect()} == {0.0} and grades.grade_documents(frame.where("false"), labels, F.col("grade"), 3, 2).count() == 0


# -- 9: urls

URLS = [None, "", "http://NET/", "http://net", "http://net?x/", "x://a://b.net/", "http://xnet/", "http://a.EXAMPLE.net/en/", "http://example.net/en", "https://u.org/fr/a#b", "://net//", "http://a.net:80/x", "http://a..net/", "http://net/\n?x", "no scheme", "http://b.example.com/de/x/y", "http://" + "s." * 40 + "net/" + "p/" * 200]


def test_urls_match_brute_force(spark):
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(7, URLS[7]), (None, URLS[7])], "page_id long, url string"))
    given = [(i, u) for i, u in enumerate(URLS)] + [(7, URLS[7]), (None, URLS[7])]
    for listed in (queries.URL_RULES, (*queries.URL_RULES, ("block", "example.net/en/x"), ("allow", "net/p"), ("block", "org/fr/a"), ("allow", "org/fr/a"), ("block", "a.net/"), ("block", "/nohost"), ("block", "nopath"), (None, "net/x/"))):
        usable = [(v, r) for v, r in listed if v and r.find("/") > 0]
        made = urls.filter_urls(pages, urls.rules_frame(spark, listed))
        expected = Counter((i, *brute.url(u, usable)) for i, u in given)
        assert collected(made, "page_id", "host", "path", "rule", "verdict") == expected
    assert urls.filter_urls(pages.where("false"), urls.rules_frame(spark, queries.URL_RULES)).count() == 0


def test_prefixes_that_collide_are_confirmed(spark, monkeypatch):
    """With one digit of the digest all but a few expressions meet wrong rules; broadcast or salted, the result is the same."""
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    listed = (*queries.URL_RULES, *(("block", f"host{i}.example/p{i}/") for i in range(60)), ("block", "net/p"), ("allow", "a.net/"))
    expected = Counter((i, *brute.url(u, listed)) for i, u in enumerate(URLS))
    for few in (100_000, 0):
        monkeypatch.setattr(urls, "FEW_RULES", few)
        made = urls.filter_urls(pages, urls.rules_frame(spark, listed), digits=1)
        assert collected(made, "page_id", "host", "path", "rule", "verdict") == expected


def test_urls_of_very_many_parts(spark):
    """Work follows the forms of rules, not labels times segments."""
    long = [(i, "http://" + "s." * 2000 + "net/" + "p/" * 20_000 + f"{i}") for i in range(40)]
    began = time.perf_counter()
    made = urls.filter_urls(spark.createDataFrame(long, "page_id long, url string"), urls.rules_frame(spark, queries.URL_RULES)).collect()
    assert {r.verdict for r in made} == {"block"} and len(made) == 40 and time.perf_counter() - began < 20


# -- 10: rules


def test_rules_match_brute_force(docs, rows):
    made = rules.quality(clashing(docs))
    expected = Counter((i, *brute.rule_measures(t)) for i, t in rows)
    assert collected(made, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expected
    for r in made.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_label_model_learns_rare_alarms():
    model = rules.LabelModel(3).fit({(1, 1, 1): 900, (-1, 1, -1): 40, (1, -1, 1): 40, (1, 1, 0): 20})
    assert model.posterior((1, 1, 1)) > 0.9 > 0.5 > model.posterior((-1, 1, -1)) and model.posterior((-1, -1, -1)) < 0.01
    assert rules.LabelModel(2).fit({}).posterior((1, 1)) > 0.5


def test_rules_of_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for df in (rules.quality(empty), neardup.near_duplicates(empty), substrings.remove_repeats(empty), secrets.secret_report(empty), bpe.encode_decode(empty, queries.vocabulary_path()), decontam.find_contamination(empty, spark.createDataFrame([], "item_id long, text string"))):
        assert df.count() == 0
    assert rules.quality(spark.createDataFrame([(None, "a " * 60), (1, None), (1, None)], DOCS)).count() == 3


def test_queries_have_names_and_sql():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
    assert json.dumps(queries.oracle_sql())
