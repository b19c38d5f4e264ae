"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of m pairs of minhashes are computed; every pair of one
member from each makes a table key, so 4m minhashes serve m squared tables.
Documents that share a key and agree in enough minhashes form candidate
clusters, whose links are then found exactly, on full sets: first within blocks
of members and against a few pivots, which usually leaves one component; then
between the members outside a cluster's largest component and all of its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requill.llm.common import U64, WordHashes, batches_of, cut, grouped, mix, offsets, signed, texts, thin, tidy, window_hashes, word_chunks
from requill.llm.graph import components

#: Sought chance to miss a pair that is just similar enough.
MISS = 1e-5
#: Members of a candidate cluster that are compared as one block.
BLOCK = 128
#: About so many members of a larger cluster are compared with all of its blocks.
PIVOTS = 8
#: One document in so many is a hub, and links that a task gathers before it gives them out.
HUB, LINKS = 64, 400_000
#: Left and right rows of one comparison of sketches.
ROWS, COLUMNS = 2048, 1024
#: Keys that are broadcast at most; more are joined by a shuffle.
FEW_KEYS = 200_000
NONE = -(2**63)


def collection_size(similarity: float) -> int:
    """The least m for which two collections of m pairs both match but for a chance of MISS."""
    return max(2, math.ceil(math.log(MISS / 2) / math.log(1 - similarity**2)))


def least_agreement(similarity: float, n: int) -> int:
    """The most of n minhashes in which a pair just similar enough agrees but for a chance of MISS."""
    fewer = 0.0
    for k in range(n):
        fewer += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if fewer > MISS:
            return k
    return n


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_sets(words: list[list[bytes]], hashes: WordHashes, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's shingles; fewer words make one shingle."""
    off = offsets(words)
    h = hashes.of([w for doc in words for w in doc])
    keys = window_hashes(h, size)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        out.append(np.unique(keys[a : b - size + 1]) if b - a >= size else window_hashes(h[a:b], b - a, 7) if b > a else np.zeros(0, U64))
    return out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return base[:n], base[n:] | U64(1)


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minhashes of 32 bits for each set; an empty set has the largest value everywhere."""
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        values = np.concatenate([sets[i] for i in some])
        start = np.concatenate(([0], np.cumsum([len(sets[i]) for i in some])[:-1]))
        for j, (add, times) in enumerate(zip(*_seeds(n), strict=True)):
            x = (values ^ add) * times
            x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
            out[some, j] = np.minimum.reduceat((x >> U64(32)).astype(np.uint32), start)
    return out


def sketcher(shingle: int, n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("mh", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for cols, words in word_chunks(batches, lower_words):
            sets = shingle_sets(words, hashes, shingle)
            mh = minhashes(sets, n)
            sig = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), pa.array(mh.reshape(-1).view(np.int32)))
            columns = [pa.array(cols["doc_id"], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1]), flat]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches()

    return run


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
KEYED = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("root", pa.int64())])
JUDGED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def band_keys(mh: np.ndarray) -> np.ndarray:
    """All m squared table keys of each row of 4m minhashes."""
    m = mh.shape[1] // 4
    pairs = (mh[:, 0::2].astype(U64) << U64(32)) | mh[:, 1::2].astype(U64)
    pairs = mix(pairs + _seeds(2 * m)[0][None, :])
    return mix(pairs[:, :m, None] * U64(0x9E3779B97F4A7C15) + pairs[:, None, m:]).reshape(len(mh), m * m)


def bander(rows: str = "all"):
    """Keys of classes (rep, root, mh) as rows (key, doc, root), by which rows one wants.

    ``all`` of them; ``some``, as many as a collection has pairs; or the
    ``first`` document of each root that has a key, among those of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys = band_keys(batch.column(2).flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, -1))
            if rows == "some":
                keys = keys[:, :: math.isqrt(keys.shape[1]) + 1]
            n = keys.shape[1]
            key, doc, root = signed(keys.reshape(-1)), np.repeat(doc, n), np.repeat(root, n)
            if rows == "first":
                _, place, count = np.unique(root[::n], return_inverse=True, return_counts=True)
                family = np.repeat(count[place] > 1, n)
                some = np.flatnonzero(family)
                order = some[np.lexsort((doc[some], root[some], key[some]))]
                again = (key[order][1:] == key[order][:-1]) & (root[order][1:] == root[order][:-1])
                keep = ~family
                keep[order[np.concatenate(([True], ~again))[: len(order)]]] = True
                key, doc, root = key[keep], doc[keep], root[keep]
            yield from batches_of(KEYED, [key, doc, root])

    return run


def linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of ``bander`` sorted by (key, doc): links (a, b) that span the roots of every key's members.

    About one document in HUB is a hub, by a hash of its id. Every member is
    linked to the last hub before it, or else to the key's first member; hubs
    too. So a document has the same few partners in all the keys that it shares
    with a family, and no hub has many. Links within a root are known and left
    out. Holds one batch, one row and the links found.
    """
    carry: tuple[int, ...] | None = None
    found: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k, d, r = (batch.column(i).to_numpy() for i in range(3))
        if carry:
            k, d, r = (np.concatenate(([x], y)) for x, y in zip(carry, (k, d, r), strict=True))
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        hub = new | (mix(d.view(U64) * U64(0x9E3779B97F4A7C15)) % U64(HUB) == 0)
        last = np.maximum.accumulate(np.where(hub, np.arange(len(k)), 0))
        i = np.flatnonzero(~new)
        to = last[i - 1]
        other = (r[i] != r[to]) & (d[i] != d[to])
        found.append(np.stack((d[i[other]], d[to[other]]), 1))
        rows += int(other.sum())
        carry = int(k[-1]), int(d[last[-1]]), int(r[last[-1]])
        if rows >= LINKS:
            links = np.unique(np.concatenate(found), axis=0)
            yield from batches_of(LINK, [links[:, 0], links[:, 1]])
            found, rows = [], 0
    if rows:
        links = np.unique(np.concatenate(found), axis=0)
        yield from batches_of(LINK, [links[:, 0], links[:, 1]])


def judge(least: int):
    """Links (a, b, mh_a, mh_b): (a, b, NONE) of those that agree in ``least`` minhashes, of others (a, b, key) for each key that both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x, y = (batch.column(i).flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            good = (x == y).sum(1) >= least
            yield from batches_of(JUDGED, [a[good], b[good], np.full(int(good.sum()), NONE)])
            if not good.all():
                one, two = band_keys(x[~good]), band_keys(y[~good])
                row, column = np.nonzero(one == two)
                yield from batches_of(JUDGED, [a[~good][row], b[~good][row], signed(one[row, column])])

    return run


def shortener(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, the last byte of each of its minhashes): documents agree in no fewer bytes than minhashes."""
    schema = pa.schema([("doc", pa.int64()), ("short", pa.binary())])
    for batch in batches:
        if batch.num_rows:
            short = batch.column(1).flatten().to_numpy().view(np.uint32).astype(np.uint8).reshape(batch.num_rows, -1)
            yield from batches_of(schema, [batch.column(0).to_numpy(), [x.tobytes() for x in short]])


def comparer(least: int):
    """Of each group (part, g, p, q) links that connect every left row and right row, of different roots, that agree in ``least`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part", "g", "p", "q"]):
            doc, root = group.column("doc").to_numpy(), group.column("root").to_numpy()
            short = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(len(doc), -1)
            is_left = group.column("is_left").to_numpy()
            left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
            label = np.unique(root, return_inverse=True)[1]
            columns, links = np.ascontiguousarray(short[right].T), []
            for start in range(0, len(left), BLOCK):
                rows = left[start : start + BLOCK]
                agree = np.zeros((len(rows), len(right)), np.uint8)
                for j, column in enumerate(columns):
                    agree += short[rows, j][:, None] == column[None, :]
                i, j = np.nonzero((agree >= least) & (label[rows][:, None] != label[right][None, :]))
                # Each pair of labels once; they are one from then on.
                _, first = np.unique(np.stack((label[rows[i]], label[right[j]]), 1), axis=0, return_index=True)
                for x, y in zip(rows[i[first]], right[j[first]], strict=True):
                    if label[x] != label[y]:
                        label[label == label[y]] = label[x]
                        links.append((doc[x], doc[y]))
            if links:
                yield from batches_of(LINK, list(zip(*links, strict=True)))

    return run


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes each set of ``left`` shares with each of ``right`` (places in ``sets``)."""
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    column = np.cumsum(np.concatenate(([0], (np.diff(column) > 0).astype(np.int64)))) if len(column) else column
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        one = np.zeros((len(sets), width), np.float32)
        one[row[a:b], column[a:b] - start] = 1
        out += one[left] @ one[right].T
    return out


def verifier(shingle: int, percent: int):
    """Of each group of texts the exact links between its left and its right rows, as stars; a row may be both."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        found: tuple[list, list] = ([], [])
        for group in grouped(batches, ["root", "p", "q"]):
            doc = group.column("doc_id").to_numpy()
            text = group.column("text").cast(pa.binary())
            sets = shingle_sets([lower_words(text[i].as_py() or b"") for i in range(len(doc))], hashes, shingle)
            left, right = (np.flatnonzero(group.column(side).to_numpy(zero_copy_only=False)) for side in ("is_left", "is_right"))
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets], np.float64)
            both = _intersections(sets, left, right).astype(np.float64)
            link = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (size[left][:, None] > 0)
            label = np.arange(len(doc))
            while True:
                new = label.copy()
                np.minimum.at(new, left, np.where(link, label[right][None, :], len(doc)).min(1))
                np.minimum.at(new, right, np.where(link, label[left][:, None], len(doc)).min(0))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(doc)))
            found[0].append(doc[moved])
            found[1].append(doc[label[moved]])
            if sum(map(len, found[0])) > 50_000:
                yield from batches_of(schema, [np.concatenate(x) for x in found])
                found = ([], [])
        if found[0]:
            yield from batches_of(schema, [np.concatenate(x) for x in found])

    return run


def _confirmed(docs: DataFrame, clusters: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever the exact similarity graph of each cluster (node, root) connects.

    A cluster of up to BLOCK members is one block, compared whole. Larger ones
    are compared within blocks and with their pivots, which takes a number of
    rows linear in their size. Two members of one component found so need no
    further comparison: only members outside the largest component meet all
    members, again in blocks. No cluster needs that if its pivots link it.
    """

    def compared(placed: DataFrame) -> DataFrame:
        rows = docs.join(placed, docs["doc_id"] == placed["node"]).select("root", "p", "q", "is_left", "is_right", "doc_id", "text")
        dealt = rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
        return dealt.mapInArrow(tidy(verifier(shingle, percent)), "a long, b long")

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    blocks_of = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    members = thin(clusters.join(thin(sizes), "root")).withColumn("blocks", blocks_of("n")).withColumn("block", F.pmod(F.hash("node"), "blocks"))
    home = members.select("root", F.col("block").alias("p"), zero.alias("q"), yes.alias("is_left"), yes.alias("is_right"), "node")
    pivots = members.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("node"), "n") < PIVOTS))
    pivots = pivots.withColumn("p", F.explode(F.sequence(zero, F.col("blocks") - 1))).where("p <> block")
    first = cut(thin(compared(home.unionByName(pivots.select("root", "p", zero.alias("q"), no.alias("is_left"), yes.alias("is_right"), "node")))))
    large = cut(members.where("blocks > 1").select("root", "node", "n", "blocks"))
    if large.isEmpty():
        return first
    near = components(first.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
    own = cut(thin(large.join(near.withColumnRenamed("root", "part"), "node", "left")).withColumn("part", F.coalesce("part", "node")))
    parts = thin(own.groupBy("root", "part").agg(F.count("*").alias("size")))
    # Cut, so that the join has no aggregate beside it and a cluster of very many members can be split.
    largest = cut(thin(parts.groupBy("root").agg(F.max(F.struct("size", "part")).alias("most"))))
    own = thin(own.join(largest, "root")).where(F.col("most.size") < F.col("n")).withColumn("rest", F.col("n") - F.col("most.size"))
    # Salted hashes: members of one block above fall into different ones here.
    own = own.withColumn("rows", blocks_of("rest")).withColumn("at", F.xxhash64("node", F.lit(1)))
    left = own.where("part <> most.part").withColumn("q", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    left = left.select("root", F.pmod("at", "rows").cast("int").alias("p"), "q", yes.alias("is_left"), no.alias("is_right"), "node")
    right = own.withColumn("p", F.explode(F.sequence(zero, F.col("rows") - 1)))
    right = right.select("root", "p", F.pmod("at", "blocks").cast("int").alias("q"), no.alias("is_left"), yes.alias("is_right"), "node")
    return first.unionByName(compared(left.unionByName(right)))


def _judged(classes: DataFrame, keyed: DataFrame, least: int) -> DataFrame:
    """Links of ``linker`` between members of keys, judged; see ``judge``."""
    links = keyed.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(tidy(linker), "a long, b long").distinct()
    own = lambda side: classes.select(F.col("rep").alias(side), F.col("mh").alias(f"mh_{side}"))
    pairs = thin(thin(thin(links).join(own("a"), "a")).join(own("b"), "b").select("a", "b", "mh_a", "mh_b"))
    return cut(pairs.mapInArrow(tidy(judge(least)), "a long, b long, key long"))


def candidates(classes: DataFrame, least: int) -> DataFrame:
    """Clusters (node, root) that connect any two of ``classes`` (rep, mh) with a common key and ``least`` equal minhashes.

    The links of ``linker`` span each key; those that agree make clusters, first
    by a tenth of the keys, then by all keys, where a cluster's members count
    once. A key whose members lie in several clusters holds a link that
    disagrees, so such keys are known. In each of them the members outside its
    largest cluster meet each other, and that cluster's members: these travel
    once a cluster, not once a key. Both meet by sketches in blocks of ROWS and
    COLUMNS, spread over tasks. That is a square of the members of a key that
    lie outside its largest cluster, and of nothing else.
    """
    keys = lambda rows, which: rows.select("rep", "root", "mh").mapInArrow(tidy(bander(which)), "key long, doc long, root long")
    rooted = lambda clusters: classes.join(clusters.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    agreed = lambda judged: judged.where(F.col("key") == NONE).select("a", "b")
    early = agreed(_judged(classes, keys(classes.withColumn("root", F.col("rep")), "some"), least))
    judged = _judged(classes, keys(rooted(components(early)), "first"), least)
    good = cut(early.unionByName(agreed(judged)))
    clusters = cut(thin(components(good)))
    named = lambda side: clusters.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    bad = thin(thin(judged.where(F.col("key") != NONE).join(named("a"), "a", "left")).join(named("b"), "b", "left"))
    open_keys = cut(thin(bad.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("key").distinct()))
    n = open_keys.count()
    if not n:
        return clusters
    small = F.broadcast if n <= FEW_KEYS else lambda frame: frame
    members = cut(thin(keys(rooted(clusters), "all").join(small(open_keys), "key", "left_semi")))
    sizes = thin(members.groupBy("key", "root").agg(F.count("*").alias("n")))
    # Cut, so that the join below has no aggregate beside it and a key of very many members can be split.
    largest = cut(thin(sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("most"))))
    outside = cut(members.join(small(largest), "key").where("root <> most").select("key", "doc", "root", "most"))
    met = outside.select("most").distinct().withColumnRenamed("most", "root")
    row = lambda part, g: (F.lit(part).alias("part"), F.col(g).alias("g"), "doc", "root")
    left = outside.select(*row(0, "most")).distinct().unionByName(outside.select(*row(1, "key")))
    right = members.select("doc", "root").distinct().join(met, "root", "left_semi").select(*row(0, "root")).unionByName(outside.select(*row(1, "key")))
    both = left.withColumn("is_left", F.lit(True)).unionByName(right.withColumn("is_left", F.lit(False)))
    both = cut(thin(thin(both).join(classes.select("rep", "mh").mapInArrow(shortener, "doc long, short binary"), "doc")))
    blocks = lambda is_left, rows: F.greatest(F.ceil(F.sum((F.col("is_left") == is_left).cast("long")) / rows), F.lit(1)).cast("int")
    counts = both.groupBy("part", "g").agg(blocks(True, ROWS).alias("ps"), blocks(False, COLUMNS).alias("qs"))
    own_block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Where only one block stands on the other side, as nearly always, no row is sent twice.
    dealt = thin(both.join(cut(thin(counts)), ["part", "g"]))
    lefts = dealt.where("is_left").withColumn("p", own_block("ps")).withColumn("q", all_blocks("qs"))
    rights = dealt.where("NOT is_left").withColumn("q", own_block("qs")).withColumn("p", all_blocks("ps"))
    columns = ("part", "g", "p", "q", "doc", "root", "short", "is_left")
    group = ("part", "g", "p", "q")
    more = lefts.select(*columns).unionByName(rights.select(*columns)).repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(comparer(least)), "a long, b long")
    return components(good.unionByName(more))


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets are similar enough.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set holds its distinct shingles of ``shingle`` words, or its
    whole sequence if it has fewer. Documents with 100 * intersection at least
    ``percent`` * union are linked. One row per input row: doc_id, n_shingles,
    component_id (the least doc_id reachable over links) and kept (doc_id =
    component_id). Texts without words are linked with nothing, not even each
    other. Rows that share a doc_id are one document. A row with a null doc_id
    links nothing: component_id is null and kept false. Extra columns are
    ignored; an empty table gives no rows.

    Equal sets are one class from the start (a pre-aggregated group-by), so
    exact copies never meet. A similar pair shares a key but for a chance of
    MISS, and agrees in enough minhashes to be compared but for another; see
    ``candidates``. Clusters are only candidates; ``_confirmed`` compares full
    sets, in blocks that are spread over tasks. What it compares grows with a
    cluster's size times the number of its members outside its largest
    component, and it emits no more than a star for each two blocks.
    """
    similarity = percent / 100
    m = collection_size(similarity)
    docs = texts(documents)
    sketches = cut(docs.mapInArrow(tidy(sketcher(shingle, 4 * m)), "doc_id long, n_shingles long, s1 long, s2 long, mh array<int>"))
    classes = cut(sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("mh").alias("mh")))
    clusters = candidates(classes.select("rep", "mh"), least_agreement(similarity, 4 * m))
    found = components(_confirmed(docs, clusters, shingle, percent))
    merged = classes.select("s1", "s2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"))
    rows = sketches.select("doc_id", "n_shingles", "s1", "s2").join(merged.hint("merge"), ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
