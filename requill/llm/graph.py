"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requill.llm.common import batches_of, cut, thin, tidy

#: Links that a task contracts at a time.
FOREST_LINKS = 500_000


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, centre) for each id of a block of links, the centre being the least id that the block connects it to."""
    schema = pa.schema([("node", pa.int64()), ("centre", pa.int64())])

    def contracted() -> Iterator[pa.RecordBatch]:
        links = np.concatenate(parts, axis=1)
        ids, place = np.unique(links, return_inverse=True)
        a, b = place.reshape(2, -1)
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            np.minimum.at(new, label[a], label[b])
            np.minimum.at(new, label[b], label[a])
            new = new[new][label]
            if (new == label).all():
                break
            label = new
        yield from batches_of(schema, [ids, ids[label]])

    parts: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            parts.append(np.stack([batch.column(i).to_numpy() for i in range(2)]))
            rows += batch.num_rows
        if rows >= FOREST_LINKS:
            yield from contracted()
            parts, rows = [], 0
    if parts:
        yield from contracted()


def _rounds(links: DataFrame) -> DataFrame:
    """(node, root) for every id in ``links`` (a, b), a <> b, by alternating stars; only two numbers a round reach the driver."""
    current, state = links, None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        current = cut(thin(small.select("e.a", "e.b").where("a <> b").distinct()))
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
        if state == (now.n, now.h):
            break
        state = now.n, now.h
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every id in ``edges`` (a, b): root is the least id reachable, the node itself included.

    Blocks of links are contracted within tasks first. An id takes the least of
    its blocks' centres; what it tells besides is which centres belong
    together, so only centres need more: one task if their links fit a block,
    else rounds of alternating stars, whose number grows with the logarithm of
    the longest chain. An id has no more centres than there are blocks, so no
    key of those rounds has many rows because a component is large. Repeated
    links and links of an id with itself are fine; no edges give no rows.
    """
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    blocks = thin(links).mapInArrow(tidy(forests), "node long, centre long")
    ids = cut(thin(blocks.groupBy("node").agg(F.collect_set("centre").alias("centres"))).select("node", F.array_min("centres").alias("p"), "centres"))
    between = ids.where(F.size("centres") > 1).select(F.explode("centres").alias("a"), F.col("p").alias("b")).where("a <> b")
    between = cut(thin(between.distinct()))
    n = between.count()
    linked = ids.select("node", "p")
    if not n:
        return linked.withColumnRenamed("p", "root")
    if n < FOREST_LINKS:
        rooted = between.coalesce(1).mapInArrow(tidy(forests), "p long, root long")
    else:
        rooted = _rounds(between).select(F.col("node").alias("p"), "root")
    return linked.join(rooted, "p", "left").select("node", F.coalesce("root", "p").alias("root"))
