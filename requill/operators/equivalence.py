"""Whether two queries return the same multiset of rows, compared without leaving the cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requill.functions.values import common_type, normalised
from requill.plans.catalyst import message, same_result
from requill.sources.engine import Engine

EXAMPLES = 3


@dataclass(frozen=True)
class Equivalence:
    """equal: True, False, or None for unknown."""

    equal: bool | None
    reason: str = ""
    rows: int = 0
    columns: int = 0
    missing: tuple = ()
    extra: tuple = ()
    n_missing: int = 0
    n_extra: int = 0

    @property
    def status(self) -> str:
        return {True: "equal", False: "different", None: "unknown"}[self.equal]

    def describe(self) -> str:
        text = f"{self.status}: {self.reason}" if self.reason else f"{self.status}: {self.rows} rows, {self.columns} columns"
        for name, rows in (("missing", self.missing), ("extra", self.extra)):
            text += "".join(f"\n  {name} {row!r}" for row in rows)
        return text


def counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Copies of every row on both sides: c0.., copies_left, copies_right.

    One shuffle of pre-aggregated counts: sides are tagged, united and grouped,
    so a row that fills a third of a side sends one count a task.
    """
    kinds = [common_type(a.dataType, b.dataType) for a, b in zip(left.schema, right.schema, strict=True)]
    if None in kinds:
        i = kinds.index(None)
        raise TypeError(f"column {i + 1} is {left.schema[i].dataType.simpleString()} and {right.schema[i].dataType.simpleString()}")
    tagged = normalised(left, kinds).withColumn("side", F.lit(1)).union(normalised(right, kinds).withColumn("side", F.lit(-1)))
    keys = [c for c in tagged.columns if c != "side"]
    return tagged.groupBy(*keys).agg(F.count_if(F.col("side") == 1).alias("copies_left"), F.count_if(F.col("side") == -1).alias("copies_right"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose numbers of copies differ: c0.., copies_left, copies_right."""
    return counted(left, right).where("copies_left <> copies_right")


def compare_frames(original: DataFrame, candidate: DataFrame, limit: int | None = None) -> Equivalence:
    """Compare results as multisets, by column place; names and order of rows don't count.

    More rows than a ``limit`` on either side leave the question open.
    """
    if len(original.columns) != len(candidate.columns):
        return Equivalence(False, f"{len(original.columns)} columns against {len(candidate.columns)}")
    try:
        if same_result(original, candidate):
            return Equivalence(True, "the same optimized plan", -1, len(original.columns))
        if limit is not None and any(df.limit(limit + 1).count() > limit for df in (original, candidate)):
            return Equivalence(None, f"more than {limit} rows")
        try:
            both = counted(original, candidate)
        except TypeError as e:
            return Equivalence(False, str(e), columns=len(original.columns))
        gap = F.col("copies_left") - F.col("copies_right")
        total = lambda x: F.coalesce(F.sum(x), F.lit(0))
        # Each side is computed once: sizes and differences come from one aggregate.
        found = both.agg(total("copies_left").alias("rows"), total(F.greatest(gap, F.lit(0))).alias("missing"), total(F.greatest(-gap, F.lit(0))).alias("extra")).first()
        if not found.missing and not found.extra:
            return Equivalence(True, "", found.rows, len(original.columns))
        keys = [c for c in both.columns if not c.startswith("copies_")]
        rows = lambda test: tuple(tuple(r) for r in both.where(test).select(*keys).limit(EXAMPLES).collect())
        missing, extra = rows("copies_left > copies_right") if found.missing else (), rows("copies_left < copies_right") if found.extra else ()
        return Equivalence(False, f"{found.missing} rows missing, {found.extra} rows extra", found.rows, len(original.columns), missing, extra, found.missing, found.extra)
    except Exception as e:
        # That the cluster failed says nothing of the rows.
        return Equivalence(None, f"comparison failed: {message(e)}")


def compare(engine: Engine, original: str, candidate: str, limit: int | None = None) -> Equivalence:
    """Compare two statements on an engine's tables (a sample is an engine of its own)."""
    frames = []
    for name, sql in (("original", original), ("candidate", candidate)):
        try:
            frames.append(engine.query(sql))
        except Exception as e:
            return Equivalence(False, f"{name} failed: {message(e)}")
    return compare_frames(*frames, limit=limit)
