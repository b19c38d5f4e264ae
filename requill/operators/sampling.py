"""Samples of all tables in which no foreign key dangles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requill.plans.catalyst import message
from requill.sources.catalog import Catalog, ForeignKey
from requill.sources.engine import Engine


@dataclass
class SampleStats:
    percent: float
    counts: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(self.counts.values())

    @property
    def problems(self) -> list[str]:
        return [f"{t}: {e}" for t, e in sorted(self.errors.items())]

    def describe(self) -> str:
        text = f"{self.rows:,} rows in {len(self.counts)} tables at {self.percent:g} %"
        return "\n".join([text, *(f"  {t}: {n:,}" for t, n in sorted(self.counts.items())), *(f"  failed {p}" for p in self.problems)])


def hashed_sample(rows: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key's MD5 begins low: the same ones on any engine, and all rows of a key or none."""
    return rows.where(F.substring(F.md5(F.col(key).cast("string")), 1, 4) < f"{min(0xFFFF, round(share * 0x10000)):04x}")


def with_parents(rows: DataFrame, keys: list[ForeignKey], parents: dict[str, DataFrame]) -> DataFrame:
    """Rows all of whose foreign keys are null or find their parent: a semi-join for each key, over all its columns at once."""
    for key in keys:
        if key.parent not in parents or key.parent == key.child:
            continue
        named = [f"__parent_{i}" for i in range(len(key.parent_columns))]
        parent = parents[key.parent].select(*(F.col(c).alias(n) for c, n in zip(key.parent_columns, named, strict=True)))
        condition = None
        for c, n in zip(key.child_columns, named, strict=True):
            one = F.col(c) == F.col(n)
            condition = one if condition is None else condition & one
        empty = F.lit(False)
        for c in key.child_columns:
            empty = empty | F.col(c).isNull()
        # A null key refers to nothing and stays; its rows pass beside the join.
        rows = rows.where(~empty).join(parent, condition, "left_semi").unionByName(rows.where(empty))
    return rows


def build_sample(engine: Engine, catalog: Catalog, percent: float = 1.0, max_rows: int = 200_000, seed: int = 7) -> tuple[Engine, SampleStats]:
    """An engine of a session of its own whose views are samples under the tables' names.

    Statements run there unchanged: a common table expression of a table's name
    shadows it as usual. Only tables without parents are thinned by ``percent``;
    others follow from their parents, so that rates don't multiply along a
    chain. A table linked to itself keeps links within its own sample open. A
    table that fails is left out and reported.
    """
    target, stats, made = engine.isolated(), SampleStats(percent), {}
    for table in catalog.order_for_sampling():
        try:
            if engine.folder is None:
                raise ValueError("samples are read from a folder of tables")
            rows = target.spark.read.parquet(f"{engine.folder}/{table}.parquet")
            keys = [k for k in catalog.foreign_keys if k.child == table and k.parent in made]
            rows = with_parents(rows, keys, made) if keys else rows.sample(max(percent, 0.0001) / 100, seed)
            rows = rows.cache()
            if rows.count() > max_rows:
                # By a hash of the whole row, so that the same rows stay each time.
                rows = rows.orderBy(F.xxhash64(F.lit(seed), F.struct(*rows.columns)), *(c for c, t in rows.dtypes if not t.startswith("map"))).limit(max_rows).cache()
            stats.counts[table] = rows.count()
            made[table] = rows
            target.register(table, rows)
        except Exception as e:
            stats.errors[table] = message(e, 160)
    return target, stats


def release(sample: Engine) -> None:
    """Drop a sample's views and cached rows."""
    for table in sample.tables:
        sample.spark.table(table).unpersist()
        sample.spark.catalog.dropTempView(table)
    sample.tables.clear()


def dangling(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Rows of a child whose key is not null and has no parent."""
    test = None
    for c, p in zip(key.child_columns, key.parent_columns, strict=True):
        one = child[c] == parent[p]
        test = one if test is None else test & one
    return child.dropna(subset=list(key.child_columns)).join(parent, test, "left_anti")
