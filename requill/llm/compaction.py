"""Size-tiered compaction of immutable shards under a versioned manifest.

DataFrame functions move the rows; the driver handles shard names and sizes
only, as a table format does with its metadata.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of shards that one job merges; the next job follows it.
JOB_GROUPS = 500
#: Times that a change is tried again on top of what another writer has committed.
TRIES = 20


@dataclass(frozen=True)
class Shard:
    """One immutable Parquet file: its path below the store's data folder, its bytes, and the version its rows came with."""

    path: str
    size: int
    order: int = 0

    @property
    def run(self) -> str:
        return self.path.rsplit("/", 1)[0]


@dataclass
class Manifest:
    version: int = 0
    shards: list[Shard] = field(default_factory=list)


class VersionConflict(RuntimeError):
    """Another writer has committed this version, or has merged the same shards."""


class ShardStore:
    """A table of shards in a folder of any file system that Spark knows.

    Rows of a null, empty or repeated kind are stored as they come, with all
    columns. An append of no rows commits nothing. Every version stays readable
    until ``vacuum`` takes its files. A lost writer leaves files that no
    manifest names; they are never read, and ``vacuum`` removes them.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20) -> None:
        self.spark, self.path, self.target, self.fanout, self.smallest = spark, path.rstrip("/"), target, fanout, smallest
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifest

    def _list(self, name: str) -> list:
        folder = self._path(f"{self.path}/{name}")
        return list(self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def versions(self) -> list[int]:
        """Those that can be read, in order."""
        names = (s.getPath().getName() for s in self._list("_manifest"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or that of a version; an empty one before the first commit."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return Manifest()
        if version not in known:
            raise ValueError(f"no version {version}")
        stream = self._fs.open(self._path(f"{self.path}/_manifest/{version:012d}.json"))
        try:
            read = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return Manifest(read["version"], [Shard(**s) for s in read["shards"]])

    def commit(self, base: Manifest, shards: list[Shard]) -> Manifest:
        """Make ``shards`` version base + 1, or raise VersionConflict if another writer was there first.

        The manifest is written aside and then given its name in one step that
        fails where the name is taken: a hard link on local disks, a rename
        elsewhere, which HDFS refuses if the target exists. A store whose rename
        overwrites needs a lock of its own around writers.
        """
        new = Manifest(base.version + 1, shards)
        aside = self._path(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        final = self._path(f"{self.path}/_manifest/{new.version:012d}.json")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
        stream.close()
        taken = True
        try:
            if self._fs.getScheme() == "file":
                here = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self._jvm.java.nio.file.Files.createLink(here(final), here(aside))
                    taken = False
                except Exception as e:
                    if "FileAlreadyExists" not in str(e):
                        raise
            else:
                taken = self._fs.exists(final) or not self._fs.rename(aside, final)
        finally:
            self._fs.delete(aside, False)
        if taken:
            raise VersionConflict(f"version {new.version} is taken")
        return new

    def change(self, add: list[Shard], remove: list[Shard] = ()) -> Manifest:
        """Commit shards added and removed on top of whatever is the latest version by then."""
        gone = {s.path for s in remove}
        for _ in range(TRIES):
            base = self.manifest()
            if not gone <= {s.path for s in base.shards}:
                raise VersionConflict("another writer has merged these shards")
            made = [Shard(s.path, s.size, s.order or base.version + 1) for s in add]
            try:
                return self.commit(base, [*(s for s in base.shards if s.path not in gone), *made])
            except VersionConflict:
                continue
        raise VersionConflict(f"lost {TRIES} times to other writers")

    # -- shards

    def _written(self, folder: str, order: int = 0) -> list[Shard]:
        found = [s for s in self._list(f"data/{folder}") if s.getPath().getName().startswith("part-")]
        return sorted((Shard(f"{folder}/{s.getPath().getName()}", s.getLen(), order) for s in found), key=lambda s: s.path)

    def append(self, rows: DataFrame) -> Manifest:
        """Add rows as one run of small shards, as they are partitioned, and commit."""
        run = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{run}")
        if self.spark.read.parquet(f"{self.path}/data/{run}").isEmpty():
            return self.manifest()
        return self.change(self._written(run))

    def arrive(self, rows: DataFrame, arrival: str) -> Manifest:
        """Append rows that carry their arrival in a column, written in one pass; arrivals are committed in order.

        The column must name a bounded number of arrivals; it isn't stored.
        """
        stage = f"run-{uuid.uuid4().hex}"
        rows.write.partitionBy(arrival).parquet(f"{self.path}/data/{stage}")
        folders = sorted((s.getPath().getName() for s in self._list(f"data/{stage}") if s.isDirectory() and "=" in s.getPath().getName()), key=lambda n: (len(n), n))
        made = self.manifest()
        for folder in folders:
            made = self.change(self._written(f"{stage}/{folder}"))
        return made

    def tier(self, size: int) -> int:
        """0 up to ``smallest`` bytes a shard, one more for each ``fanout`` times that."""
        tier, bound = 0, self.smallest
        while size > bound and bound < self.target:
            tier, bound = tier + 1, bound * self.fanout
        return tier

    def plan(self, manifest: Manifest) -> list[list[Shard]]:
        """Groups of two shards or more, each to become one: for every tier with ``fanout`` shards under half the target.

        A tier's shards fill groups in the order they came, up to the target's
        bytes. As all are under half the target, a group is over half of it but
        for a tier's last.
        """
        tiers: dict[int, list[Shard]] = {}
        for shard in sorted(manifest.shards, key=lambda s: (s.order, s.path)):
            if 2 * shard.size < self.target:
                tiers.setdefault(self.tier(shard.size), []).append(shard)
        groups: list[list[Shard]] = []
        for _, shards in sorted(tiers.items()):
            if len(shards) >= self.fanout:
                size = self.target
                for shard in shards:
                    if size + shard.size > self.target:
                        groups.append([])
                        size = 0
                    groups[-1].append(shard)
                    size += shard.size
        return [g for g in groups if len(g) > 1]

    def compact(self) -> Manifest:
        """Merge shards of full tiers until no tier is full; a round is committed at once.

        A round's groups are merged side by side, JOB_GROUPS of them in a job, each
        read and written by one task without a shuffle. Merged shards stay for
        older versions. Every round leaves fewer shards, and at the end fewer
        than ``fanout`` small ones are left in a tier.
        """
        made = self.manifest()
        session = self.spark.newSession()
        # Else a union of single partitions would be a single partition.
        session.conf.set("spark.sql.unionOutputPartitioning", "false")
        while groups := self.plan(made):
            run = f"run-{uuid.uuid4().hex}"
            schema = self._rows([s for g in groups for s in g]).schema
            written = []
            for start in range(0, len(groups), JOB_GROUPS):
                part = f"{run}/{start // JOB_GROUPS}"
                chosen = groups[start : start + JOB_GROUPS]
                rows = [session.read.schema(schema).parquet(*self._paths(g)).coalesce(1) for g in chosen]
                reduce(DataFrame.union, rows).write.parquet(f"{self.path}/data/{part}")
                written += self._written(part, max(s.order for g in chosen for s in g))
            made = self.change(written, [s for g in groups for s in g])
        return made

    def vacuum(self, versions: int = 1, seconds: float = 7 * 24 * 3600) -> None:
        """Delete manifests older than ``seconds`` but for the latest ``versions``, and files so old that no manifest left names.

        The age spares the files of writers at work and of readers that still
        hold an older version; with 0 there must be none of them.
        """
        limit = (time.time() - seconds) * 1000
        known = self.versions()
        age = {s.getPath().getName(): s.getModificationTime() for s in self._list("_manifest")}
        kept = {v for v in known if age[f"{v:012d}.json"] > limit} | set(known[-max(versions, 1) :])
        named = {s.path for v in kept for s in self.manifest(v).shards}

        def clear(folder: str) -> bool:
            """Whether nothing is left in a folder."""
            empty = True
            for s in self._list(f"data/{folder}".rstrip("/")):
                name = f"{folder}/{s.getPath().getName()}".lstrip("/")
                if s.isDirectory():
                    gone = clear(name)
                else:
                    gone = name not in named and s.getModificationTime() <= limit
                if gone:
                    self._fs.delete(s.getPath(), True)
                empty &= gone
            return empty

        clear("")
        for v in known:
            if v not in kept:
                self._fs.delete(self._path(f"{self.path}/_manifest/{v:012d}.json"), False)

    def _paths(self, shards: list[Shard]) -> list[str]:
        return [f"{self.path}/data/{s.path}" for s in shards]

    def _rows(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*self._paths(shards))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version that ``vacuum`` hasn't taken. A store without shards has no schema and can't be read."""
        return self._rows(self.manifest(version).shards)


def compacted(documents: DataFrame, path: str, arrivals: int = 16, target: int = 128 << 20, fanout: int = 4) -> DataFrame:
    """Documents after arriving in ``arrivals`` parts and being compacted: doc_id, shard, run, version.

    A row arrives by a hash of its id, or, without one, of its text, so null ids
    arrive apart. One row per input row, with the file (shard) and run that hold
    it and the manifest version read. Extra columns are stored, whatever their
    names; an empty table gives no rows. Files of older versions are removed at
    the end, as nobody else knows the store.
    """
    spark = documents.sparkSession
    store = ShardStore(spark, path, target, fanout, smallest=max(1, target // fanout**3))
    arrival = "arrival"
    while arrival in {c.lower() for c in documents.columns}:
        arrival += "_"
    key = F.coalesce(F.xxhash64("doc_id", F.lit(0)), F.lit(0)) if "text" not in documents.columns else F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    store.arrive(documents.withColumn(arrival, F.pmod(key, F.lit(arrivals)).cast("int")), arrival)
    made = store.compact()
    store.vacuum(seconds=0)
    if not made.shards:
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("shard"), F.lit("").alias("run"), F.lit(made.version).cast("long").alias("version")).where("false")
    rows = store.read(made.version)
    file = F.input_file_name()
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.element_at(F.split(file, "/"), -1).alias("shard"), F.regexp_extract(file, "/data/(.+)/[^/]+$", 1).alias("run"), F.lit(made.version).cast("long").alias("version"))
