"""Shared pieces: word hashing, window hashing, grouped streaming, checkpoints."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Entries a worker's word cache holds before it starts afresh; bounds its memory.
CACHE_WORDS = 300_000
#: Words that one vectorised step works on; a longer document is a step of its own.
CHUNK_WORDS = 400_000

U64 = np.uint64
_M1, _M2, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names, or, on a local master only, a temporary one that goes when Python ends.

    A cluster's executors can't see a folder of the driver's, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="requill-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Partitions of links and ids that one task reads.
THIN = 16


def thin(df: DataFrame) -> DataFrame:
    """Links, ids or counts, some hundredth of the texts' bytes, in a sixteenth of the tasks that a shuffle of texts takes: fewer and larger shuffle files."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // THIN))


#: glibc's call that gives freed memory back to the system; None where there is no such thing.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def give_back() -> None:
    """Freed memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, at whose end the worker gives back what it has freed.

    Workers stay for later tasks, and a task of two such steps takes two of
    them, so what idle ones hold adds to what busy ones need.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(29))) * _C
    return x ^ (x >> U64(32))


def window_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``h`` (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, U64)
    cur = mix(h + U64((seed * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))
    size, out, covered = 1, None, 0
    while True:
        if n & 1:
            if out is None:
                out, covered = cur, size
            else:
                m = len(h) - covered - size + 1
                out = mix(out[:m] * _M1 + cur[covered : covered + m])
                covered += size
        n >>= 1
        if not n:
            return out
        m = len(h) - 2 * size + 1
        if m > 0:
            cur = mix(cur[:m] * _M2 + cur[size : size + m])
        else:
            cur = np.zeros(0, U64)
        size *= 2


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def word_chunks(batches: Iterator[pa.RecordBatch], split, columns: tuple[str, ...] = ("doc_id",)) -> Iterator[tuple[dict, list[list[bytes]]]]:
    """Batches cut into steps of about CHUNK_WORDS words: (``columns``, words)."""
    for batch in batches:
        names = batch.schema.names
        cols = {k: batch.column(names.index(k)).to_pylist() for k in columns}
        texts = batch.column(names.index("text")).cast(pa.binary())
        start, words, n = 0, [], 0
        for i in range(batch.num_rows):
            words.append(w := split(texts[i].as_py() or b""))
            n += len(w)
            if n >= CHUNK_WORDS or i == batch.num_rows - 1:
                yield {k: v[start : i + 1] for k, v in cols.items()}, words
                start, words, n = i + 1, [], 0


def offsets(words: list[list[bytes]]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches_of(schema: pa.Schema, columns: list, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows from whole columns."""
    table = pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    yield from table.to_batches(max_chunksize=rows)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows sorted by ``keys``, one table each; a group is held whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.names.index(k)).to_pylist() for k in keys]
        ids = list(zip(*cols, strict=True))
        start = 0
        for i, key in enumerate(ids):
            if i and key != ids[i - 1]:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start = [], i
            elif not i and held and key != last:
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(start))
        last = ids[-1]
    if held:
        yield pa.Table.from_batches(held)


#: Rows that a map task gathers before it looks for equal keys among them.
LOCAL_ROWS = 1_500_000
#: Rows that are sorted at a time when repeats are sought.
SORT_ROWS = 2_000_000
PACKED = "bucket int, rows binary"


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes before all second ones: small numbers leave planes of zeros that compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


class Reader:
    """Takes arrays back out of the bytes of ``planes``."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = np.frombuffer(data, np.uint8), 0

    def take(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        part = self.data[self.at : self.at + size].reshape(np.dtype(kind).itemsize, n)
        self.at += size
        return np.ascontiguousarray(part.T).reshape(-1).view(kind)


class LocalRepeats:
    """Rows (key, extra bits of the key, document row, position), made ready to look for keys that repeat.

    Of the rows of a block (LOCAL_ROWS) that share a key only one is compared
    with other blocks, marked as shared; the others are known to repeat and
    travel by document. So no key has more compared rows than there are blocks.
    What goes to one bucket of the key space is packed into one value, sorted
    by key.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.parts: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self.rows = self.known_docs = 0

    def add(self, key: np.ndarray, extra: np.ndarray | None, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``row`` are places in ``doc``."""
        if len(key):
            self.parts.append((key, np.zeros(0, np.uint32) if extra is None else extra, row + self.known_docs, pos))
            self.docs.append(doc)
            self.known_docs += len(doc)
            self.rows += len(key)
        if self.rows >= LOCAL_ROWS:
            yield from self.flush()

    def _pack(self, key, extra, row, pos, shared, known_row, known_pos, docs) -> bytes:
        used = np.unique(np.concatenate((row, known_row)))
        head = np.array([len(key), len(extra), len(known_row), len(used)], np.int32).tobytes()
        place = lambda r: planes(np.searchsorted(used, r).astype(np.int32))
        body = planes(np.diff(docs[used], prepend=0)) + planes(np.diff(key, prepend=U64(0))) + planes(extra)
        return head + body + place(row) + planes(pos) + shared.astype(np.uint8).tobytes() + place(known_row) + planes(known_pos)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        key, extra, row, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        docs = np.concatenate(self.docs)
        self.__init__(self.buckets)
        order = np.lexsort((extra, key)) if len(extra) else np.argsort(key, kind="stable")
        key, extra, row, pos = key[order], extra[order] if len(extra) else extra, row[order], pos[order]
        known = np.zeros(len(key), bool)
        known[1:] = key[1:] == key[:-1]
        if len(extra):
            known[1:] &= extra[1:] == extra[:-1]
        shared = np.zeros(len(key), bool)
        shared[:-1] = known[1:] & ~known[:-1]
        known_row, known_pos = row[known], pos[known]
        key, extra, row, pos, shared = key[~known], extra[~known] if len(extra) else extra, row[~known], pos[~known], shared[~known]
        limits = np.searchsorted(bucket_of(key, self.buckets), np.arange(self.buckets + 1))
        spread = bucket_of(mix(docs[known_row].view(U64) + U64(1)), self.buckets)
        order = np.lexsort((known_pos, known_row, spread))
        known_row, known_pos = known_row[order], known_pos[order]
        known_limits = np.searchsorted(spread[order], np.arange(self.buckets + 1))
        buckets, packed = [], []
        for b in range(self.buckets):
            i, j, u, v = limits[b], limits[b + 1], known_limits[b], known_limits[b + 1]
            if i < j or u < v:
                buckets.append(b)
                packed.append(self._pack(key[i:j], extra[i:j] if len(extra) else extra, row[i:j], pos[i:j], shared[i:j], known_row[u:v], known_pos[u:v], docs))
        yield from batches_of(pa.schema([("bucket", pa.int32()), ("rows", pa.binary())]), [buckets, packed], 2000)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """An even cut of the key space, in the order of keys."""
    return ((key >> U64(32)) * U64(buckets)) >> U64(32)


def pack_positions(pos: np.ndarray) -> bytes:
    """Sorted positions as gaps of two bytes, or four after a mark."""
    gaps = np.diff(pos.astype(np.int64), prepend=0)
    return b"2" + gaps.astype(np.uint16).tobytes() if not len(gaps) or gaps.max() < 1 << 16 else b"4" + gaps.astype(np.uint32).tobytes()


def unpack_positions(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint16 if packed[:1] == b"2" else np.uint32, offset=1).astype(np.int64))


def by_document(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows sorted by document and position, and where each document begins."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    distinct = np.ones(len(doc), bool)
    distinct[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    doc, pos = doc[distinct], pos[distinct]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    return doc, pos, np.flatnonzero(new)


def repeated_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """From one bucket's packed rows those whose key occurs more than once, packed for buckets of documents."""
    parts, docs, n_docs = [], [], 0
    known: list[tuple] = []
    for batch in batches:
        for value in batch.column(batch.schema.names.index("rows")).to_pylist():
            n, n_extra, n_known, used = np.frombuffer(value[:16], np.int32).tolist()
            read = Reader(value[16:])
            docs.append(np.cumsum(read.take(used, np.int64)))
            key, extra = np.cumsum(read.take(n, np.uint64), dtype=U64), read.take(n_extra, np.uint32)
            parts.append((key, extra, read.take(n, np.int32) + n_docs, read.take(n, np.int32), read.take(n, np.uint8)))
            known.append((read.take(n_known, np.int32) + n_docs, read.take(n_known, np.int32)))
            n_docs += used
    if not docs:
        return
    docs = np.concatenate(docs)
    rows, places = [x[0] for x in known], [x[1] for x in known]
    total = sum(len(p[0]) for p in parts)
    steps = max(1, -(-total // SORT_ROWS))
    low = min((int(p[0][0]) for p in parts if len(p[0])), default=0)
    high = max((int(p[0][-1]) for p in parts if len(p[0])), default=0)
    for step in range(steps):
        a, b = (low + (high + 1 - low) * s // steps for s in (step, step + 1))
        # Keys below b: the last step's b may be past the largest 64-bit number.
        cuts = [slice(np.searchsorted(p[0], U64(a)), np.searchsorted(p[0], U64(b - 1), "right")) for p in parts]
        key, extra, row, pos, shared = (np.concatenate([p[i][c] for p, c in zip(parts, cuts, strict=True)]) for i in range(5))
        order = np.lexsort((extra, key)) if len(extra) else np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        if len(extra):
            same &= extra[order][1:] == extra[order][:-1]
        hit = shared[order] > 0
        hit[1:] |= same
        hit[:-1] |= same
        rows.append(row[order][hit])
        places.append(pos[order][hit])
    row, pos = np.concatenate(rows), np.concatenate(places)
    doc = docs[row]
    spread = bucket_of(mix(doc.view(U64) + U64(1)), buckets)
    order = np.argsort(spread, kind="stable")
    limits = np.searchsorted(spread[order], np.arange(buckets + 1))
    out: tuple[list, list] = ([], [])
    for b, (i, j) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)):
        if i < j:
            d, p, first = by_document(doc[order[i:j]], pos[order[i:j]])
            gaps = np.diff(p, prepend=0).astype(np.int32)
            gaps[first] = p[first]
            head = np.array([len(first), len(p)], np.int32).tobytes()
            out[0].append(b)
            out[1].append(head + planes(np.diff(d[first], prepend=0)) + planes(np.diff(first, append=len(p)).astype(np.int32)) + planes(gaps))
    yield from batches_of(pa.schema([("bucket", pa.int32()), ("rows", pa.binary())]), list(out), 2000)


def merged_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document row of a bucket: (row, its packed positions)."""
    parts: list[tuple] = []
    for batch in batches:
        for value in batch.column(batch.schema.names.index("rows")).to_pylist():
            n, total = np.frombuffer(value[:8], np.int32).tolist()
            read = Reader(value[8:])
            doc, count, gaps = np.cumsum(read.take(n, np.int64)), read.take(n, np.int32), read.take(total, np.int32)
            sums = np.cumsum(gaps.astype(np.int64))
            first = np.cumsum(count) - count
            pos = sums - np.repeat(np.concatenate(([0], sums))[first], count)
            parts.append((np.repeat(doc, count), pos.astype(np.int32)))
    if not parts:
        return
    doc, pos, first = by_document(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    packed = [pack_positions(x) for x in np.split(pos, first[1:])]
    yield from batches_of(pa.schema([("row", pa.int64()), ("at", pa.binary())]), [doc[first], packed], 20_000)


#: Input bytes whose keys go to one bucket.
BUCKET_BYTES = 64 << 20


def buckets_of(documents: DataFrame) -> int:
    """Buckets of the key space: as many as the session shuffles into, and more where the input is larger than that many BUCKET_BYTES.

    The input's bytes are Spark's own estimate, from the sizes of its files; an
    estimate of nothing known (a bare RDD) is passed over. So what a task holds
    of a bucket doesn't grow with the input.
    """
    spark = documents.sparkSession
    stats = documents._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    unknown = int(spark._jsparkSession.sessionState().conf().defaultSizeInBytes())
    wanted = -(-size // BUCKET_BYTES) if size < unknown else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, 1 << 20), 1)


def find_repeats(packed: DataFrame, buckets: int) -> DataFrame:
    """(row, at): for each document row that has any, the packed positions whose key occurs more than once anywhere."""
    found = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda rows: repeated_rows(rows, buckets), PACKED)
    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(merged_positions, "row long, at binary")


def texts(documents: DataFrame) -> DataFrame:
    """Just ``doc_id`` and ``text``: other columns, whatever their names, don't matter."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def numbered(documents: DataFrame, name: str) -> DataFrame:
    """``documents`` with a number of each row's own in the column ``name``, before all others.

    The number is a row's partition and place in it, which a table's files (or
    a checkpoint's) give alike each time they are read, also after the loss of
    an executor. Rows that come out of a shuffle have no such order, so these
    are checkpointed first. Repeated rows, shared ids and null ids stay apart.
    """
    if "Exchange" in documents._jdf.queryExecution().executedPlan().toString():
        documents = cut(documents)
    return documents.select(F.monotonically_increasing_id().alias(name), *(documents[c] for c in documents.columns))


def identified(documents: DataFrame) -> DataFrame:
    """(row, doc_id, text): every row under a number of its own; see ``numbered``."""
    return numbered(texts(documents), "row")


def beside(documents: DataFrame, compute, columns: str, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``documents`` (all, if not named) in a struct ``row``, and beside it ``columns``.

    ``compute`` gives a tuple of values for each of a batch's texts (bytes; a
    null text is empty). So what is found out about a row stays with it,
    whatever its id, and no join is needed.
    """
    kept = documents.columns if carry is None else carry
    rows = documents.select(F.struct(*(documents[c] for c in kept)).alias("row"), documents["text"].cast("string").alias("text"))
    found = StructType.fromDDL(columns)
    schema = StructType([rows.schema["row"], *found])
    kinds = to_arrow_schema(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(zip(*compute(raw(batch.column(1))), strict=True)) or [()] * len(kinds)
            arrays = [pa.array(v, f.type) for v, f in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *kinds.names])

    return rows.mapInArrow(tidy(run), schema)


def workspace(spark: SparkSession) -> str:
    """A new folder's path under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/requill-{os.urandom(8).hex()}"
