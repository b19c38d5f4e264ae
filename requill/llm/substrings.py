"""Removal of passages that repeat anywhere in the corpus, by difference-cover anchors.

A window of ``window`` words is split as period + anchor - 1. Anchors are
hashed only at word positions whose remainder modulo the period lies in a
difference cover: for any two occurrences of a window some offset below the
period puts both on the cover, so they share an aligned anchor. Windows around
anchors that repeat are then extended to full windows, whose 96-bit hashes
decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from requill.llm.common import PACKED, LocalRepeats, WordHashes, buckets_of, find_repeats, identified, offsets, unpack_positions, window_hashes, word_chunks

#: Perfect difference sets by period. Every difference modulo the period occurs among their members.
COVERS = {1: (0,), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}


def period_for(window: int) -> int:
    """The longest period that leaves anchors of more than a third of the window."""
    return max(p for p in COVERS if p == 1 or 3 * (window - p + 1) > window)


def _starts_of_documents(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, and each word's document (its row) and position."""
    off = offsets(words)
    row = np.repeat(np.arange(len(words)), np.diff(off))
    return off, row, np.arange(off[-1]) - off[row]


def anchors(window: int, buckets: int):
    period = period_for(window)
    length = window - period + 1
    on_cover = np.isin(np.arange(period), COVERS[period])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, local = WordHashes(), LocalRepeats(buckets)
        for cols, words in word_chunks(batches, bytes.split, ("row",)):
            off, row, pos = _starts_of_documents(words)
            h = hashes.of([w for doc in words for w in doc])
            keys = window_hashes(h, length)
            row, pos = row[: len(keys)], pos[: len(keys)]
            size = np.diff(off)[row]
            keep = on_cover[pos % period] & (size >= window) & (pos + length <= size)
            yield from local.add(keys[keep], None, np.array(cols["row"], np.int64), row[keep], pos[keep].astype(np.int32))
        yield from local.flush()

    return run


def full_windows(window: int, buckets: int):
    """Hashes of the windows that hold a repeated anchor; ``at`` lists these anchors."""
    period = period_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, local = WordHashes(), LocalRepeats(buckets)
        for batch in batches:
            some = batch.filter(pa.compute.is_valid(batch.column("at")))
            for cols, words in word_chunks(iter([some]), bytes.split, ("row", "at")):
                off = offsets(words)
                h = hashes.of([w for doc in words for w in doc])
                key, extra = window_hashes(h, window, 1), (window_hashes(h, window, 2) >> np.uint64(32)).astype(np.uint32)
                step = np.zeros(len(h) + 1, np.int32)
                for i, at in enumerate(cols["at"]):
                    at = unpack_positions(at)
                    last = len(words[i]) - window
                    np.add.at(step, off[i] + np.maximum(at - period + 1, 0), 1)
                    np.add.at(step, off[i] + np.minimum(at, last) + 1, -1)
                start = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                row = np.searchsorted(off, start, "right") - 1
                yield from local.add(key[start], extra[start], np.array(cols["row"], np.int64), row, (start - off[row]).astype(np.int32))
        yield from local.flush()

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def remover(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = RESULT if with_text else pa.schema(list(RESULT)[:-1])
        for batch in batches:
            out = [[] for _ in schema]
            ids, at, text = (batch.column(k) for k in ("doc_id", "at", "text"))
            text = text.cast(pa.binary())
            for i in range(batch.num_rows):
                words = (text[i].as_py() or b"").split()
                n = len(words)
                if at[i].is_valid:
                    step = np.zeros(n + 1, np.int32)
                    s = unpack_positions(at[i].as_py())
                    step[s] += 1
                    np.add.at(step, s + window, -1)
                    gone = np.cumsum(step)[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                row = (ids[i].as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def remove_repeats(documents: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window that also starts anywhere else in ``documents``.

    Words are runs of anything but ASCII white space. Returns one row per input
    row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space) and, ``with_text``, kept (those words). Windows are judged on the
    input: a passage repeated within one text, or in a repeated row, counts.
    A null or empty text has no words and keeps the empty string; a document of
    fewer words than the window keeps all. Every row is judged for itself, so
    null and shared ids don't matter. Extra columns are ignored.

    The text is shuffled once, by row, and that exchange is read twice. Keys are
    pre-aggregated in each map task, so that a passage in a third of all
    documents sends one row a task. Keys are dealt to buckets whose number
    follows the input's size (``buckets_of``); a bucket is held packed, about 15
    bytes a key, and sorted by ranges.
    """
    docs = identified(documents)
    n = buckets_of(documents)
    near = find_repeats(docs.mapInArrow(anchors(window, n), PACKED), n)
    windows = docs.join(near.hint("merge"), "row", "left").mapInArrow(full_windows(window, n), PACKED)
    found = find_repeats(windows, n)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return docs.join(found.hint("merge"), "row", "left").mapInArrow(remover(window, with_text), schema)
