"""Benchmark decontamination with an FM-index per training shard.

A shard's words are reduced to the benchmark's vocabulary: runs of words that
some item uses, at least as long as the shortest window, parted by separators
(no occurrence can lie elsewhere). An FM-index over these runs answers every
window by backward search through wavelet-matrix ranks; occurrences are located
from sampled suffix positions, and the spans of a document are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requill.llm.common import CHUNK_WORDS, beside, offsets

#: Every byte that ends a word becomes a space, and A-Z its lower case.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Words of benchmark items that are searched as one block; each block is a broadcast of about this size.
BLOCK_WORDS = 500_000
#: Blocks of a benchmark at most: about 50 million words, of some 100 bytes each in a worker's memory.
MOST_BLOCKS = 100
#: Every so many suffix positions one is kept.
SAMPLE = 8


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


@dataclass
class Block:
    """Windows of some benchmark items over their own vocabulary (symbols from 1)."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # one window a row, padded with 0 at its front
    sizes: np.ndarray
    items: list[list]  # the ids of the items that have each window

    @classmethod
    def of(cls, items: list[tuple], window: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text))
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners.setdefault(ids[i : i + size], set()).add(item)
        keys = list(owners)
        windows = np.zeros((len(keys), window), np.int32)
        for row, key in zip(windows, keys, strict=True):
            row[window - len(key) :] = key
        return cls(vocabulary, windows, np.array([len(k) for k in keys], np.int64), [list(owners[k]) for k in keys])


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector with running counts for each bit."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(1, int(symbols.max(initial=0)).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            counts = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            zeros = len(symbols) - int(counts[-1])
            self.levels.append((bit, counts, zeros))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(at)
        for bit, counts, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            at = np.where(one, zeros + counts[at], at - counts[at])
            start = np.where(one, zeros + counts[start], start - counts[start])
        return at - start


class FMIndex:
    """Backward search over runs of symbols from 1; no match crosses the end of a run."""

    def __init__(self, runs: np.ndarray) -> None:
        """runs: symbols with a 0 after each run; the last is a 0."""
        n = len(runs)
        ends = runs == 0
        # Each end sorts as a symbol of its own, before all words: suffixes differ within a run's length.
        rank = np.where(ends, np.cumsum(ends), runs.astype(np.int64) + int(ends.sum()))
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-step or n] = rank[step:] + 1 if step < n else 0
            key = rank * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1]))) if n else np.zeros(0, np.int64)
            rank = np.empty(n, np.int64)
            rank[order] = new
            if not n or new[-1] == n - 1:
                break
            step *= 2
        self.size = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(runs, minlength=1)))).astype(np.int64)
        self.last = runs[order - 1]  # the symbol before each suffix; before the text stands its closing 0
        self.ranks = WaveletMatrix(self.last)
        begins = np.concatenate(([True], ends[:-1])) if n else np.zeros(0, bool)
        sampled = begins | (np.arange(n) % SAMPLE == 0)
        self.sampled = sampled[order]
        self.position = np.where(self.sampled, order, -1)

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window (padded at its front) the interval of suffixes that begin with it."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.size, np.int64)
        known = windows < len(self.first) - 1
        width = windows.shape[1]
        active = np.arange(len(windows))
        for j in range(width):
            active = active[(sizes[active] > j) & (low[active] < high[active])]
            symbol = windows[active, width - 1 - j]
            ok = known[active, width - 1 - j]
            high[active[~ok]] = low[active[~ok]]
            active, symbol = active[ok], symbol[ok]
            base = self.first[symbol]
            low[active], high[active] = base + self.ranks.rank(symbol, low[active]), base + self.ranks.rank(symbol, high[active])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            symbol = self.last[rows[todo]]
            rows[todo] = self.first[symbol] + self.ranks.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.position[rows] + steps


def _runs(symbols: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of known words within documents of ``least`` words or more: symbols with 0 after each run, and each one's word (-1 for 0)."""
    known = symbols > 0
    new = np.ones(len(symbols), bool)
    new[1:] = ~known[1:] | ~known[:-1] | (row[1:] != row[:-1])
    run = np.cumsum(new) - 1
    long = np.bincount(run, minlength=1)[run] >= least if len(run) else np.zeros(0, bool)
    keep = np.flatnonzero(known & long)
    last = np.ones(len(keep), bool)
    last[:-1] = run[keep][1:] != run[keep][:-1]
    at = np.arange(len(keep)) + np.concatenate(([0], np.cumsum(last)[:-1])) if len(keep) else np.zeros(0, np.int64)
    out, word = np.zeros(len(keep) + int(last.sum()), np.int64), np.full(len(keep) + int(last.sum()), -1, np.int64)
    out[at], word[at] = symbols[keep], keep
    return out, word


def occurrences(words: list[list[bytes]], block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in a shard; words count through its documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(block.sizes):
        return none
    off = offsets(words)
    get = block.vocabulary.get
    symbols = np.fromiter((get(w, 0) for doc in words for w in doc), np.int64, int(off[-1]))
    runs, word = _runs(symbols, np.repeat(np.arange(len(words)), np.diff(off)), int(block.sizes.min()))
    if not len(runs):
        return none
    index = FMIndex(runs)
    low, high = index.search(block.windows, block.sizes)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[which]
    return word[index.locate(rows)], which


OUT_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scanner(blocks: list, percent: int):
    """For a batch's texts the columns of OUT_DDL; a shard is about CHUNK_WORDS words of it."""

    def shard(words: list[list[bytes]]) -> Iterator[tuple]:
        off = offsets(words)
        found: dict[int, tuple[list, set]] = {}
        for shared in blocks:
            block = shared.value
            first, which = occurrences(words, block)
            row = np.searchsorted(off, first, "right") - 1
            order = np.argsort(row, kind="stable")
            bounds = np.flatnonzero(np.diff(row[order])) + 1
            for part in np.split(order, bounds) if len(order) else []:
                r = int(row[part[0]])
                spans, items = found.setdefault(r, ([], set()))
                a = first[part] - off[r]
                spans += _merged(a, a + block.sizes[which[part]])
                items.update(i for w in np.unique(which[part]).tolist() for i in block.items[w])
        for r in range(len(words)):
            spans, items = found.get(r, ([], set()))
            spans = _merged(np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64))
            n, hit = len(words[r]), sum(b - a for a, b in spans)
            named = ",".join(sorted(map(str, items)))
            yield n, hit, len(items), hashlib.sha256(named.encode()).hexdigest(), hit > 0 and 100 * hit >= percent * n, ",".join(f"{a}:{b}" for a, b in spans)

    def run(texts: list[bytes]) -> Iterator[tuple]:
        words, n = [], 0
        for text in texts:
            words.append(words_of(text))
            n += len(words[-1])
            if n >= CHUNK_WORDS:
                yield from shard(words)
                words, n = [], 0
        if words:
            yield from shard(words)

    return run


def benchmark_blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> list:
    """The benchmark as broadcast blocks of bounded size; its rows come to the driver one partition at a time.

    Items without words, or with a null id, are left out: the former occur nowhere and the latter have no name.
    More than MOST_BLOCKS blocks raise a ValueError: that is no query set any more.
    """
    sc = benchmark.sparkSession.sparkContext
    blocks, items, n = [], {}, 0
    rows = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].cast("string").alias("text")).dropna().distinct()
    for row in rows.toLocalIterator():
        text = row.text.encode()
        items[row.item, row.text] = (row.item, text)
        n += len(words_of(text))
        if n >= block_words:
            if len(blocks) >= MOST_BLOCKS:
                raise ValueError(f"the benchmark has more than {MOST_BLOCKS} blocks of {block_words} words")
            blocks.append(sc.broadcast(Block.of(list(items.values()), window)))
            items, n = {}, 0
    if items:
        blocks.append(sc.broadcast(Block.of(list(items.values()), window)))
    return blocks


def judged(documents: DataFrame, benchmark: DataFrame, window: int, percent: int, block_words: int, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry``) and the columns of OUT_DDL; see ``find_contamination``."""
    return beside(documents, scanner(benchmark_blocks(benchmark, window, block_words), percent), OUT_DDL, carry)


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words of documents that lie in any occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one. One row per input row: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated (n_hit > 0 and n_hit at least ``percent`` percent
    of n_words) and spans (merged ``start:end`` word positions, end exclusive).
    Null or empty texts have no words and no hits. An item_id that several rows
    have counts once. A null doc_id stays null. Extra columns are ignored. An
    empty benchmark finds nothing.

    No shuffle of documents: the benchmark, a stated query set, goes to every
    shard in blocks of ``block_words`` words; each shard is indexed for a block
    at a time. A benchmark of more than MOST_BLOCKS blocks is refused, as every
    worker keeps all of them.
    """
    found = judged(documents, benchmark, window, percent, block_words, ["doc_id"])
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), *(c for c in found.columns if c != "row"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``documents`` that ``find_contamination`` doesn't call contaminated, as they are, whatever their ids."""
    return judged(documents, benchmark, window, percent, block_words).where("NOT contaminated").select("row.*")
