"""BPE encoding and decoding with forced boundaries.

Two symbols that never stand side by side inside any vocabulary token can never
be merged across, so they mark a certain cut: the fragments between cuts are
encoded independently and their ids are concatenated. Pieces that the
pre-tokeniser parts are cut in the same way. Fragments and pieces are
remembered, so a text costs little more than its words.

The vocabulary file's own normaliser and pre-tokeniser are followed; a text
with a character on which Python's tables and theirs differ, and a file of
another form, goes to the tokenizers library whole.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from requill.llm.common import texts, tidy

#: Pieces and fragments that a worker remembers before it starts afresh, and the longest that it remembers: together they bound its memory.
CACHE_PIECES, CACHE_FRAGMENTS, CACHE_LENGTH = 300_000, 200_000, 64
#: Ids that a worker gathers before it gives rows out.
OUT_IDS = 500_000
#: The form of the files that the fast way follows.
SPACES = r"\s+"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible in Latin-1, else the next from U+0100."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    return [hidden.get(b, chr(b)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encodes a piece (symbols, the last with the word-end suffix) by its fragments."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str) -> None:
        self.vocabulary, self.suffix = vocabulary, suffix
        self.ranks = {(pair := tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m)): i for i, m in enumerate(merges)}
        self.inside: set[tuple[str, str]] = set()
        for token in vocabulary:
            symbols = self.symbols(token)
            self.inside.update(zip(symbols, symbols[1:], strict=False))
        self.fragments: dict[tuple, tuple[int, ...]] = {}

    def symbols(self, token: str) -> list[str]:
        """A token's characters; a word end belongs to the last of them."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = list(token[: -len(self.suffix)])
            body[-1] += self.suffix
            return body
        return list(token)

    def merged(self, symbols: list[str]) -> tuple[int, ...]:
        """Ids of a fragment: the pair of the least rank, the first of equals, is merged until none has a rank."""
        symbols = self.merged_long(symbols) if len(symbols) > CACHE_LENGTH else self.merged_short(symbols)
        return tuple(self.vocabulary[s] for s in symbols if s in self.vocabulary)

    def merged_short(self, symbols: list[str]) -> list[str]:
        rank, never = self.ranks.get, len(self.ranks)
        ranks = [rank(p, never) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), never)
        return symbols

    def merged_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap of pairs over linked neighbours: no more than a logarithm a merge."""
        rank, n = self.ranks.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # A pair whose left or right symbol has changed since has another rank, or is gone.
            if not symbols[i] or j >= n or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [s for s in symbols if s]

    def encode(self, symbols: list[str]) -> tuple[int, ...]:
        ids: list[int] = []
        start = 0
        for i in range(1, len(symbols) + 1):
            if i == len(symbols) or (symbols[i - 1], symbols[i]) not in self.inside:
                part = tuple(symbols[start:i])
                known = self.fragments.get(part)
                if known is None:
                    known = self.merged(list(part))
                    if len(part) <= CACHE_LENGTH:
                        if len(self.fragments) >= CACHE_FRAGMENTS:
                            self.fragments.clear()
                        self.fragments[part] = known
                ids += known
                start = i
        return tuple(ids)


class Pieces(dict):
    """For each piece: (number of ids, ids as text, decoded text)."""

    def __init__(self, coder: Coder) -> None:
        super().__init__()
        self.coder = weakref.proxy(coder)

    def __missing__(self, piece: str) -> tuple[int, str, str]:
        ids = self.coder.piece_ids(piece)
        out = len(ids), " ".join(map(str, ids)), " ".join(self.coder.token[i] for i in ids)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


class Counts(dict):
    """The number of ids of each piece."""

    def __init__(self, coder: Coder) -> None:
        super().__init__()
        self.coder = weakref.proxy(coder)

    def __missing__(self, piece: str) -> int:
        n = len(self.coder.piece_ids(piece))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n


def vocabulary_text(path: str) -> str:
    """A vocabulary file, read on the driver: tasks get its text, and need no file of their own."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Coder:
    """``(number of ids, ids joined by one space, decoded text)`` of a text, by the text of a vocabulary file.

    Its caches know it by weak references: so it goes with the task that made
    it, although garbage isn't collected meanwhile, and the next task's doesn't
    come on top.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        parts = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        self.followed = (
            [x.get("type") for x in parts[0].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and parts[0]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": SPACES}, "content": " "}
            and [x.get("type") for x in parts[1].get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and parts[1]["pretokenizers"][0] == {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
            and not parts[1]["pretokenizers"][1].get("add_prefix_space") and not parts[1]["pretokenizers"][1].get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and spec.get("decoder") is None and spec.get("post_processor") is None
            and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"])
        )
        self.bpe = ForcedBoundaryBPE(model["vocab"], model["merges"], suffix)
        self.bytes = byte_symbols()
        self.find = regex.compile(PIECES).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.sure: set[str] = set()
        self.odd: set[str] = set()
        self.pieces, self.counts = Pieces(self), Counts(self)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        symbols = [self.bytes[b] for b in piece.encode()]
        symbols[-1] += self.bpe.suffix
        return self.bpe.encode(symbols)

    def normalised(self, text: str) -> str:
        # lower() turns a final capital sigma into its final form; character by character it doesn't.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _agrees(self, char: str) -> bool:
        """Whether the library normalises and parts a text with this character as we do."""
        for sample in (f"a{char}b", f"1{char}.", f"é{char}"):
            text = self.library.normalizer.normalize_str(sample)
            ours = self.find(self.normalised(sample))
            theirs = [sample_piece for sample_piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
            if theirs != ["".join(self.bytes[b] for b in p.encode()) for p in ours]:
                return False
        return True

    def familiar(self, text: str) -> bool:
        new = set(text) - self.sure
        for char in new:
            if char in self.odd or not self._agrees(char):
                self.odd.add(char)
                return False
            self.sure.add(char)
        return True

    def follows(self, text: str) -> bool:
        return self.followed and (text.isascii() or self.familiar(text))

    def count(self, text: str) -> int:
        """Just the number of ids."""
        if not self.follows(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        parts = self.split_special.split(text) if self.split_special else [text]
        return sum(1 if p in self.special else sum(map(self.counts.__getitem__, self.find(self.normalised(p)))) for p in parts)

    def code(self, text: str) -> tuple[int, str, str]:
        if not self.follows(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return len(ids), " ".join(map(str, ids)), self.library.decode(ids, skip_special_tokens=False)
        found: list[tuple[int, str, str]] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                i = self.special[part]
                found.append((1, str(i), part))
            elif part:
                found += map(self.pieces.__getitem__, self.find(self.normalised(part)))
        if not found:
            return 0, "", ""
        counts, ids, decoded = zip(*found, strict=True)
        return sum(counts), " ".join(filter(None, ids)), " ".join(filter(None, decoded))


def coder(vocabulary: Broadcast, with_ids: bool):
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(schema + ([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, f.type) for c, f in zip(columns[:4], schema, strict=False)]
        if with_ids:
            ends = np.cumsum([0, *map(len, columns[4])], dtype=np.int32)
            arrays += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[4]))), pa.array(columns[5], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(vocabulary.value)
        # The caches hold no cycles; walking them again and again in search of some costs a fifth of the time.
        gc.disable()
        try:
            for batch in batches:
                yield from coded(own, batch)
        finally:
            gc.enable()

    def coded(own: Coder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, gathered = [], 0
        text = batch.column(1)
        for i, doc in enumerate(batch.column(0).to_pylist()):
            n, ids, decoded = own.code(text[i].as_py() or "")
            row = (doc, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            rows.append((*row, np.array(ids.split(), np.int32), decoded) if with_ids else row)
            gathered += n
            if gathered >= OUT_IDS:
                yield packed(rows)
                rows, gathered = [], 0
        if rows:
            yield packed(rows)

    return run


def encode_decode(documents: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode every text as the tokenizers library does without added special tokens, and decode the ids again.

    ``vocabulary`` is the path of a tokenizers file on the driver, whose text is
    broadcast (a few MB, whatever the input). One row per input row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by
    one space), decoded_sha256 and, ``with_ids``, ids and decoded. A null text
    is empty: no ids, an empty decoded text. Special tokens written in a text
    are their ids. A null doc_id stays null, repeated rows stay, extra columns
    are ignored. No shuffle; a worker keeps two bounded caches and one text. A
    word of any length takes its symbols times the logarithm of their number.
    """
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    return texts(documents).mapInArrow(tidy(coder(shared, with_ids)), ddl)
