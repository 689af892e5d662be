"""Exact token counts at prefixes of texts, by prefix dynamic programming.

A byte-level BPE splits a text into pieces that are merged on their own; no piece crosses a place where white
space follows something else. The count at the end of chunk i (white space with the non-white run after it) is
therefore count[i - 1] + tokens(chunk i), and the table of these counts answers how many tokens any prefix has
and where a budget cuts the text, without encoding anything again. Inside a chunk, `ChunkPrefixes` goes on by
code point: the count of a prefix is that of the prefix before its last token plus one, where the last token is
the only vocabulary entry that the merges leave next to the last token before it.

Chunks are distinct far less often than they occur: each worker keeps a bounded table of chunks it has counted and
has the tokenizer encode only those it has not met. A special token's string is a chunk of its own, one token; a
prefix that ends inside it is ordinary text, and the dynamic program runs over it and the chunk before. The program
takes time in proportion to the chunk, so a chunk of any length is treated alike.

Cases: null counts as the empty text, 0 tokens; repeated rows are counted one by one; other columns are not used.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import tables, texts

#: Chunks a worker remembers; the table is emptied when full, which costs time and nothing else.
CHUNKS = 400_000
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Single spaces cut a text into chunks unless white space of more than one character holds a space further on.
_IRREGULAR = re.compile(f"[{_SPACE}] [{_SPACE}]|  ")
_LEADING = re.compile(f"[{_SPACE}]*")
#: Pieces of which a prefix is more than one piece: fixed values.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_SYMBOLS = _byte_symbols()


def symbols(piece: str) -> str:
    """A piece in the characters of a byte-level vocabulary."""
    return piece.encode().decode("latin-1").translate(BYTE_SYMBOLS)


class PrefixCounter:
    """Counts tokens of texts chunk by chunk with one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.apart = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        self.known: dict[str, int] = {}
        self.marks = dict(zip(".,", self.encode([".", ","]), strict=True))

    def chunks(self, text: str) -> list[str]:
        """The text's chunks in order."""
        if self.apart and any(x in text for x in self.special):
            parts = self.apart.split(text)  # special strings are every second part
            return [c for i, p in enumerate(parts) for c in ([p] if i % 2 else self.plain(p))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        """Chunks of a text without special strings."""
        if not text:
            return []
        if _IRREGULAR.search(text):
            return _RUNS.findall(text)
        parts = text.split(" ")
        return [parts[0], *(" " + p for p in parts[1:])] if parts[0] else [" " + p for p in parts[1:]]

    def encode(self, some: list[str]) -> list[int]:
        """Token counts straight from the tokenizer."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def learn(self, chunks: set[str]) -> None:
        """Makes sure that all chunks are known. A word with the space before it is one piece, for the merges alone."""
        if len(self.known) + 2 * len(chunks) > CHUNKS:
            self.known = {}
        known, merge = self.known, self.tokenizer.model.tokenize
        other = []
        for c in chunks.difference(known):
            word = c[1:] if c[:1] == " " else c
            if word.isalpha():
                known[c] = len(merge(symbols(c)))
            elif word[-1:] in self.marks and word[:-1].isalpha():
                if c[:-1] not in known:
                    known[c[:-1]] = len(merge(symbols(c[:-1])))
                known[c] = known[c[:-1]] + self.marks[word[-1]]
            else:
                other.append(c)
        for i in range(0, len(other), 4096):
            known.update(zip(other[i : i + 4096], self.encode(other[i : i + 4096]), strict=True))

    def counts(self, chunks: list[str]) -> np.ndarray:
        """Tokens up to the end of each chunk."""
        return np.cumsum(np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks)))


@lru_cache(maxsize=2)
def counter_of(path: str) -> PrefixCounter:
    """A worker's counter, kept from task to task."""
    return PrefixCounter(path)


class ChunkPrefixes:
    """Tokens of every code point prefix of a chunk, without encoding each prefix."""

    def __init__(self, counter: PrefixCounter):
        import regex

        with open(counter.path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        self.ids = spec["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.pieces = regex.compile(rf"{'|'.join(CONTRACTIONS)}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.adjacent: dict[tuple[str, str], bool] = {}

    def merged(self, parts: list[str]) -> list[str]:
        """Applies the merges, lowest rank first."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                whole = tuple(parts[i : i + 2]) == pair
                out.append(pair[0] + pair[1] if whole else parts[i])
                i += 1 + whole
            parts = out
        return parts

    def _stay(self, left: str, right: str) -> bool:
        """Whether the merges leave these two tokens side by side."""
        if (left, right) not in self.adjacent:
            if len(self.adjacent) > CHUNKS:
                self.adjacent = {}
            self.adjacent[left, right] = self.merged(list(left + right)) == [left, right]
        return self.adjacent[left, right]

    def piece(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece in bytes, from the empty one."""
        own = symbols(piece)
        count, last = [0], [""]
        for end in range(1, len(own) + 1):
            for start in range(max(0, end - self.longest), end):
                token = own[start:end]
                if token in self.ids and (start == 0 and self.merged(list(token)) == [token] or start and self._stay(last[start], token)):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        return count

    def table(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a chunk in code points, from the empty one.

        The pieces before the one in which a prefix ends are those of the whole chunk, but for prefixes of white
        space only, which are one piece.
        """
        blank = _LEADING.match(chunk)[0]
        out, before = self._by_character(blank), 0
        for m in self.pieces.finditer(chunk):
            piece = m[0]
            counts = self._by_character(piece)
            for i in range(max(1, len(blank) + 1 - m.start()), len(piece) + 1):
                cut = i < len(piece) and piece in CONTRACTIONS
                out.append(before + (sum(self.piece(p)[-1] for p in self.pieces.findall(piece[:i])) if cut else counts[i]))
            before += counts[-1]
        return out

    def _by_character(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece in code points, from the empty one."""
        counts = self.piece(piece)
        if piece.isascii():
            return counts
        ends = np.cumsum([0, *(len(c.encode()) for c in piece)])
        return [counts[i] for i in ends]


COUNTS = "doc_id long, n_bytes long, n_chars long, n_tokens long, fit_chars long, chunk_ends array<int>, chunk_tokens array<int>"


def token_prefix_counts(docs: DataFrame, path: str, budget: int = 512, keep_table: bool = True) -> DataFrame:
    """The table of prefix counts of each text under the tokenizer file at path (the same on every machine).

    Returns doc_id; n_bytes (UTF-8) and n_chars; n_tokens of the whole text; fit_chars, the code points of the
    longest prefix of at most `budget` tokens among those that end inside or at the end of the first chunk that
    passes it (a prefix's count may fall again where its last piece becomes whole); and, with keep_table,
    chunk_ends (code points) with chunk_tokens (tokens up to there).
    """
    docs = texts(docs)
    tables(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        inner: ChunkPrefixes | None = None
        for batch in batches:
            rows = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[] for _ in range(6)]
            for text, chunks, counts in counted(counter, rows):
                n = int(counts[-1]) if len(counts) else 0
                at = int(np.searchsorted(counts, budget, side="right"))
                if at == len(chunks):
                    fit = len(text)
                else:
                    inner = inner or ChunkPrefixes(counter)
                    fit = fit_inside(counter, inner, chunks, counts, at, budget)
                ends = np.cumsum([len(c) for c in chunks]) if keep_table else None
                for column, x in zip(out, (len(text.encode()), len(text), n, fit, ends, counts if keep_table else None), strict=True):
                    column.append(x)
            kinds = (pa.int64(),) * 4 + (pa.list_(pa.int32()),) * 2
            arrays = [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_chars", "n_tokens", "fit_chars", "chunk_ends", "chunk_tokens"])

    return docs.mapInArrow(count, COUNTS)


def counted(counter: PrefixCounter, rows: list[str]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """Text, chunks and counts up to each chunk's end, for some texts at a time."""
    for lo in range(0, len(rows), 64):
        some = rows[lo : lo + 64]
        cut = [counter.chunks(t) for t in some]
        counter.learn(set().union(*cut))
        for text, chunks in zip(some, cut, strict=True):
            yield text, chunks, counter.counts(chunks)


def fit_inside(counter: PrefixCounter, inner: ChunkPrefixes, chunks: list[str], counts: np.ndarray, at: int, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens that ends inside chunk `at`, the first too many."""
    tail, start = chunks[at], at
    if tail in counter.special:  # a part of it is ordinary text, which joins the chunk before
        tail = tail[:-1]
        if at and chunks[at - 1] not in counter.special:
            tail, start = chunks[at - 1] + tail, at - 1
    done = sum(map(len, chunks[start:at]))
    left = budget - (int(counts[start - 1]) if start else 0)
    fits = [i for i, n in enumerate(inner.table(tail)) if i >= done and n <= left]
    return sum(map(len, chunks[:start])) + max(fits, default=done)


def tokens_before(table_row, chars: int) -> int:
    """Tokens up to the last chunk end at or before a code point, from a row of token_prefix_counts."""
    at = int(np.searchsorted(np.asarray(table_row.chunk_ends), chars, side="right"))
    return int(table_row.chunk_tokens[at - 1]) if at else 0
