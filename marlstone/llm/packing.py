"""Best-fit packing of tokenised documents into sequences of bounded length.

A document's tokens are cut only where it is longer than a sequence. Pieces are then packed by vector best fit: a
sequence has residual capacities in tokens, in documents and in attention cost (the sum of squared piece
lengths), and a piece goes to the open sequence that is feasible in every one of them and for which the norm of
the weighted residual left is least (or the weighted dot product of demand and residual greatest).

Only a piece's length decides where it may go. So the tasks count pieces by length, the driver packs the
histogram (at most one row per possible length, whatever the size of the corpus) from the longest length to the
shortest, treating equal open sequences as one range with a multiplicity, and the resulting plan tells each piece
its place from its rank among the pieces of its length. Ranks come from counts per (length, salt) and a row number
inside each, so that a length that a third of all pieces share is still spread over many tasks.

Cases: a null text is empty, its document holds the end token only; documents of equal text are packed one by one;
repeated rows get places of their own; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import tables, texts, written
from .token_counts import BYTE_SYMBOLS

#: Chunks of text whose ids a worker remembers.
CHUNKS = 500_000
#: Parts into which the pieces of one length are dealt for numbering: SALTS, or one for each SALT_ROWS pieces.
SALTS = 64
SALT_ROWS = 250_000


#: Letters whose lower case depends on what follows, or is more than one letter.
GREEK_SIGMA, DOTTED_I = "\u03a3", "\u0130"


class Capacity(NamedTuple):
    """Capacities of a sequence, and the weights of their residuals (as shares of the capacities) in the choice.

    As they stand, a sequence holds at most 4096 documents and the attention cost of one document that fills it. Every
    piece has a token at least, so these two never keep out a piece whose tokens fit, and the number of sequences is
    not raised; all three residuals decide between the sequences that a piece fits.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


class ChunkIds:
    """Ids of texts under a tokenizer that lower-cases, drops white space and ends words, chunk by chunk.

    Chunks lie between spaces and line feeds. A chunk that is a word, or a word and a full stop or comma, is made of
    pieces that the tokenizer's model merges on their own.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.marks = dict(zip(".,", self.encode([".", ","]), strict=True))

    def encode(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def words(self, some: list[str]) -> list[bytes]:
        """Ids of chunks of letters only, already in lower case: one piece each, for the merges alone."""
        merge = self.tokenizer.model.tokenize
        symbols = (w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_SYMBOLS) for w in some)
        return [array("I", [t.id for t in merge(s)]).tobytes() for s in symbols]

    def chunks(self, text: str) -> list[str] | None:
        """Chunks of the text as the tokenizer's normaliser leaves it; None where that is not certain."""
        if any(s in text for s in self.special):
            return None
        low = text.lower()
        if not text.isascii() and (GREEK_SIGMA in text or DOTTED_I in text or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))):
            return None
        return low.replace("\n", " ").split(" ")

    def learn(self, chunks: set[str]) -> None:
        """Makes sure that all chunks are known."""
        if len(self.known) + 2 * len(chunks) > CHUNKS:
            self.known = {}
        known = self.known
        marked, plain, other = [], [], []
        for c in chunks.difference(known):
            if c.isalpha():
                plain.append(c)
            elif c[-1:] in self.marks and c[:-1].isalpha():
                marked.append(c)
                if c[:-1] not in known and c[:-1] not in chunks:
                    plain.append(c[:-1])
            else:
                other.append(c)
        plain = list(set(plain))
        for some, encode in ((plain, self.words), (other, self.encode)):
            for i in range(0, len(some), 4096):
                known.update(zip(some[i : i + 4096], encode(some[i : i + 4096]), strict=True))
        for c in marked:
            known[c] = known[c[:-1]] + self.marks[c[-1]]

    def ids(self, rows: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for lo in range(0, len(rows), 64):
            some = rows[lo : lo + 64]
            cut = [self.chunks(t) for t in some]
            self.learn(set().union(*(c for c in cut if c)))
            for text, chunks in zip(some, cut, strict=True):
                yield self.encode([text])[0] if chunks is None else b"".join(map(self.known.__getitem__, chunks))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ChunkIds:
    """A worker's encoder, kept from task to task."""
    return ChunkIds(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, tokens: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: its ids and end_id, cut into parts of at most `tokens`.

    Returns doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32, and ids (array of
    long) with keep_ids.
    """
    docs = texts(docs)
    tables(docs.sparkSession)
    closing = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, own in enumerate(encoder.ids([t or "" for t in batch.column(1).to_pylist()])):
                data = own + closing
                for k, at in enumerate(range(0, len(data), 4 * tokens)):
                    part = data[at : at + 4 * tokens]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(cut, PIECES + ", ids array<long>" * keep_ids)


class Step(NamedTuple):
    """Pieces of a length from a rank on: `each` of them go to every sequence from `first` on, from `offset` on."""

    length: int
    rank: int
    first: int
    each: int
    offset: int


class _Open:
    """Ranges of equal open sequences: first sequence, how many, residual tokens, documents and attention cost."""

    def __init__(self) -> None:
        self.rows = np.zeros((256, 5), dtype=np.int64)
        self.n = 0

    def add(self, row: tuple[int, ...]) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = row
        self.n += 1

    def drop(self, i: int) -> None:
        self.n -= 1
        self.rows[i] = self.rows[self.n]


def plan(histogram: dict[int, int], capacity: Capacity = Capacity()) -> list[Step]:
    """Packs counts of pieces by length; the number of sequences is one more than the largest that a step reaches."""
    full = (capacity.tokens, capacity.documents, capacity.attention)
    weights = np.array(capacity.weights) / np.array(full, dtype=float)
    opened, steps, used = _Open(), [], 0
    for length in sorted(histogram, reverse=True):
        demand = (length, 1, length * length)
        if any(d > f for d, f in zip(demand, full, strict=True)) or length < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = histogram[length], 0
        while left:
            rows = opened.rows[: opened.n]
            fits = np.flatnonzero((rows[:, 2:] >= demand).all(axis=1))
            if len(fits):
                rest = rows[fits, 2:]
                if capacity.rule == "dot":
                    score = -(rest * weights * (np.array(demand) * weights)).sum(axis=1)
                else:
                    score = (((rest - demand) * weights) ** 2).sum(axis=1)
                chosen = int(fits[np.lexsort((rows[fits, 0], score))[0]])
                first, many, *residual = (int(x) for x in rows[chosen])
                opened.drop(chosen)
            else:
                first, many, residual = used, 1 << 60, list(full)
            each = min(left, *(r // d for r, d in zip(residual, demand, strict=True)))
            if capacity.rule == "dot":
                each = 1
            take = min(many, left // each)
            steps.append(Step(length, rank, first, each, capacity.tokens - residual[0]))
            opened_rest = [r - each * d for r, d in zip(residual, demand, strict=True)]
            if many < 1 << 60:
                if many > take:
                    opened.add((first + take, many - take, *residual))
            else:
                used += take
            if min(opened_rest[0], opened_rest[1], opened_rest[2]) > 0:
                opened.add((first, take, *opened_rest))
            left -= take * each
            rank += take * each
    return steps


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0) to rows with doc_id, piece and length. The rows are read three times."""
    spark = pieces.sparkSession
    salts = max(SALTS, -(-pieces.count() // SALT_ROWS))
    # rows of no doc_id, or repeated ones, are told apart by what else the pieces hold
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per possible length at most
    steps = plan(histogram, capacity)
    table = np.array(sorted(steps) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(table)  # a few rows for each possible length
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("row", F.row_number().over(own)).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("row") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = held.value
        length, rank = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        # a step's rank stays below 2**48, so both parts fit one number that orders as the table does
        at = np.searchsorted((t[:, 0] << 48) | t[:, 1], (length << 48) | rank, side="right") - 1
        i = rank - t[at, 1]
        return pd.DataFrame({"sequence_id": t[at, 2] + i // t[at, 3], "offset": t[at, 4] + i % t[at, 3] * length})

    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: Capacity = Capacity(), end_id: int = 1) -> DataFrame:
    """Tokenises, cuts and packs documents: the columns of token_pieces with sequence_id and offset."""
    return pack(written(token_pieces(docs, path, capacity.tokens, end_id), "pieces"), capacity)
