"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every benchmark item is cut into windows of `window` consecutive words (a shorter item is one window). For a
window to be contained whole in a document, its rarest word must be there: with containment 1 the necessary
prefix of a window, its words ordered by rarity in the corpus, is that one word. Documents are therefore joined
with windows on prefix words only. The positional bound is exact: the word's place in the window says where the
window would start, and the length bound drops starts that do not leave room for it. What is left is verified by
comparing the hash of the document's words there with the window's.

Spark does the corpus work in two passes over the texts: word frequencies of the benchmark's vocabulary (partial
sums per task, then one shuffle), and the join. Windows go to the tasks in blocks of at most `block` windows, so
what a task holds is bounded however large the benchmark is; each further block is a further pass.

Cases: null or empty texts have no words, no hits; items without words have no windows; equal items each count;
repeated rows are judged one by one; rows of a null doc_id stay; other columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import tables, texts, written
from .textblocks import ALNUM_DELIMITED, blocks, grams

#: Windows that a task holds at once.
WINDOW_BLOCK = 200_000


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """One row per item and window: item, words long[], gram hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, words, hashes = batch.column(0), [], [], []
            for b in blocks(batch.column(1), ALNUM_DELIMITED):
                for i in range(b.n):
                    own = b.hashes[b.bounds[i] : b.bounds[i + 1]]
                    size = min(window, len(own))
                    for at, h in enumerate(grams(own, size) if size else ()):
                        rows.append(b.first + i)
                        words.append(own[at : at + size].view(np.int64))
                        hashes.append(h)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows, pa.int64())),
                    pa.array(words, pa.list_(pa.int64())),
                    pa.array(np.array(hashes, dtype=np.uint64).view(np.int64), pa.int64()),
                ],
                names=["item_id", "words", "gram"],
            )

    kept = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(cut, "item_id string, words array<long>, gram long")


def _word_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """word, n: how often each of the (sorted) vocabulary words occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = np.zeros(len(vocabulary), dtype=np.int64), _Sieve(vocabulary)
        for batch in batches:
            for b in blocks(batch.column(0), ALNUM_DELIMITED):
                total += np.bincount(table.find(b.hashes)[1], minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[seen].view(np.int64)), pa.array(total[seen])], names=["word", "n"])

    part = docs.select("text").mapInArrow(count, "word long, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


class _Sieve:
    """Membership in a sorted array of hashes, with a bit table in front of the search."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes of those that are keys, and which keys."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.table[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        sure = self.keys[at] == hashes[maybe]
        return maybe[sure], at[sure]


class WindowIndex:
    """Windows by their rarest word: the join's prefix side."""

    def __init__(self, windows: list, counts: dict[int, int]):
        item, word, place, size, gram = [], [], [], [], []
        for row in windows:
            rarest = min(range(len(row.words)), key=lambda i: (counts.get(row.words[i], 0), row.words[i], i))
            item.append(row.item_id)
            word.append(row.words[rarest])
            place.append(rarest)
            size.append(len(row.words))
            gram.append(row.gram)
        word = np.array(word, dtype=np.int64).view(np.uint64)
        order = np.argsort(word, kind="stable")
        self.items, self.item = np.unique(np.array(item, dtype=object)[order].astype(str), return_inverse=True) if item else (np.zeros(0, str), np.zeros(0, int))
        self.place, self.size = np.array(place, dtype=np.int64)[order], np.array(size, dtype=np.int64)[order]
        self.gram = np.array(gram, dtype=np.int64).view(np.uint64)[order]
        self.words, self.begin = np.unique(word[order], return_index=True)
        self.many = np.diff(np.append(self.begin, len(word)))

    def spans(self, b, sieve: _Sieve) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified places in a block: first word, number of words, item."""
        at, key = sieve.find(b.hashes)
        many = self.many[key]
        at = np.repeat(at, many)
        which = np.repeat(self.begin[key] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(at)) if len(at) else at
        start, size = at - self.place[which], self.size[which]
        text = np.searchsorted(b.bounds, at, side="right") - 1
        fits = (start >= b.bounds[text]) & (start + size <= b.bounds[text + 1])
        start, size, which = start[fits], size[fits], which[fits]
        same = np.zeros(len(start), dtype=bool)
        for k in np.unique(size):
            own = np.flatnonzero(size == k)
            same[own] = _gram_at(b.hashes, start[own], int(k)) == self.gram[which[own]]
        return start[same], size[same], self.item[which[same]]


def _gram_at(hashes: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """grams(hashes, k)[start], without the others."""
    out = np.empty(len(start), dtype=np.uint64)
    for lo in range(0, len(start), 65536):
        s = start[lo : lo + 65536]
        rows = hashes[s[:, None] + np.arange(k)]
        out[lo : lo + 65536] = grams(rows.reshape(-1), k)[:: k] if len(s) else 0
    return out


def find_benchmark_passages(docs: DataFrame, items: DataFrame, window: int = 10, block: int = WINDOW_BLOCK, keep_text: bool = False) -> DataFrame:
    """Each document row's places inside passages of the benchmark.

    Returns doc_id, n_words and the places as three parallel arrays: hit_starts (first word, from 0), hit_sizes
    (words) and hit_items (item ids as strings); with keep_text also text and the columns lang, source, n_chars.
    """
    spark = tables(docs.sparkSession)
    source = texts(docs) if not keep_text else docs
    windows = written(_item_windows(items, window), "windows")
    parts = max(1, -(-windows.count() // block))
    found = None
    for part in range(parts):
        own = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("item_id", "gram"), F.lit(parts)) == part)
        held = own.collect()  # about `block` windows, whatever the size of the corpus
        vocabulary = np.unique(np.array([w for r in held for w in r.words], dtype=np.int64).view(np.uint64))
        counts = {r.word: r.n for r in _word_counts(texts(docs), vocabulary).collect()}  # one row per word of the windows
        index = spark.sparkContext.broadcast(WindowIndex(held, counts))
        last = part == parts - 1
        found = _spans(source if found is None else found, index, keep_text or not last)
    return found


HITS = ("n_words", "hit_starts", "hit_sizes", "hit_items")
HIT_TYPES = "n_words long, hit_starts array<int>, hit_sizes array<int>, hit_items array<string>"


def _spans(docs: DataFrame, index, keep_text: bool) -> DataFrame:
    """Adds a block's places to those that the rows carry from blocks before."""
    carried = [f for f in docs.schema.fields if f.name not in HITS and (keep_text or f.name == "doc_id")]
    names = [f.name for f in carried]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        sieve = _Sieve(own.words)
        for batch in batches:
            n_words, found = np.zeros(batch.num_rows, dtype=np.int64), [[], [], []]
            for b in blocks(batch.column("text"), ALNUM_DELIMITED):
                start, size, item = own.spans(b, sieve)
                text = np.searchsorted(b.bounds, start, side="right") - 1
                order = np.lexsort((item, start, text))
                cuts = np.searchsorted(text[order], np.arange(b.n + 1))
                start, size, item = start[order], size[order], item[order]
                for i in range(b.n):
                    lo, hi = cuts[i], cuts[i + 1]
                    for column, values in zip(found, ((start[lo:hi] - b.bounds[i]).tolist(), size[lo:hi].tolist(), own.items[item[lo:hi]].tolist()), strict=True):
                        column.append(values)
                n_words[b.first : b.first + b.n] = np.diff(b.bounds)
            if "hit_starts" in batch.schema.names:
                found = [[a + b for a, b in zip(batch.column(c).to_pylist(), new, strict=True)] for c, new in zip(HITS[1:], found, strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.string())
            arrays = [batch.column(n) for n in names] + [pa.array(n_words)] + [pa.array(x, pa.list_(k)) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *HITS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), HIT_TYPES])
    return docs.mapInArrow(find, schema)


def covered_words(starts: str = "hit_starts", sizes: str = "hit_sizes") -> F.Column:
    """Number of distinct words inside the spans of a row: the union of intervals."""
    pairs = F.array_sort(F.arrays_zip(F.col(starts).alias("s"), F.col(sizes).alias("k")))
    state = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = x["s"] + x["k"]
        upto = F.greatest(acc["upto"], end)
        return F.struct(upto.alias("upto"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(x["s"], acc["upto"]))).cast("long").alias("n"))

    return F.when(F.size(starts) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, state, step, lambda acc: acc["n"]))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block: int = WINDOW_BLOCK) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted ids of items found), contaminated."""
    spans = find_benchmark_passages(docs, items, window, block)
    return spans.select(
        "doc_id",
        "n_words",
        covered_words().alias("n_hit"),
        F.array_sort(F.array_distinct("hit_items")).alias("items"),
        (F.size("hit_starts") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, block: int = WINDOW_BLOCK) -> DataFrame:
    """The document rows, all columns, that hold no window of any item."""
    held = {c: f"input_{c}" for c in HITS if c in docs.columns}  # columns of the input that are called as the places are
    kept = find_benchmark_passages(docs.withColumnsRenamed(held), items, window, block, keep_text=True)
    clean = kept.where(F.size("hit_starts") == 0).drop(*HITS)
    return clean.withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)
