"""Document fingerprints by Order MinHash: signatures that follow edit distance, not only shared content.

A text's k-mers of code points are numbered by occurrence, so that repeats count, and hashed. From BINS points that
divide the hash range evenly, the `pick` k-mers of the next hashes on (after the greatest comes the least) are kept,
put back into their text order, and their tuple is hashed. Two texts agree at a point only if they share these k-mers
and they stand in the same order. Likeness is the share of points at which two fingerprints agree. One pass over a
text serves all points, and short texts give tuples of `pick` k-mers as long ones do.

A fingerprint is a string of 4 hexadecimal digits for each point. Texts shorter than k have one k-mer, the whole text;
the empty text (or a null one) has 0000 at every point and is like other empty texts only.

Cases: equal texts have equal fingerprints; a repeated doc_id is a tie that the text decides, equal rows follow each
other; rows without a doc_id come first, in the order of their texts (all in one range of rows); the row after the
last is the first, so a single row is next to itself; no rows give no rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import tables, texts, written
from .textblocks import mix

#: Code points in a k-mer, points, k-mers picked at a point.
K, BINS, PICK = 6, 64, 2
#: Bits for the place of a k-mer; the rest holds its hash. Only texts of more k-mers than that use further bits.
PLACE_BITS = 24
#: Ranges of doc_id that are laid side by side, for each shuffle partition.
RANGES = 4


def omh(text: str, k: int = K, pick: int = PICK) -> np.ndarray:
    """Fingerprint of a text: a number from 1 to 2**16 - 1 for each point, 0 for the empty text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.zeros(BINS, dtype=np.uint16)
    if not len(codes):
        return out
    k = min(k, len(codes))
    n = len(codes) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h *= np.uint64(0x100000001B3)
        h += codes[j : j + n]
    # hash and place in one number: least hash first, equal k-mers in text order
    shift = np.uint64(max(PLACE_BITS, int(n).bit_length()))
    low = (np.uint64(1) << shift) - np.uint64(1)
    packed = (mix(h) & ~low) | np.arange(n, dtype=np.uint64)
    packed.sort()
    kmer = packed & ~low
    again = kmer[1:] == kmer[:-1]
    if again.any():
        start = np.concatenate(([True], ~again))
        at = np.flatnonzero(start)
        number = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        later = np.flatnonzero(number)
        packed[later] = (mix(kmer[later] + number[later].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~low) | (packed[later] & low)
        packed.sort()
    begin = np.searchsorted(packed, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    # the k-mers picked at each point in text order
    chosen = packed[(begin[:, None] + np.arange(min(pick, n))) % n]
    order = np.argsort(chosen & low, axis=1, kind="stable")
    value = np.take_along_axis(chosen & ~low, order, axis=1)
    total = np.zeros(BINS, dtype=np.uint64)
    for j in range(value.shape[1]):
        total = mix(total + value[:, j] * np.uint64(2 * j + 3))
    return (total % np.uint64(65535)).astype(np.uint16) + np.uint16(1)


def as_text(fingerprint: np.ndarray) -> str:
    """Four hexadecimal digits for each point."""
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the points at which two fingerprints agree; 1 for two of empty texts."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each document row; null texts count as empty."""
    docs = texts(docs)
    tables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t or "" for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([len(t) for t in rows], pa.int64()), pa.array([as_text(omh(t)) for t in rows])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_chars", "fingerprint"])

    return docs.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def half_replaced(text: str, other: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many code points of another."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """range, doc_id, text, place, follows: rows in ranges of doc_id, and in each range the first row beyond it.

    place is the order in the range; follows marks a row that belongs to the next range and is there only to be next
    to the last. Rows are ordered by doc_id, then text; those without a doc_id come first. After the last row comes
    the first. Texts are shuffled once, by range; ranges hold about equally many rows.
    """
    spark = docs.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("cuts")).first().cuts or []
    bounds = np.unique(np.array(cuts, dtype=np.int64))
    held = spark.sparkContext.broadcast(bounds)  # a number for each range

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna().to_numpy()
        out = np.searchsorted(held.value, doc_id.fillna(0).to_numpy(dtype=np.int64), side="left")
        return pd.Series(np.where(known, out, 0).astype(np.int32))

    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("range", range_of("doc_id"))
    first = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    first = written(first.select("range", "first.doc_id", "first.text"), "first")
    along = Window.orderBy("range")  # one row for each range
    before = first.select("range", F.lag("range").over(along).alias("before"), F.max("range").over(Window.partitionBy()).alias("last"))
    heads = first.join(F.broadcast(before), "range").select(F.coalesce("before", "last").alias("range"), "doc_id", "text", F.lit(True).alias("follows"))
    return ranged.select("range", "doc_id", "text", F.lit(False).alias("follows")).unionByName(heads)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits_and_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text with its last half taken from the next document, and their likeness.

    Next is by ascending doc_id, after the last the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next.
    """
    docs = texts(docs)
    spark = tables(docs.sparkSession)
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs).repartition(n, "range").sortWithinPartitions("range", "follows", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # range, doc_id, text, fingerprint of the row that waits for its next
        for batch in batches:
            out: list[tuple] = []
            for at, doc_id, text, follows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = omh(text)
                if last is not None and last[0] == at:
                    out.append(_compared(*last[1:], text, own))
                last = None if follows else (at, doc_id, text, own)
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [x.split(" ")[0] for x in EDITED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.select("range", "doc_id", "text", "follows").mapInArrow(run, EDITED)


def _compared(doc_id: int, text: str, own: np.ndarray, other: str, theirs: np.ndarray) -> tuple:
    edited = half_replaced(text, other)
    changed = omh(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, as_text(own), as_text(changed), likeness(own, changed), likeness(own, theirs)
