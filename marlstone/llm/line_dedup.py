"""Line dedup: windows of three consecutive lines that occur before are removed.

Every window of three consecutive lines with a word in it is hashed (128 bits). A window's first occurrence in the
order of doc_id, text hash and line stays; every later one, in the same document or another, marks the lines it covers, and
the union of the marked lines is removed. Only hashes and places are shuffled to find occurrences: first places by
minima that combine before the shuffle, then a join with the repeated windows that deals a window of many occurrences
into parts, so a passage that a third of all documents share is no load for one task. The places of repeated windows
are gathered by document, which is bounded by its lines; in order, they are merged with one walk over the lines.

Cases: null and empty texts and those of fewer than three lines stay as they are; lines are compared as they are,
case and spaces included; rows with an equal doc_id (or none) and an equal text count as one occurrence (repeated rows
get equal results), different texts of one doc_id (or of none) are documents of their own; rows of a null doc_id come
after all others; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import written
from .spread import spread_join


def _key() -> Column:
    """Place of a document in the order: by doc_id, rows without one last, then by the hash of its text."""
    doc_id = F.col("doc_id").cast("long")
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("h"))


def _windows(docs: DataFrame) -> DataFrame:
    """key, pos, h1, h2: the windows of each document."""
    lines = F.split("text", "\n", -1)
    own = docs.select(_key().alias("key"), lines.alias("lines")).where(F.size("lines") >= 3)

    def window(i):
        return F.struct(i.alias("pos"), F.get("lines", i).alias("a"), F.get("lines", i + 1).alias("b"), F.get("lines", i + 2).alias("c"))

    every = own.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - 3), window)).alias("w"))
    spoken = every.where(F.concat("w.a", "w.b", "w.c").rlike(r"[^\s]"))
    return spoken.select("key", "w.pos", F.xxhash64("w.a", "w.b", "w.c").alias("h1"), F.xxhash64(F.lit(1), "w.c", "w.b", "w.a").alias("h2"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """key, starts: line numbers (from 0, in order) at which later occurrences of windows begin, for each document."""
    places = _windows(docs)
    place = F.struct("key", "pos")
    first = places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("first < last").drop("last"), "windows")
    later = spread_join(places, first, ["h1", "h2"], "n", F.xxhash64("key")).where(place > F.col("first"))
    return later.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def lines_left(lines: Column, starts: Column) -> Column:
    """The lines that no window covers: those between the end of each window and the start of the next."""
    bounds = F.arrays_zip(F.concat(F.array(F.lit(-3)), starts).alias("a"), F.concat(starts, F.array(F.size(lines))).alias("b"))
    return F.flatten(F.transform(bounds, lambda x: F.slice(lines, x["a"] + 4, F.greatest(x["b"] - x["a"] - 3, F.lit(0)))))


def without_repeated_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The documents with repeated lines removed from text, and n_lines and n_removed added.

    Input columns of these two names give way; all others stay. With drop_emptied, documents of which no line is left
    are left out.
    """
    lines, left = F.split("text", "\n", -1), F.col("_left")
    joined = docs.drop("n_lines", "n_removed").withColumn("_key", _key())
    joined = joined.join(repeated_windows(docs).select(F.col("key").alias("_key"), F.col("starts").alias("_starts")), "_key", "left")
    joined = joined.withColumn("_left", F.when(F.col("_starts").isNotNull(), lines_left(lines, F.col("_starts"))))
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(lines)).cast("long")
    out = joined.withColumn("n_lines", n_lines).withColumn("n_removed", F.when(left.isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size(left)).cast("long"))
    out = out.withColumn("text", F.when(left.isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).drop("_key", "_starts", "_left")
    return out.where("n_removed = 0 OR n_removed < n_lines") if drop_emptied else out
