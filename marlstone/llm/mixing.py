"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a place in its source from a hash. Sizes are summed by source and hash bucket; the bucket in which the
running sum reaches a source's budget is its boundary, and only that bucket is divided again by the next bits of the
hash, until it holds one document. Documents up to the threshold are taken, without any sort of documents. A larger
budget takes what a smaller one takes and more, so thresholds are nested: a target of 1.4 times the source's size takes all
documents once and those below the threshold of 0.4 once more.

Targets: sources share a total by weight; a target stops at `repeats` times its source's size, and the excess goes to the
others by weight until none is above. Exact fractions; the threshold is the one whose sum is nearest to the target.

Passes read a written table without texts (source, size, hash), so lost executors cost part of a pass. The histogram of a
source has BUCKETS rows at most, whatever its documents. Targets and thresholds are rows for each source: they are
worked out on the driver and broadcast, and more than SOURCES sources are an error.

Cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, after all others; a
source without words has target 0; rows that agree in doc_id and text are told apart by their place in the written table
where the boundary lies among them, so that as many as needed are taken; extra columns do not matter; no documents give
no rows. Reruns give equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

#: Bits of a level of the histogram, and levels of each of the two hashes of 60 bits.
BITS, LEVELS = 10, 6
BUCKETS = 1 << BITS
#: Sources at most.
SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def water_filled(sizes: Sequence[int], weights: Sequence[int], share: Fraction, repeats: int) -> list[Fraction]:
    """Targets: `share` of all sizes dealt by weight, none above `repeats` times its size, the excess dealt again."""
    targets, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] >= repeats * sizes[i] * weight}
        if not full:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = Fraction(repeats * sizes[i])
        left -= sum(targets[i] for i in full)
        free -= full
    return targets


def _hash(text: Column) -> Column:
    """60 bits of the md5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _bits(level: int) -> Column:
    """The bits of a level of the two hashes, as an int."""
    return F.shiftright(F.col("h1" if level < LEVELS else "h2"), BITS * (LEVELS - 1 - level % LEVELS)).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h1, h2: a written table of every document's size and place."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    size = F.regexp_count("text", F.lit(WORD)).cast("long")
    numbered = own.select("doc_id", "source", size.alias("size"), _hash(key).alias("h1"), F.monotonically_increasing_id().alias("row"))
    return written(numbered.withColumn("h2", _hash(F.col("row").cast("string"))).drop("row"), "placed")


def _thresholds(placed: DataFrame, rests: dict[str | None, Fraction]) -> dict[str | None, tuple[int, ...] | None]:
    """By source the buckets of the last document taken, level by level (a prefix stands for all that begins so); None takes none.

    rests: words to take of each source, less than it has.
    """
    spark = placed.sparkSession
    at: dict[str | None, tuple[int, ...]] = {s: () for s in rests}
    base, out = dict.fromkeys(rests, 0), {}
    for level in range(2 * LEVELS):
        if not at:
            break
        # words still to come, in whole ones: a running sum reaches the budget where it reaches its ceiling
        ask = [(s, [*p], int(-((base[s] - rests[s]).__floor__()))) for s, p in at.items()]
        asked = spark.createDataFrame(ask, "boundary string, prefix array<int>, need long")
        inside = F.array(*(_bits(i) for i in range(level))).cast("array<int>") == F.col("prefix") if level else F.lit(True)
        rows = placed.where("size > 0").join(F.broadcast(asked), F.col("source").eqNullSafe(F.col("boundary")) & inside)  # SOURCES rows
        bins = rows.groupBy("boundary", "need", _bits(level).alias("bin")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("boundary").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        crossed = bins.withColumn("sum", F.sum("words").over(run)).where("sum >= need")
        first = crossed.groupBy("boundary").agg(F.min(F.struct("bin", "sum", "words", "n")).alias("x")).select("boundary", "x.*").collect()  # SOURCES rows
        for r in first:
            s = r.boundary
            prefix, before = (*at.pop(s), r.bin), base[s] + r["sum"] - r.words
            if r.n == 1 or level == 2 * LEVELS - 1:
                over, under = before + r.words - rests[s], rests[s] - before
                last = prefix if over <= under else (*prefix[:-1], prefix[-1] - 1)
                out[s] = last
            else:
                at[s], base[s] = prefix, before
    return out


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), repeats: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    Sources in the order of their code points, null last, have the weights in turn. taken is a multiple of size.
    """
    placed = _placed(docs)
    totals = placed.groupBy("source").agg(F.sum("size").alias("n")).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
    names, sizes = [r.source for r in totals], [int(r.n) for r in totals]
    targets = water_filled(sizes, [weights[i % len(weights)] for i in range(len(sizes))], Fraction(share), repeats)
    times = [int(t // n) if n else 0 for t, n in zip(targets, sizes, strict=True)]
    rests = {s: t - k * n for s, t, k, n in zip(names, targets, times, sizes, strict=True) if t - k * n > 0}
    found = _thresholds(placed, rests)
    rows = [(s, n, float(t), k, [*found[s]] if s in found else None) for s, n, t, k in zip(names, sizes, targets, times, strict=True)]
    bounds = docs.sparkSession.createDataFrame(rows, "of string, source_size long, target double, times long, last array<int>")
    joined = placed.join(F.broadcast(bounds), F.col("source").eqNullSafe(F.col("of")))  # SOURCES rows
    # buckets compare as arrays of one length: the document's, cut to the length of the threshold
    place = F.slice(F.array(*(_bits(i) for i in range(2 * LEVELS))), 1, F.greatest(F.size("last"), F.lit(0)))
    once_more = F.coalesce((place <= F.col("last")).cast("long"), F.lit(0).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("times") + once_more)).alias("taken"))
