"""Source divergence audit: how far the word use of each source of a language is from that of its other sources.

Plain relational. The regexp matches of every text are exploded with the distinct ones behind them, so that one
group-by by (lang, source, term) gives occurrences and documents, combined before the shuffle. A language keeps the
terms of at least `least_docs` of its documents. Its groups (lang, source) are crossed with that vocabulary, which
densifies zero counts; every group and the language give a term the smoothed share
p = 1 + floor(scale * (count + smoothing) / (total + smoothing * V)), in exact decimals. A self-join on (lang, term) brings
the shares of two sources side by side; sums of their differences are combined before the shuffle and ranked.

The cross is a join on (lang, salt): the vocabulary is dealt into parts of about PART terms by a hash, and a group's
row goes to each part, so that neither a large language nor a large source is one task's work. What is dense holds
groups x terms rows, whatever the number of documents; the self-join has a row for two sources and a term and the
result one for each two sources.

Cases: null text, lang and source are ''; texts without a match, empty ones included, count as documents of their
group and have no terms; a group without terms has pairs all the same, of value 0 where its language keeps no term;
repeated rows count as often as they occur; doc_id is not used; extra columns of any name do not matter; no
documents give no rows. Only A-Z is lower-cased.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

#: Runs of letters: of A-Z, a-z and of all that is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms in a part of the vocabulary, about.
PART = 1000


def _counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c, d: occurrences and documents of every term in every group."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    terms = docs.select("lang", "source", F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)).alias("terms"))
    both = F.concat("terms", F.array_distinct("terms"))
    rows = terms.select("lang", "source", F.size("terms").alias("n"), F.posexplode(both).alias("pos", "term"))
    occurrence = (F.col("pos") < F.col("n")).cast("long")
    return rows.groupBy("lang", "source", "term").agg(F.sum(occurrence).alias("c"), F.sum(1 - occurrence).alias("d"))


def _share(count: str, total: str, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * v)), exact."""
    above = F.lit(scale).cast("decimal(11,0)") * (F.col(count) + smoothing).cast("decimal(20,0)")
    below = (F.col(total) + smoothing * F.col("v")).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, below)


def dense_shares(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, scale: int = 10**9) -> tuple[DataFrame, DataFrame]:
    """Two written tables: groups (lang, source) and dense rows lang, source, term, c, p, q for every group and kept term.

    c is the count in the group, p the group's share, q the language's.
    """
    own = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    counts = written(_counts(own), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("c").alias("lang_c"), F.sum("d").alias("d")).where(F.col("d") >= least_docs)
    terms = written(terms.drop("d"), "terms")
    kept = counts.join(terms.select("lang", "term"), ["lang", "term"], "left_semi").drop("d")
    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_c").alias("lang_n"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.na.fill(0, ["n", "v", "lang_n"]), "groups")

    parts = max(1, -(-terms.count() // PART))
    dealt = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    each = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dense = dealt.join(each, ["lang", "salt"]).join(kept, ["lang", "source", "term"], "left").na.fill(0, ["c"])
    p, q = _share("c", "n", smoothing, scale), _share("lang_c", "lang_n", smoothing, scale)
    return groups, written(dense.select("lang", "source", "term", "c", p.alias("p"), q.alias("q")), "dense-terms")


def audit(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, scale: int = 10**9, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source).

    Part `pair`: each other source of the language, by the sum over kept terms of the difference of shares. Part
    `term`: the group's terms of a share above the language's, by that difference, to rank `top`.
    """
    groups, dense = dense_shares(docs, least_docs, smoothing, scale)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")

    one = dense.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"))
    other = dense.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    sums = one.join(other, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("f"))
    pairs = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").na.fill(0, ["f"])
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", ways.alias("w"), F.col("f").alias("value")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    terms = dense.where("c > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))
