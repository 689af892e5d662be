"""Corpus pipeline: toxic documents out, repeated lines out, near duplicates out, benchmark leaks out, then packing.

Each stage takes all that the one before it kept, as written Parquet, and all but the last return the columns of
documents. ORACLE_SQL is None: a trained score decides in the first stage, which SQL cannot express; each stage is
tested against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from marlstone.llm.registry import tokenizer_path
from marlstone.llm.session import load, tables, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3; rows without labels and empty texts are scored as any other."""
    tables(spark)
    return toxicity.without_toxic(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of repeated three-line windows; n_chars follows; a document left without a line goes."""
    cleaned = line_dedup.without_repeated_lines(docs.select(*COLUMNS), drop_emptied=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars.cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by five-word shingles at similarity 0.8.

    Rows without a doc_id come after all others of their group, and one of them stays only if the group has no other;
    of different texts of one doc_id (or of none) in a group, that of the least hash stays. Of equal rows one stays;
    texts without words are in no group and stay.
    """
    tables(spark)
    docs = docs.select(*COLUMNS)
    groups = written(ngram_join.grouped(docs, k=5, permille=800), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = groups.where("group IS NOT NULL").groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.row").alias("key"))
    kept = first.union(groups.where("group IS NULL").select("row")).distinct()
    joined = docs.withColumn("key", ngram_join.row_key()).join(kept, "key", "left_semi").withColumn("row", F.xxhash64(*COLUMNS))
    same = F.lag("row").over(Window.partitionBy("key").orderBy("row")).eqNullSafe(F.col("row"))
    return joined.withColumn("same", same).where("NOT same").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item; null and empty texts hold none and stay."""
    tables(spark)
    return decontaminate.without_contaminated(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 4096 tokens, within every capacity of packing.Capacity.

    A null or empty text is one piece of the end token; rows of a null or repeated doc_id have places of their own.
    """
    tables(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
