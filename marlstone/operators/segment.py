"""Segmentation: encodings, distances, clusters, profiles, prototypes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import cells


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """Adds a 0/1 column for each value."""
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in values})


def with_columns(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """The columns in that order, absent ones filled."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """column, code: its sorted distinct values from 0."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)  # a row per value


def standardised(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Columns less the mean over the population deviation of a training frame (its own by default); no spread counts as 1."""
    fit = (df if train is None else train).agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"fit_{c}") for c in columns))
    own = df.crossJoin(F.broadcast(fit))  # one row
    return own.withColumns({c: (F.col(c) - F.col(f"fit_{c}.m")) / F.when(F.col(f"fit_{c}.s") < 1e-8, 1.0).otherwise(F.col(f"fit_{c}.s")) for c in columns}).drop(*fit.columns)


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns brought to [0, 1]; no spread gives 0."""
    fit = df.agg(*(F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(f"fit_{c}") for c in columns))
    own = df.crossJoin(F.broadcast(fit))  # one row
    return own.withColumns({c: F.coalesce(E.ratio(F.col(c) - F.col(f"fit_{c}.a"), F.col(f"fit_{c}.b") - F.col(f"fit_{c}.a")), F.lit(0.0)) for c in columns}).drop(*fit.columns)


#: Rows of a cell in which nearest rows are looked for, about.
NEAREST_BLOCK = 1000


def nearest(queries: DataFrame, rows: DataFrame, key: str, numbers: list[str], codes: list[str], k: int) -> DataFrame:
    """q, key, distance, rank: the k rows nearest to each query under Gower distance, itself left out.

    Distances count to nine digits, ties by key. Exact, by an index of cells (see `cells`): a query is compared with the
    cells that can hold a row as near as the best of its own cell.
    """
    return cells.nearest(queries, rows, key, numbers, codes, k, NEAREST_BLOCK)


def principal_axes(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """Adds pc1..pck of centred columns, each axis with its largest loading positive; and the explained shares."""
    mean = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    centred = df.withColumns({f"c_{c}": F.col(c) - F.lit(mean[c]) for c in columns})
    rows = VectorAssembler(inputCols=[f"c_{c}" for c in columns], outputCol="features").transform(centred)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(rows)
    axes = model.pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    made = {f"pc{j + 1}": E.total(F.col(f"c_{c}") * float(axes[i, j]) for i, c in enumerate(columns)) for j in range(k)}
    return centred.withColumns(made).drop(*(f"c_{c}" for c in columns)), [float(v) for v in model.explainedVariance]


def profile(df: DataFrame, cluster: str, numbers: list[str], codes: list[str]) -> DataFrame:
    """cluster, means, dominant code with its share and confidence word, size and share of each cluster."""
    whole = Window.partitionBy()
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *(F.avg(c).alias(f"mean_{c}") for c in numbers))
    out = out.withColumn("share", F.col("size") / F.sum("size").over(whole))  # one row per cluster
    for c in codes:
        counts = df.groupBy(cluster, c).agg(F.count(F.lit(1)).alias("n"))
        best = counts.withColumn("k", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), c))).where("k = 1").select(cluster, F.col(c).alias(f"top_{c}"), F.col("n").alias("k_n"))
        out = out.join(best, cluster, "left").withColumn(f"share_{c}", F.col("k_n") / F.col("size")).drop("k_n").withColumn(f"tag_{c}", confidence_word(f"share_{c}"))
    return out


def confidence_word(share: str):
    """strong from .75, moderate from .55, weak below."""
    return F.when(F.col(share) >= 0.75, "strong").when(F.col(share) >= 0.55, "moderate").otherwise("weak")


def prototypes(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """label and the mean of each column: where learning of one prototype for each class starts."""
    return df.groupBy(label).agg(*(F.avg(c).alias(c) for c in columns))


def nearest_prototype(df: DataFrame, protos: DataFrame, label: str, columns: list[str], key: str) -> DataFrame:
    """key, nearest: the class of the nearest prototype, the first on ties.

    Prototypes are few: they are one array that is sent to the tasks, so a row stays one row; rows of one key are one
    (by a hash aggregation of two numbers), the nearest of them counts.
    """
    held = protos.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("nearest"), *(F.col(c).alias(c) for c in columns)))).alias("protos"))  # a row per class
    gap = lambda p: E.total(F.pow(F.col(c) - p[c], 2) for c in columns)
    gaps = F.transform("protos", lambda p: F.struct(gap(p).alias("gap"), p["nearest"].alias("nearest")))
    near = F.array_min(F.filter(gaps, lambda g: g["gap"].isNotNull()))
    own = df.select(key, *columns).crossJoin(F.broadcast(held)).select(key, near.alias("x"))  # one row
    return own.select(key, "x.gap", "x.nearest").groupBy(key).agg(F.min_by("nearest", "gap").alias("nearest"))


def balanced_tree(df: DataFrame, label: str, columns: list[str], depth: int = 6, least: int = 20):
    """A decision tree with classes weighted alike, and the frame it was fitted on with its features."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    k = counts.count()
    total = df.count()
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df.join(F.broadcast(counts.withColumn("weight", F.lit(total / max(k, 1)) / F.col("n")).drop("n")), label))
    return DecisionTreeClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxDepth=depth, minInstancesPerNode=least, seed=42).fit(rows), rows


#: Ranges of the hash into which the rows of a class are dealt.
HASH_RANGES = 1024


def stratified(df: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """Adds train: the share of each class, rounded, of least hash.

    A row's place is that within its range of hashes, and the counts of the ranges before; no task orders a class.
    The frame is read twice, so give a written one where it is costly.
    """
    code = F.crc32(F.col(key).cast("string"))
    dealt = df.withColumn("hash_range", F.floor(code / ((1 << 32) // HASH_RANGES)).cast("int"))
    counts = dealt.groupBy(label, "hash_range").agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy(label).orderBy("hash_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(label)
    bases = counts.select(F.col(label).alias("class"), F.col("hash_range").alias("at"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("whole"))
    order = Window.partitionBy(label, "hash_range").orderBy(code, key)
    own = dealt.withColumn("place", F.row_number().over(order)).join(F.broadcast(bases), F.col(label).eqNullSafe(F.col("class")) & F.col("hash_range").eqNullSafe(F.col("at")))  # HASH_RANGES rows a class
    return own.withColumn("train", F.col("base") + F.col("place") <= F.round(F.col("whole") * share)).select(*df.columns, "train")


def confidence_floor(base: float) -> float:
    """Least precision asked of a threshold: a quarter above the base rate, at most .7."""
    return min(0.7, base + 0.25) if not math.isnan(base) else 0.7
