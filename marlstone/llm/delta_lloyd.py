"""Centroid clustering by Delta Lloyd: rounds of exact integer k-means that look only at what has changed.

Every vector becomes integers floor(scale * x). A round's state is a written table: the integers, the owner (cluster) and the
squared distance to it. In the next round a vector whose owner's centroid did not change is compared with the changed
centroids only: the others lost against its owner before. A vector whose owner moved is compared with all. Vectors that
change their owner give signed transfers, minus the vector to the old cluster and plus it to the new one, which combine
to at most one row for each cluster before the driver adds them to the global sums; new centroids are exact floors of
sum / count. The driver holds k centroids and k sums and nothing else; tasks get the centroids with their code.

State is written to the shared folder each round, so a lost executor costs part of one round.

Exactness: components are integers below 2**27 in size (BOUND), so a squared distance of 64 components is below 2**62;
sums are 64-bit under ANSI mode, which makes an overflow an error and no wrong result.

Cases: a vector that is null, has another number of components, or a null, NaN or infinite one is left out; one with a
component beyond BOUND is an error, since distances would not fit 64 bits; repeated rows are clustered one by one;
rows of one vec_id order by their components where they compete for a start, and a null vec_id comes after all others;
fewer kept vectors than k make as many clusters; no kept vector gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import tables, written

#: Integer components must be below this in size.
BOUND = 1 << 27
_STATE = "vec_id long, x array<int>, cluster int, distance long, was int"


class Clustering(NamedTuple):
    """The last state (vec_id, x, cluster, distance, was), the final centroids, and how much each round compared and moved."""

    state: DataFrame
    centroids: list[tuple[int, ...]]
    log: list[dict[str, int]]


def integer_vectors(rows: DataFrame, dims: int, scale: int = 256) -> DataFrame:
    """vec_id, x: the vectors of exactly `dims` finite components as integers floor(scale * component)."""
    raw = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    whole = F.coalesce(F.size("raw") == dims, F.lit(False)) & F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), raw.alias("raw")).where(F.coalesce(whole, F.lit(False)))
    beyond = F.raise_error(F.concat(F.lit("a component is beyond the bound: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))).cast("int")
    return kept.select("vec_id", F.transform("raw", lambda v: F.when(F.abs(v * scale) < BOUND, F.floor(v * scale).cast("int")).otherwise(beyond)).alias("x"))


def starts(vectors: DataFrame, k: int, seed: int) -> list[tuple[int, ...]]:
    """The k vectors of least sha256 of '<seed>:<vec_id>', in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [tuple(r.x) for r in vectors.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()]  # k rows


def _assigned(state: DataFrame, centroids: list[tuple[int, ...]], changed: list[int]) -> DataFrame:
    """The state after a round of comparisons with the centroids, of which those in `changed` are new."""
    c = np.array(centroids, dtype=np.int64)
    norms, dims = (c * c).sum(axis=1), c.shape[1]
    order = np.array(changed, dtype=np.int64)
    is_new = np.zeros(len(c) + 1, dtype=bool)
    is_new[order] = True
    is_new[-1] = True  # a vector without an owner has place -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)
            was = batch.column("cluster").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            best = batch.column("distance").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).copy()
            owner, norm = was.copy(), (x * x).sum(axis=1)
            moved = is_new[was]
            if moved.any():
                d = norm[moved, None] - 2 * (x[moved] @ c.T) + norms
                owner[moved] = d.argmin(axis=1)  # the first of equal ones, so the smaller number
                best[moved] = d.min(axis=1)
            if len(order) and not moved.all():
                d = norm[~moved, None] - 2 * (x[~moved] @ c[order].T) + norms[order]
                near, by = d.min(axis=1), order[d.argmin(axis=1)]
                wins = (near < best[~moved]) | (near == best[~moved]) & (by < owner[~moved])
                owner[~moved] = np.where(wins, by, owner[~moved])
                best[~moved] = np.where(wins, near, best[~moved])
            old = pa.array(was.astype(np.int32), mask=was < 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array(owner.astype(np.int32)), pa.array(best), old], ["vec_id", "x", "cluster", "distance", "was"])

    return state.select("vec_id", "x", "cluster", "distance").mapInArrow(run, _STATE)


def _transfers(state: DataFrame, dims: int) -> list[tuple[int, int, int, list[int]]]:
    """cluster, arrivals, signed count, signed sums of the vectors that changed their owner; a row for each cluster at most."""
    moved = state.where("was IS NULL OR was <> cluster")
    ways = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))
    signed = moved.select("x", F.explode(ways).alias("w")).where("w.c IS NOT NULL").select(F.col("w.c").alias("c"), F.col("w.s").cast("long").alias("s"), "x")
    found = signed.groupBy("c").agg(F.count_if(F.col("s") > 0).alias("arrived"), F.sum("s").alias("n"), *(F.sum(F.col("s") * F.get("x", F.lit(i))).alias(f"x{i}") for i in range(dims))).collect()
    return [(r.c, r.arrived, r.n, [r[f"x{i}"] for i in range(dims)]) for r in found]


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> Clustering | None:
    """Clusters the vectors of vec_id, embedding in `rounds` rounds and a last assignment; None where no vector is kept."""
    tables(rows.sparkSession)
    vectors = written(integer_vectors(rows, dims, scale), "vectors")
    centroids = starts(vectors, k, seed)
    if not centroids:
        return None
    sums, counts, log = [[0] * dims for _ in centroids], [0] * len(centroids), []
    state, changed = vectors.select("vec_id", "x", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), list(range(len(centroids)))
    for r in range(rounds + 1):
        if not changed:  # nothing can move any more
            break
        state = written(_assigned(state, centroids, changed), "assigned")
        if r == rounds:
            break
        moves = _transfers(state, dims)
        for c, _, n, xs in moves:
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], xs, strict=True)]
        new = [tuple(s // n for s in xs) if n else old for xs, n, old in zip(sums, counts, centroids, strict=True)]
        log.append({"compared": len(changed), "moved": sum(arrived for _, arrived, _, _ in moves)})
        changed = [c for c, (a, b) in enumerate(zip(new, centroids, strict=True)) if a != b]
        centroids = new
    return Clustering(state, centroids, log)


def clusters_of(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    done = cluster(rows, k, rounds, dims, scale, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if done is None:
        return rows.sparkSession.createDataFrame([], schema)
    by = {r.cluster: int(r.d) for r in done.state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # k rows
    total = sum(by.values())
    each = [(c, d, total, hashlib.sha256(",".join(map(str, done.centroids[c])).encode()).hexdigest()) for c, d in by.items()]
    facts = rows.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(*(f.split()[0] for f in schema.split(", ")))  # k rows
