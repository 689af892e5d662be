"""What moves a fitted score: dependence on single columns, Shapley values, local linear surrogates.

Every method scores rows in which some columns hold other values. A row is exploded over a fixed number of such
variants, all are scored in one pass, and what comes back is a weighted sum of a row's variants or a mean over all
rows. Variants of a row stay in its task, so they are combined before anything is shuffled.

A scorer takes a frame that has the columns and adds `score`; it must work row by row. Rows that lack one of the
columns are left out. Rows with the same key and columns come once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import expr as E

Scorer = Callable[[DataFrame], DataFrame]

#: Rows that may be background; they travel with the plan.
BACKGROUND = 256


def spread_grid(df: DataFrame, columns: list[str], points: int = 10) -> dict[str, list[float]]:
    """Equally spaced values of each column from its least to its greatest; none where a column is all NULL."""
    one = df.agg(*(f(c).cast("double").alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("a", F.min), ("b", F.max)))).first()
    ends = {c: (one[f"a{i}"], one[f"b{i}"]) for i, c in enumerate(columns)}
    return {c: sorted(set(np.linspace(a, b, points).tolist())) if a is not None else [] for c, (a, b) in ends.items()}


def individual_curves(df: DataFrame, key: str, grid: dict[str, list[float]], columns: list[str], score: Scorer) -> DataFrame:
    """key, name, place, score: each row's score with one column set to each value of its grid."""
    wanted = [F.struct(F.lit(c).alias("name"), F.lit(float(v)).alias("place")) for c, values in grid.items() for v in values]
    own = df.na.drop(subset=columns).select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in columns))
    if not wanted:
        own, wanted = own.limit(0), [F.struct(F.lit("").alias("name"), F.lit(0.0).alias("place"))]
    every = own.select("*", F.explode(F.array(*wanted)).alias("_g"))
    moved = [F.when(F.col("_g.name") == c, F.col("_g.place")).otherwise(F.col(c)).alias(c) for c in columns]
    return score(every.select("key", "_g", *moved)).select(F.col("key").alias(key), "_g.name", "_g.place", "score")


def partial_dependence(df: DataFrame, key: str, grid: dict[str, list[float]], columns: list[str], score: Scorer) -> DataFrame:
    """name, place, mean, n: the mean score of all rows with one column set to each value of its grid."""
    curves = individual_curves(df, key, grid, columns, score)
    return curves.groupBy("name", "place").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))


def _weighted(df: DataFrame, key: str, columns: list[str], score: Scorer, n: int, value: Callable[[int, Column], Column], sums: dict[str, np.ndarray]) -> DataFrame:
    """key, the columns and, for each name in sums, the weighted sum of the scores of a row's n variants."""
    own = df.na.drop(subset=columns).select(F.col(key).alias("key"), F.struct(*(F.col(c).cast("double").alias(c) for c in columns)).alias("_own"))
    every = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_at"))
    scored = score(every.select("key", "_own", "_at", *(value(j, F.col("_own")[c]).alias(c) for j, c in enumerate(columns))))
    times = F.count(F.lit(1)) / n  # of rows that are the same in key and columns
    added = [(F.sum(_picked(w, F.col("_at")) * F.col("score")) / times).alias(name) for name, w in sums.items()]
    return scored.groupBy("key", "_own").agg(*added).select(F.col("key").alias(key), "_own.*", *sums)


def _picked(numbers: np.ndarray, at: Column) -> Column:
    return F.get(F.array(*(F.lit(float(x)) for x in numbers)), at)


def shapley(df: DataFrame, key: str, columns: list[str], score: Scorer, background: DataFrame, orders: int = 4, seed: int = 42) -> DataFrame:
    """key, the columns, phi_<column>, score, base: sampled Shapley values; they add up to score less base.

    Each background row is met in `orders` orders of the columns, every second one the reverse of the one before;
    in an order the columns turn one by one from the background's values to the row's, and a column is credited with
    what its turn changes. base is the mean score of the background rows. With two columns and two orders the values
    are exact. background: BACKGROUND rows at most, else an error; without any, there is nothing to compare with, and
    an empty background is an error as well.
    """
    base = background.na.drop(subset=columns).select(*(F.col(c).cast("double") for c in columns)).limit(BACKGROUND + 1).collect()
    if not 0 < len(base) <= BACKGROUND:
        raise ValueError(f"the background must have 1 to {BACKGROUND} rows without NULL")
    rng, d = np.random.default_rng(seed), len(columns)
    turned, stand_in, credit = [], [], []
    for row in sorted(tuple(r) for r in base):
        order = rng.permutation(d)
        for k in range(orders):
            order = order[::-1] if k % 2 else rng.permutation(d)
            for step in range(d + 1):
                turned.append(np.isin(np.arange(d), order[:step]))
                stand_in.append(row)
                change = np.zeros(d + 2)
                if step:
                    change[order[step - 1]] += 1
                if step < d:
                    change[order[step]] -= 1
                change[d], change[d + 1] = step == d, step == 0
                credit.append(change)
    runs = len(base) * orders
    mask, other, weights = np.array(turned, dtype=float), np.array(stand_in, dtype=float), np.array(credit) / runs
    names = [*(f"phi_{c}" for c in columns), "score", "base"]

    def value(j: int, own: Column) -> Column:
        return F.when(_picked(mask[:, j], F.col("_at")) == 1, own).otherwise(_picked(other[:, j], F.col("_at")))

    return _weighted(df, key, columns, score, len(mask), value, {name: weights[:, i] for i, name in enumerate(names)})


def shapley_summary(values: DataFrame, columns: list[str]) -> DataFrame:
    """name, mean_abs, direction: size of each column's Shapley values and their correlation with the column."""
    one = values.agg(*(F.avg(F.abs(f"phi_{c}")).alias(f"m{i}") for i, c in enumerate(columns)), *(E.safe_corr(c, f"phi_{c}").alias(f"d{i}") for i, c in enumerate(columns)))
    rows = [F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias("mean_abs"), F.col(f"d{i}").alias("direction")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def local_surrogate(df: DataFrame, key: str, columns: list[str], score: Scorer, draws: int = 64, width: float = 0.75, ridge: float = 1e-3, seed: int = 42) -> DataFrame:
    """key, the columns, slope_<column>, level: a linear model of the score around each row.

    The same draws, normal steps in units of a column's deviation over the frame, are taken around every row, weighted
    by a normal kernel of that width times the root of the number of columns. With equal draws for all rows the
    weighted ridge fit is one fixed matrix, so slopes (score for one deviation of a column) and level (fit at the
    row) are weighted sums of the scores. A column without spread has slope 0.
    """
    one = df.na.drop(subset=columns).agg(*(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    sd, d = np.array([one[f"s{i}"] or 0.0 for i in range(len(columns))]), len(columns)
    steps = np.random.default_rng(seed).normal(size=(draws, d)) * (sd > 0)
    weight = np.exp(-(steps**2).sum(axis=1) / (2 * width**2 * d))
    x = np.column_stack([steps, np.ones(draws)])
    penalty = np.diag([*([ridge] * d), 0.0]) + np.diag([*(sd <= 0), 0.0])
    fit = np.linalg.solve((x * weight[:, None]).T @ x + penalty, (x * weight[:, None]).T)
    names = [*(f"slope_{c}" for c in columns), "level"]

    def value(j: int, own: Column) -> Column:
        return own + _picked(steps[:, j] * sd[j], F.col("_at"))

    return _weighted(df, key, columns, score, draws, value, {name: fit[i] for i, name in enumerate(names)})
