"""Learning of prototypes from many starts at once: starts are a dimension of one aggregation a step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.partials import summed
from marlstone.sources import tables


def starts_from(rows: DataFrame, label: str, columns: list[str], starts: int, seed: int = 42) -> tuple[list, np.ndarray]:
    """The classes in order, and prototypes (start, class, column): the class means, then means moved by a normal
    draw of a class deviation, for every further start."""
    found = rows.groupBy(label).agg(*(F.struct(F.avg(c).alias("m"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("s")).alias(c) for c in columns)).orderBy(label).collect()  # a row per class
    mean, spread = (np.array([[r[c][i] for c in columns] for r in found], dtype=float).reshape(-1, len(columns)) for i in (0, 1))
    draw = np.random.default_rng(seed).normal(size=(starts, *mean.shape))
    draw[0] = 0
    return [r[label] for r in found], mean + draw * spread


def gradients(x: np.ndarray, y: np.ndarray, prototypes: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Summed loss of each start and its gradient over a block, a row counted `weight` times: the loss of a row is (d+ - d-) / (d+ + d-), the squared
    distances to the prototype of its own class and to the nearest of another."""
    loss, grad = np.zeros(len(prototypes)), np.zeros_like(prototypes)
    times = np.ones(len(x)) if weight is None else weight
    own = y[:, None] == np.arange(prototypes.shape[1])
    for s, w in enumerate(prototypes):
        d = ((x[:, None, :] - w) ** 2).sum(axis=2)
        good = d[np.arange(len(x)), y]
        other = np.where(own, np.inf, d)
        rival = other.argmin(axis=1)
        bad = other[np.arange(len(x)), rival]
        base = good + bad
        use = (base > 0) & np.isfinite(bad)
        loss[s] = ((good - bad)[use] / base[use] * times[use]).sum()
        pull, push = (np.where(use, times * v / np.where(use, base, 1) ** 2, 0.0) for v in (np.where(use, bad, 0), np.where(use, good, 0)))
        for c in range(len(w)):
            mine, theirs = y == c, rival == c
            grad[s, c] = -4 * (pull[mine, None] * (x[mine] - w[c])).sum(axis=0) + 4 * (push[theirs, None] * (x[theirs] - w[c])).sum(axis=0)
    return loss, grad


def learn(rows: DataFrame, label: str, columns: list[str], starts: int = 100, steps: int = 20, rate: float = 0.1, seed: int = 42) -> tuple[list, np.ndarray, np.ndarray]:
    """Classes, prototypes of every start and its mean loss after `steps` steps down the gradient.

    Equal rows are counted once and weigh as many, and the different ones are a written table, dealt over all tasks. A
    step is one job for all starts; its length is `rate` over the root of the step's number, along the gradient of the mean loss
    brought to length 1. The driver holds starts x classes x columns numbers. Rows with a NULL count for nothing.
    """
    classes, now = starts_from(rows.where(F.col(label).isNotNull()), label, columns, starts, seed)
    if len(classes) < 2:
        raise ValueError("two classes are needed")
    place = F.coalesce(*(F.when(F.col(label) == c, i) for i, c in enumerate(classes)))
    places = rows.select(*(F.col(c).cast("double").alias(c) for c in columns), place.alias("place"))
    coded = tables.spread(places.groupBy(*columns, "place").agg(F.count(F.lit(1)).alias("times")), "different")
    shape, size = now.shape, now.size

    def step(prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        def part(z: np.ndarray) -> np.ndarray:
            loss, grad = gradients(z[:, :-2], z[:, -2].astype(int), prototypes, z[:, -1])
            return np.concatenate(([z[:, -1].sum()], loss, grad.ravel()))

        total = summed(coded, [*columns, "place", "times"], part, 1 + shape[0] + size)
        n = max(total[0], 1)
        return total[1 : 1 + shape[0]] / n, total[1 + shape[0] :].reshape(shape) / n, int(total[0])

    for t in range(1, steps + 1):
        _, grad, _ = step(now)
        length = np.sqrt((grad**2).sum(axis=(1, 2), keepdims=True))
        now = now - rate / np.sqrt(t) * grad / np.where(length > 0, length, 1)
    loss, _, _ = step(now)
    return classes, now, loss
