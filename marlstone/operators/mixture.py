"""Gaussian mixtures by variational inference under a Dirichlet-process prior: components that the data do not need fade.

Weights come from breaking a stick, means and precisions have Gauss-Wishart priors. A step is one aggregation over all
rows: each task works out responsibilities of its rows under the expected log weights and precisions, and sends
counts, sums and products by component; the driver updates the posteriors, which are k vectors and k small matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.partials import summed


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function for x > 0: recursion up to 6, then its asymptotic series."""
    x, out = np.asarray(x, dtype=float).copy(), np.zeros(np.shape(x))
    while (x < 6).any():
        out = np.where(x < 6, out - 1 / x, out)
        x = np.where(x < 6, x + 1, x)
    s = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))


@dataclass(frozen=True)
class Prior:
    """What is believed before any row: concentration of the stick, weight of the mean, the mean, degrees of freedom, scale."""

    concentration: float
    mean_weight: float
    mean: np.ndarray
    freedom: float
    scale: np.ndarray


@dataclass(frozen=True)
class Posterior:
    """Beta parameters of the stick's breaks, weights and values of the means, degrees of freedom, covariances."""

    a: np.ndarray
    b: np.ndarray
    mean_weight: np.ndarray
    mean: np.ndarray
    freedom: np.ndarray
    cov: np.ndarray

    def weights(self) -> np.ndarray:
        """Expected weights of the components, brought to a sum of 1."""
        share = self.a / (self.a + self.b)
        left = np.concatenate(([1.0], np.cumprod(1 - share)[:-1]))
        return share * left / (share * left).sum()

    def log_rho(self, x: np.ndarray) -> np.ndarray:
        """Expected log weight and density of each component at each row."""
        d = x.shape[1]
        both = digamma(self.a + self.b)
        stick = digamma(self.a) - both + np.concatenate(([0.0], np.cumsum(digamma(self.b) - both)[:-1]))
        out = np.zeros((len(x), len(self.a)))
        for k in range(len(self.a)):
            lower = np.linalg.cholesky(self.cov[k])
            z = np.linalg.solve(lower, (x - self.mean[k]).T)
            log_det = -2 * np.log(np.diag(lower)).sum() - d * math.log(self.freedom[k])
            wishart = d * math.log(2) + digamma(0.5 * (self.freedom[k] - np.arange(d))).sum()
            out[:, k] = stick[k] + 0.5 * (log_det + wishart - d / self.mean_weight[k] - d * math.log(2 * math.pi) - (z * z).sum(axis=0))
        return out

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        rho = self.log_rho(x)
        rho = np.exp(rho - rho.max(axis=1, keepdims=True))
        return rho / rho.sum(axis=1, keepdims=True)


def prior_of(rows: DataFrame, columns: list[str], k: int) -> tuple[int, Prior]:
    """Number of rows without a NULL, and the customary prior: 1 / k, 1, the mean, as many degrees as columns, the sample covariance."""
    d = len(columns)

    def part(x: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))

    total = summed(rows, columns, part, 1 + d + d * d)
    n = int(total[0])
    mean = total[1 : 1 + d] / max(n, 1)
    cov = (total[1 + d :].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
    return n, Prior(1 / k, 1.0, mean, float(d), cov)


def statistics(rows: DataFrame, columns: list[str], k: int, share) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products of the components, where share gives each row's responsibilities."""
    d = len(columns)

    def part(x: np.ndarray) -> np.ndarray:
        r = share(x)
        products = np.stack([(x * r[:, [j]]).T @ x for j in range(k)])
        return np.concatenate((r.sum(axis=0), (r.T @ x).ravel(), products.ravel()))

    total = summed(rows, columns, part, k * (1 + d + d * d))
    return total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d :].reshape(k, d, d)


def updated(prior: Prior, n: np.ndarray, sums: np.ndarray, products: np.ndarray, floor: float = 1e-6) -> Posterior:
    """Posteriors from a step's statistics; floor is added to the diagonals of the components' covariances."""
    n = n + 10 * np.finfo(float).eps
    mean = sums / n[:, None]
    spread = products / n[:, None, None] - mean[:, :, None] * mean[:, None, :] + floor * np.eye(mean.shape[1])
    later = np.concatenate((np.cumsum(n[::-1])[-2::-1], [0.0]))
    weight, freedom = prior.mean_weight + n, prior.freedom + n
    gap = mean - prior.mean
    scale = prior.scale + n[:, None, None] * spread + (n * prior.mean_weight / weight)[:, None, None] * gap[:, :, None] * gap[:, None, :]
    centre = (prior.mean_weight * prior.mean + n[:, None] * mean) / weight[:, None]
    return Posterior(1 + n, prior.concentration + later, weight, centre, freedom, scale / freedom[:, None, None])


def fit(rows: DataFrame, columns: list[str], k: int = 15, steps: int = 1000, tolerance: float = 1e-3, seed: int = 42) -> tuple[Posterior, int]:
    """Posterior of at most k components and the number of steps; ends where no expected weight moves by tolerance / 10.

    Starts from clusters around k means. Give a written frame: each step reads it once.
    """
    n, prior = prior_of(rows, columns, k)
    if not n:
        raise ValueError("no rows")
    whole = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(rows.select(*(F.col(c).cast("double").alias(c) for c in columns)))
    centres = np.array([np.asarray(c) for c in KMeans(k=k, seed=seed, maxIter=20).fit(whole).clusterCenters()])

    def nearest(x: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        return (d.argmin(axis=1)[:, None] == np.arange(k)).astype(float)

    now = updated(prior, *statistics(rows, columns, k, nearest))
    for step in range(1, steps + 1):
        new = updated(prior, *statistics(rows, columns, k, now.responsibilities))
        moved = np.abs(new.weights() - now.weights()).max()
        now = new
        if moved < tolerance / 10:
            break
    return now, step


def personas(rows: DataFrame, columns: list[str], posterior: Posterior, least_weight: float = 0.05) -> DataFrame:
    """Adds component, persona and confidence: a row's likeliest component, its number among those above a weight
    (from 0, NULL for others), and its responsibility. Rows with a NULL in a column have none of them."""
    kept = [int(k) for k in np.flatnonzero(posterior.weights() > least_weight)]
    number = {k: i for i, k in enumerate(kept)}
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, component int, persona int, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            x = own[columns].to_numpy(float)
            whole = np.isfinite(x).all(axis=1)
            r = np.zeros((len(x), len(posterior.a)))
            if whole.any():
                r[whole] = posterior.responsibilities(x[whole])
            best = r.argmax(axis=1)
            found = pd.Series(best).where(whole)
            yield own.assign(component=found.astype("Int32").to_numpy(), persona=found.map(number).astype("Int32").to_numpy(), confidence=pd.Series(r.max(axis=1)).where(whole).to_numpy())

    return rows.mapInPandas(run, out)
