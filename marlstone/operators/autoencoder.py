"""A masked autoencoder for interactions, trained by gradients that are summed over all partitions each step.

Rows are clients, columns products; only observed cells count in the loss, and some of a row's observed cells are hidden from
the input by a hash of row and step. The optimiser's state (weights and their moments) is on the driver, as are
a few thousand weights; rows never are. Training ends when the loss on held-out cells no longer falls.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.partials import summed
from marlstone.sources import tables


class Layer(NamedTuple):
    """Weights and offsets of a layer."""

    w: np.ndarray
    b: np.ndarray


def started(sizes: list[int], seed: int = 42) -> list[Layer]:
    """Layers of these sizes with random weights."""
    rng = np.random.default_rng(seed)
    return [Layer(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def flat(layers: list[Layer]) -> np.ndarray:
    return np.concatenate([v.ravel() for layer in layers for v in layer])


def shaped(vector: np.ndarray, layers: list[Layer]) -> list[Layer]:
    """The vector's numbers in the shapes of the layers."""
    out, at = [], 0
    for layer in layers:
        own = []
        for v in layer:
            own.append(vector[at : at + v.size].reshape(v.shape))
            at += v.size
        out.append(Layer(*own))
    return out


def outputs(layers: list[Layer], x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives, the input first: rectified sums, and 1 / (1 + exp(-sum)) at the end."""
    out = [x]
    for i, layer in enumerate(layers):
        s = out[-1] @ layer.w + layer.b
        out.append(np.maximum(s, 0) if i < len(layers) - 1 else 1 / (1 + np.exp(-np.clip(s, -30, 30))))
    return out


def loss_and_gradient(layers: list[Layer], x: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of squared errors over the cells of the mask, and its gradient."""
    out = outputs(layers, x)
    error = (out[-1] - target) * mask
    back, grads = 2 * error * out[-1] * (1 - out[-1]), []
    for i in range(len(layers) - 1, -1, -1):
        grads.append(Layer(out[i].T @ back, back.sum(axis=0)))
        if i:
            back = (back @ layers[i].w.T) * (out[i] > 0)
    return float((error**2).sum()), flat(grads[::-1])


def _hidden(keys: np.ndarray, columns: int, step: int, share: float) -> np.ndarray:
    """Cells hidden from the input, by a mix of the row's key, the column and the step."""
    z = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, columns + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(step) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(32)
    return (z >> np.uint64(11)).astype(float) / float(1 << 53) < share


def train(rows: DataFrame, key: str, cells: list[str], held: list[str], width: int = 8, hidden: tuple[int, ...] = (32,), steps: int = 200, rate: float = 0.02, decay: float = 1e-4, corruption: float = 0.15, patience: int = 15, seed: int = 42) -> tuple[list[Layer], list[float]]:
    """The layers with the least loss on held-out cells, and that loss by step.

    rows: an integer key, cells (NULL or 0 where nothing is observed) and, for each, whether it is held out of training (0/1).
    Each step is one job over a written frame, dealt over all tasks.
    """
    n, best, waited, losses = len(cells), np.inf, 0, []
    layers = started([n, *hidden, width, *hidden[::-1], n], seed)
    weights = flat(layers)
    kept, m, v = layers, np.zeros_like(weights), np.zeros_like(weights)
    own = tables.spread(rows.select(F.col(key).cast("double").alias(key), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cells), *(F.col(h).cast("double").alias(h) for h in held)), "cells", key)
    for step in range(1, steps + 1):
        now = layers

        def part(z: np.ndarray, now=now, step=step) -> np.ndarray:
            x, out_cells = z[:, 1 : n + 1], z[:, n + 1 :] > 0
            seen = (x > 0) & ~out_cells
            shown = x * seen
            _, grad = loss_and_gradient(now, shown * ~_hidden(z[:, 0], n, step, corruption), x, seen)
            test = (x > 0) & out_cells
            error = (outputs(now, shown)[-1] - x) * test
            return np.concatenate(([seen.sum(), test.sum(), (error**2).sum()], grad))

        total = summed(own, [key, *cells, *held], part, 3 + len(weights))
        loss = total[2] / max(total[1], 1)
        losses.append(float(loss))
        if loss < best - 1e-6:
            best, kept, waited = loss, layers, 0
        else:
            waited += 1
            if waited >= patience:
                break
        grad = total[3:] / max(total[0], 1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights = weights * (1 - rate * decay) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        layers = shaped(weights, layers)
    return kept, losses


def reconstructed(rows: DataFrame, key: str, cells: list[str], held: list[str], layers: list[Layer]) -> DataFrame:
    """key and for each cell its reconstruction from the row's cells that are not held out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            x = own[cells].to_numpy(float, na_value=0.0)
            x = np.where(np.isfinite(x), x, 0.0) * (own[held].to_numpy(float) <= 0)
            yield pd.DataFrame({key: own[key]} | dict(zip(cells, outputs(layers, x)[-1].T, strict=True)))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *cells, *held).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"`{c}` double" for c in cells))
