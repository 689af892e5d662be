"""Central rows of clusters, and silhouettes of many groupings, in passes over a table without joins or shuffles of all rows.

The sum of a row's distances to a cluster is a sum over features (see `gower`), and for a number a convex function of its value
that is straight between the cluster's values. Its counts and sums at some edges, which blocks of rows add up, give it
exactly there and bound it between them, by chords from above and tangents from below. So a first pass counts, a second
keeps the rows that the bounds leave in question (few), and a third counts at the values of these: exact for all rows.

Every number has its values as edges where they are FEW, quantiles else; the least and greatest are among them.
Clusters of all settings are handled at once, numbered through. Codes are few values, held as their places in a list.
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

#: Most values of a number that are all edges; quantiles taken else, in the search and where every row is worked out.
FEW, SEARCH_EDGES, ROW_EDGES = 256, 128, 1024
#: Most values of a code.
MOST_CODES = 1000


class Coded(NamedTuple):
    """A written table of key, numbers in [0, 1] and codes as places (-1: unknown), and what is known of its columns."""

    rows: DataFrame
    key: str
    numbers: list[str]
    codes: list[str]
    values: list[list[str]]
    exact: list[bool]


def coded(scaled: DataFrame, key: str, numbers: list[str], codes: list[str]) -> Coded | None:
    """The table for rows of `gower.scaled_rows`, spread over all tasks; None where a code has more than MOST_CODES values."""
    own, values = scaled, []
    for c in codes:
        seen = sorted(r[0] for r in scaled.select(c).where(F.col(c).isNotNull()).distinct().limit(MOST_CODES + 1).collect())
        if len(seen) > MOST_CODES:
            return None
        held = scaled.sparkSession.createDataFrame([(v, i) for i, v in enumerate(seen)], f"`{c}` string, place int")
        own = own.join(F.broadcast(held), c, "left").drop(c).withColumn(c, F.coalesce("place", F.lit(-1))).drop("place")
        values.append(seen)
    exact = [scaled.select(c).where(F.col(c).isNotNull()).distinct().limit(FEW + 1).count() <= FEW for c in numbers]
    return Coded(tables.spread(own.select(key, *numbers, *codes), "coded", key), key, numbers, codes, values, exact)


def edges(own: Coded, n: int) -> list[np.ndarray]:
    """Ascending edges of each number: all its values, or about n quantiles with the least and greatest."""
    out = []
    for c, exact in zip(own.numbers, own.exact, strict=True):
        if exact:
            found = [r[0] for r in own.rows.select(c).where(F.col(c).isNotNull()).distinct().collect()]  # FEW
        else:
            r = own.rows.agg(F.percentile_approx(c, [i / n for i in range(n + 1)], 20 * n).alias("q"), F.min(c).alias("a"), F.max(c).alias("b")).first()
            found = [*r.q, r.a, r.b]
        out.append(np.unique(np.array(found, dtype=float)))
    return out


class Settings(NamedTuple):
    """Medoids of each setting as arrays, in order of their labels; cluster numbers start at `first`."""

    names: list[int]
    labels: list[list[int]]
    first: list[int]
    x: list[np.ndarray]
    c: list[np.ndarray]
    n: int


def settings(own: Coded, medoids: dict[tuple[int, int], tuple]) -> Settings:
    """From (setting, label) to key, numbers and codes as text."""
    names = sorted({s for s, _ in medoids})
    labels = [sorted(i for t, i in medoids if t == s) for s in names]
    j = 1 + len(own.numbers)
    places = [{v: i for i, v in enumerate(seen)} for seen in own.values]
    x = [np.array([[np.nan if v is None else v for v in medoids[s, i][1:j]] for i in found], dtype=float).reshape(len(found), -1) for s, found in zip(names, labels, strict=True)]
    c = [np.array([[p.get(v, -1) for p, v in zip(places, medoids[s, i][j:], strict=True)] for i in found], dtype=int).reshape(len(found), -1) for s, found in zip(names, labels, strict=True)]
    sizes = [len(found) for found in labels]
    return Settings(names, labels, [sum(sizes[:i]) for i in range(len(sizes))], x, c, sum(sizes))


def _nearest(at: Settings, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster number and distance of every row in each setting, the first label on ties."""
    out, far = np.zeros((len(at.names), len(x)), dtype=int), np.zeros((len(at.names), len(x)))
    parts = x.shape[1] + c.shape[1]
    for s, (mx, mc) in enumerate(zip(at.x, at.c, strict=True)):
        best = np.full(len(x), np.inf)
        for i in range(len(mx)):
            d = np.zeros(len(x))
            for j in range(x.shape[1]):
                if mx[i, j] == mx[i, j]:
                    d += np.nan_to_num(np.abs(x[:, j] - mx[i, j]))
            for j in range(c.shape[1]):
                if mc[i, j] >= 0:
                    d += (c[:, j] != mc[i, j]) & (c[:, j] >= 0)
            d /= parts
            nearer = d < best
            out[s][nearer], best[nearer] = at.first[s] + i, d[nearer]
        far[s] = best
    return out, far


def _unpacked(z: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    return z[:, :j], z[:, j:].astype(int)


def _read(own: Coded) -> DataFrame:
    """Numbers with NaN for unknown ones, and codes."""
    return own.rows.select(*(F.coalesce(c, F.lit(float("nan"))).alias(c) for c in own.numbers), *own.codes)


class Curves(NamedTuple):
    """Counts and sums of each cluster's values up to each edge, for each number; counts of each code; sizes, sums of distances."""

    edges: list[np.ndarray]
    n: list[np.ndarray]
    s: list[np.ndarray]
    codes: list[np.ndarray]
    sizes: np.ndarray
    inertia: np.ndarray

    def at_edges(self, j: int) -> np.ndarray:
        """Sums of differences to the values of a cluster, at the edges of a number (cluster, edge)."""
        n, s, e = self.n[j], self.s[j], self.edges[j]
        return e * (2 * n - n[:, -1:]) - (2 * s - s[:, -1:]) if len(e) else np.zeros((len(n), 0))

    def at_codes(self, j: int) -> np.ndarray:
        """Rows that differ from each value of a code; the last column, for unknown, is 0."""
        n = self.codes[j]
        return np.concatenate((n.sum(axis=1, keepdims=True) - n, np.zeros((len(n), 1))), axis=1)


def curves(own: Coded, at: Settings, ends: list[np.ndarray]) -> Curves:
    """One pass."""
    j, k = len(own.numbers), at.n
    shapes = [(k, len(e)) for e in ends for _ in range(2)] + [(k, len(v)) for v in own.values] + [(k, 1), (k, 1)]
    cuts = np.cumsum([0, *(a * b for a, b in shapes)])

    def part(z: np.ndarray) -> np.ndarray:
        x, c = _unpacked(z, j)
        label, far = _nearest(at, x, c)
        known = [np.flatnonzero(~np.isnan(x[:, i])) for i in range(j)]
        place = [np.searchsorted(e, x[w, i]) for i, (e, w) in enumerate(zip(ends, known, strict=True))]
        seen = [np.flatnonzero(c[:, i] >= 0) for i in range(c.shape[1])]
        out = [np.zeros(a * b) for a, b in shapes]
        for own_label, d in zip(label, far, strict=True):
            for i, (e, w) in enumerate(zip(ends, known, strict=True)):
                cell = own_label[w] * len(e) + place[i]
                out[2 * i] += np.bincount(cell, minlength=k * len(e))
                out[2 * i + 1] += np.bincount(cell, x[w, i], minlength=k * len(e))
            for i, w in enumerate(seen):
                m = shapes[2 * j + i][1]
                out[2 * j + i] += np.bincount(own_label[w] * m + c[w, i], minlength=k * m)
            out[-2] += np.bincount(own_label, minlength=k)
            out[-1] += np.bincount(own_label, d, minlength=k)
        return np.concatenate(out)

    total = summed(_read(own), [*own.numbers, *own.codes], part, int(cuts[-1]))
    found = [total[a:b].reshape(shape) for a, b, shape in zip(cuts, cuts[1:], shapes, strict=False)]
    return Curves(ends, [np.cumsum(f, axis=1) for f in found[0 : 2 * j : 2]], [np.cumsum(f, axis=1) for f in found[1 : 2 * j : 2]], found[2 * j : -2], found[-2][:, 0], found[-1][:, 0])


def _bounds(curve: Curves, j: int, flat: np.ndarray, label: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that the sum of differences to the own cluster can be at values of a number; equal at edges."""
    e, n = curve.edges[j], curve.n[j]
    known = ~np.isnan(x)
    b = np.searchsorted(e, np.where(known, x, e[0] if len(e) else 0))
    a = np.maximum(b - 1, 0)
    if not len(e):
        return np.zeros(len(x)), np.zeros(len(x))
    width, whole = e[b] - e[a], n[label, -1]
    w = np.where(width > 0, (x - e[a]) / np.where(width > 0, width, 1), 1)
    fa, fb = flat[label, a], flat[label, b]
    up = fa * (1 - w) + fb * w
    low = np.maximum(fa + (2 * n[label, a] - whole) * (x - e[a]), fb - (2 * n[label, b] - whole) * (e[b] - x))
    edge = x == e[b]
    low, up = np.where(edge, fb, low), np.where(edge, fb, up)
    return np.where(known, np.minimum(low, up), 0), np.where(known, up, 0)


def _in_question(own: Coded, at: Settings, curve: Curves) -> pd.DataFrame:
    """cluster, key, numbers, codes, low, up: the different rows that can be the most central of their cluster, each by its least key."""
    key, numbers, codes = own.key, own.numbers, own.codes
    j, names = len(numbers), [*numbers, *codes]
    slack = 1e-11 * curve.sizes + 2e-9
    flat = [curve.at_edges(i) for i in range(j)]
    differ = [curve.at_codes(i) for i in range(len(own.codes))]

    def least(found: pd.DataFrame) -> pd.DataFrame:
        best = found.groupby("cluster")["up"].transform("min")
        own_slack = slack[found["cluster"].to_numpy()]
        near = found[found["low"].to_numpy() <= best.to_numpy() + own_slack]
        return near.sort_values(key).drop_duplicates(["cluster", *names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            x, c = batch[numbers].to_numpy(float), batch[codes].to_numpy(int)
            label, _ = _nearest(at, x, c)
            for own_label in label:
                low = up = np.zeros(len(x))
                for i in range(j):
                    a, b = _bounds(curve, i, flat[i], own_label, x[:, i])
                    low, up = low + a, up + b
                for i, d in enumerate(differ):
                    low, up = low + d[own_label, c[:, i]], up + d[own_label, c[:, i]]
                parts = x.shape[1] + c.shape[1]
                best = np.full(at.n, np.inf)
                np.minimum.at(best, own_label, up / parts)
                near = np.flatnonzero(low / parts <= best[own_label] + slack[own_label])
                now = batch.iloc[near].assign(cluster=own_label[near], low=low[near] / parts, up=up[near] / parts)
                held = now if held is None else pd.concat((held, now), ignore_index=True)
            held = least(held)
        if held is not None:
            yield held[["cluster", key, *names, "low", "up"]]

    kind = own.rows.schema[key].dataType.simpleString()
    schema = f"cluster int, `{key}` {kind}, {', '.join(f'`{c}` double' for c in own.numbers)}{''.join(f', `{c}` int' for c in own.codes)}, low double, up double"
    rows = own.rows.select(key, *own.numbers, *own.codes)
    return least(rows.mapInPandas(run, schema).toPandas())  # a few rows of each cluster and task


def _exact_at(own: Coded, at: Settings, found: pd.DataFrame, columns: list[int]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each cluster and number: the values in question, and the sums of differences to the cluster's values there."""
    j = len(own.numbers)
    asked = {(g, i): np.unique(v[own.numbers[i]].dropna().to_numpy(float)) for g, v in found.groupby("cluster") for i in columns}
    starts = np.cumsum([0, *(2 * (len(v) + 1) for v in asked.values())])
    place = dict(zip(asked, starts, strict=False))

    def part(z: np.ndarray) -> np.ndarray:
        x, c = _unpacked(z, j)
        out = np.zeros(int(starts[-1]))
        label, _ = _nearest(at, x, c)
        clusters = {g for g, _ in asked}
        for own_label in label:
            order = np.argsort(own_label, kind="stable")
            cut = np.searchsorted(own_label[order], np.arange(at.n + 1))
            for g in clusters:
                inside = x[order[cut[g] : cut[g + 1]]]
                if len(inside):
                    for i in columns:
                        v = inside[:, i][~np.isnan(inside[:, i])]
                        b, m = np.searchsorted(asked[g, i], v), len(asked[g, i]) + 1
                        out[place[g, i] : place[g, i] + m] += np.bincount(b, minlength=m)
                        out[place[g, i] + m : place[g, i] + 2 * m] += np.bincount(b, v, minlength=m)
        return out

    total = summed(_read(own), [*own.numbers, *own.codes], part, int(starts[-1]))
    made = {}
    for at_, v in asked.items():
        m = len(v) + 1
        n, s = np.cumsum(total[place[at_] : place[at_] + m]), np.cumsum(total[place[at_] + m : place[at_] + 2 * m])
        made[at_] = v, v * (2 * n[:-1] - n[-1]) - (2 * s[:-1] - s[-1])
    return made


def central(own: Coded, medoids: dict[tuple[int, int], tuple], ends: list[np.ndarray]) -> dict[tuple[int, int], tuple]:
    """The row of least total distance to its cluster, for each medoid's cluster that has rows; ties by key, totals to nine digits."""
    at = settings(own, medoids)
    curve = curves(own, at, ends)
    found = _in_question(own, at, curve)
    many = [i for i, exact in enumerate(own.exact) if not exact]
    if many and len(found) > found["cluster"].nunique():
        total = np.zeros(len(found))
        g = found["cluster"].to_numpy()
        made = _exact_at(own, at, found, many)
        for i, c in enumerate(own.numbers):
            x = found[c].to_numpy(float)
            if i in many:
                total += [made[k, i][1][np.searchsorted(made[k, i][0], v)] if v == v else 0.0 for k, v in zip(g, x, strict=True)]
            else:
                total += _bounds(curve, i, curve.at_edges(i), g, x)[1]
        for i, c in enumerate(own.codes):
            total += curve.at_codes(i)[g, found[c].to_numpy(int)]
        found = found.assign(up=total / (len(own.numbers) + len(own.codes)))
    found = found.assign(up=found["up"].round(9)).sort_values(["cluster", "up", own.key]).drop_duplicates("cluster")
    names = [(s, i) for s, found_labels in zip(at.names, at.labels, strict=True) for i in found_labels]
    out = {}
    for r in found.to_dict("records"):
        numbers = [None if r[c] != r[c] else float(r[c]) for c in own.numbers]
        out[names[r["cluster"]]] = (r[own.key], *numbers, *(None if r[c] < 0 else v[r[c]] for c, v in zip(own.codes, own.values, strict=True)))
    return out


def _ranged(frame: DataFrame, column: str, ends: np.ndarray, key: str) -> DataFrame:
    """Adds range: the place of the value's range; rows at an edge or without a value are dealt by a hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[column].to_numpy(float)
            b = np.searchsorted(ends, np.where(np.isnan(x), -np.inf, x))
            yield batch.assign(range=np.where(np.isnan(x) | (ends[b] == x) if len(ends) else True, -1 - batch["dealt"], b).astype(np.int64)).drop(columns="dealt")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.withColumn("dealt", F.pmod(F.xxhash64(key), F.lit(ROW_EDGES))).mapInPandas(run, f"{schema}, range long")


def silhouette_sums(own: Coded, medoids: dict[tuple[int, int], tuple]) -> list[tuple[int, float, float]]:
    """setting, mean silhouette and sum of distances over all rows at their nearest medoids.

    A number with more than FEW values is worked out range by range: a row at an edge has its sums from the counts, rows
    between two edges (about a ROW_EDGES-th of all at most, as a value that fills more is an edge) are sorted within their range. Sums to
    all clusters go along as an array where there are several such numbers.
    """
    at, j = settings(own, medoids), len(own.numbers)
    curve = curves(own, at, edges(own, ROW_EDGES))
    flat = [curve.at_edges(i) for i in range(j)]
    differ = [curve.at_codes(i) for i in range(len(own.codes))]
    parts, sizes = j + len(own.codes), curve.sizes
    many = [i for i, exact in enumerate(own.exact) if not exact]
    key, numbers, codes = own.key, own.numbers, own.codes
    names = [*numbers, *codes]

    def begun(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), at.n))
        for i in range(j):
            if i not in many:
                known = ~np.isnan(x[:, i])
                total[known] += flat[i].T[np.searchsorted(curve.edges[i], x[known, i])]
        for i, d in enumerate(differ):
            total += d.T[c[:, i]]
        return total

    def within(i: int, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Sums of differences at values of one range (a, b]: counts up to a, and those of the range's own rows."""
        e, n, s = curve.edges[i], curve.n[i], curve.s[i]
        out = np.zeros((len(x), at.n))
        order = np.argsort(x)
        order = order[~np.isnan(x[order])]
        b = np.searchsorted(e, x[order])
        on = x[order] == e[b]
        out[order[on]] = flat[i].T[b[on]]
        order, b = order[~on], b[~on]
        if len(order):
            a, v = b[0] - 1, x[order]
            mine = np.zeros((len(order), at.n))
            for own_label in label:
                mine[np.arange(len(order)), own_label[order]] = 1
            upto, sums = n[:, a] + np.cumsum(mine, axis=0), s[:, a] + np.cumsum(mine * v[:, None], axis=0)
            out[order] = v[:, None] * (2 * upto - n[:, -1]) - (2 * sums - s[:, -1])
        return out

    def ended(total: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Sum of the rows' silhouettes and their number, for each setting."""
        out = np.zeros((len(at.names), 2))
        total = total / parts
        for s, (first, found) in enumerate(zip(at.first, at.labels, strict=True)):
            own_total, own_size, mine = total[:, first : first + len(found)], sizes[first : first + len(found)], label[s] - first
            rows = np.arange(len(mine))
            a = own_total[rows, mine] / np.maximum(own_size[mine] - 1, 1)
            means = np.where(own_size > 0, own_total / np.maximum(own_size, 1), np.inf)
            means[rows, mine] = np.inf
            b = means.min(axis=1)
            most = np.maximum(a, b)
            use = (own_size[mine] >= 2) & np.isfinite(b) & (most != 0)
            out[s] = ((b - a)[use] / most[use]).sum(), len(mine)
        return out

    def step(place: int):
        last = place >= len(many) - 1

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            x, c = batch[numbers].to_numpy(float), batch[codes].to_numpy(int)
            label, _ = _nearest(at, x, c)
            total = begun(x, c) if place == 0 else np.stack(batch["totals"].to_numpy())
            if many:
                total = total + within(many[place], x[:, many[place]], label)
            if last:
                return pd.DataFrame({"v": [ended(total, label).ravel().tolist()]})
            return batch[[key, *names]].assign(totals=list(total))

        return run

    kind = own.rows.schema[key].dataType.simpleString()
    carried = f"`{key}` {kind}, {', '.join(f'`{c}` double' for c in own.numbers)}{''.join(f', `{c}` int' for c in own.codes)}, totals array<double>"
    frame = own.rows
    if not many:
        frame = frame.mapInPandas(lambda batches: (step(0)(b) for b in batches if len(b)), "v array<double>")
    for place, i in enumerate(many):
        dealt = _ranged(frame, own.numbers[i], curve.edges[i], key)
        frame = dealt.groupBy("range").applyInPandas(step(place), "v array<double>" if place == len(many) - 1 else carried)
    sums = frame.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    got = {r["at"]: r.v for r in sums}
    return [(s, got[2 * i] / got[2 * i + 1], float(curve.inertia[at.first[i] : at.first[i] + len(at.labels[i])].sum())) for i, s in enumerate(at.names)] if got else []
