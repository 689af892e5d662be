"""Silhouettes and medoids from sums over features, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import centres, gower, panel

NUMBERS, CODES = ["x", "y", "flat"], ["g", "h"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    found = [(i, float(round(rng.normal(), 1)), float(rng.choice([0.0, 0.0, 0.0, 5.0, rng.uniform()])), 7.0, str(rng.choice(list("abc"))), int(rng.integers(2))) for i in range(150)]
    found += [(200, None, None, None, None, None), (201, None, 1.0, 7.0, "a", None), (202, *found[3][1:]), (203, *found[3][1:])]
    return found


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, flat double, g string, h int").repartition(5)


def all_pairs(rows):
    n = len(rows)
    d = np.zeros((n, n))
    for c in range(1, 6):
        v = [r[c] for r in rows]
        if c < 4:
            known = [a for a in v if a is not None]
            span = max(known) - min(known)
            d += [[abs(a - b) / span if a is not None and b is not None and span else 0 for b in v] for a in v]
        else:
            d += [[float(a != b) if a is not None and b is not None else 0 for b in v] for a in v]
    return d / 5


def brute_silhouette(d, label):
    out = []
    for i, own in enumerate(label):
        means = {c: d[i, [j for j, other in enumerate(label) if other == c and (j != i)]] for c in set(label)}
        others = [m.mean() for c, m in means.items() if c != own]
        a = means[own].mean() if len(means[own]) else None
        out.append(0.0 if a is None or not others or max(a, *others, 0) == 0 else (min(others) - a) / max(a, min(others)))
    return out


@pytest.mark.parametrize("range_rows", [50_000, 7])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_silhouettes(spark, rows, frame, monkeypatch, k, range_rows):
    monkeypatch.setattr(panel, "RANGE_ROWS", range_rows)
    label = [i * i % 7 % k for i in range(len(rows))]
    label[0] = k  # alone in its cluster
    scaled = gower.scaled_rows(frame, "id", NUMBERS, CODES)
    labels = spark.createDataFrame([(r[0], c) for r, c in zip(rows, label, strict=True)], "id long, label int")
    got = {r.id: r.silhouette for r in gower.silhouettes(scaled.join(labels, "id"), [], "id", NUMBERS, CODES, k + 1).collect()}
    want = brute_silhouette(all_pairs(rows), label)
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-9)


def test_cluster_totals_by_setting(spark, rows, frame):
    d = all_pairs(rows)
    scaled = gower.scaled_rows(frame, "id", NUMBERS, CODES)
    own = scaled.withColumn("setting", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("label", (F.col("id") % F.col("setting")).cast("int"))
    place = {r[0]: i for i, r in enumerate(rows)}
    for r in gower.cluster_totals(own, ["setting"], "id", NUMBERS, CODES, 3).collect():
        want = [d[place[r.id], [i for i, x in enumerate(rows) if x[0] % r.setting == c]].sum() for c in range(3)]
        assert r.totals == pytest.approx(want, abs=1e-9)


def test_medoids_settle_in_the_middle_of_their_clusters(rows, frame):
    """Every row is at its nearest medoid, and no other row of a cluster is nearer to the whole of it."""
    rows, frame = [r for r in rows if r[0] != 200], frame.where("id <> 200")  # a row of unknowns is at no distance from any
    d = all_pairs(rows)
    place = {r[0]: i for i, r in enumerate(rows)}
    found, scaled = gower.medoids(frame, "id", NUMBERS, CODES, [2, 4], steps=50)
    chosen = {(r.setting, r.label): place[r.id] for r in found.collect()}
    assert sorted(chosen) == [(2, 0), (2, 1), (4, 0), (4, 1), (4, 2), (4, 3)]
    for k in (2, 4):
        medoids = [chosen[k, c] for c in range(k)]
        got = {r.id: (r.label, r.distance) for r in gower.assigned(scaled, found, "id", NUMBERS, CODES).where(F.col("setting") == k).collect()}
        for r in rows:
            near = d[place[r[0]], medoids]
            assert got[r[0]][1] == pytest.approx(near.min(), abs=1e-9) and near[got[r[0]][0]] == pytest.approx(near.min(), abs=1e-9)
        for c, m in enumerate(medoids):
            own = [place[i] for i, (label, _) in got.items() if label == c]
            assert d[np.ix_(own, own)].sum(axis=1).min() == pytest.approx(d[m, own].sum(), abs=1e-6)


def test_number_of_medoids(spark):
    df = spark.createDataFrame([(i, float(i % 3) * 10 + i * 0.001, "a") for i in range(90)], "id long, x double, g string")
    found = {r.k: r for r in gower.medoid_counts(df, "id", ["x"], ["g"], [2, 3, 4, 5]).collect()}
    assert [k for k, r in found.items() if r.best] == [3] and found[3].silhouette > 0.9
    assert found[2].inertia > found[3].inertia > found[5].inertia


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, 2.0, "a"), (2, 2.0, "a")], "id long, x double, g string")
    assert [(r.id, r.label, r.distance) for r in gower.k_medoids(one, "id", ["x"], ["g"], 3).orderBy("id").collect()] == [(1, 0, 0.0), (2, 0, 0.0)]
    assert gower.k_medoids(one.limit(0), "id", ["x"], ["g"], 3).count() == 0


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(panel, "RANGE_ROWS", 10)
    rng = np.random.default_rng(5)
    rows = [(str(i % 2), float(v), float(w)) for i, (v, w) in enumerate(zip(rng.permutation(200), rng.normal(size=200), strict=True))]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    for r in panel.running_totals(df, ["g"], "v", ["w"]).collect():
        own = [w for g, v, w in rows if g == r.g]
        assert r.all_w == pytest.approx(sum(own)) and r.run_w == pytest.approx(sum(w for g, v, w in rows if g == r.g and v <= r.v))


@pytest.mark.parametrize("few", [256, 3])
def test_counts_at_edges_find_the_same_as_all_pairs(spark, rows, monkeypatch, few):
    """Numbers with more values than edges: bounds between edges leave the right rows, and every row's silhouette counts."""
    for name, n in (("FEW", few), ("SEARCH_EDGES", 4), ("ROW_EDGES", 5)):
        monkeypatch.setattr(centres, name, n)
    rows = [r for r in rows if r[0] != 200]
    frame = spark.createDataFrame(rows, "id long, x double, y double, flat double, g string, h int").repartition(3)
    d = all_pairs(rows)
    found, scaled = gower.medoids(frame, "id", NUMBERS, CODES, [2, 4], steps=50)
    chosen = {(r.setting, r.label): r.id for r in found.collect()}
    got = {r.k: r for r in gower.medoid_counts(frame, "id", NUMBERS, CODES, [2, 4], steps=50).collect()}
    for k in (2, 4):
        held = [[r[0] for r in rows].index(chosen[k, c]) for c in range(k)]
        label = d[:, held].argmin(axis=1)
        for c, m in enumerate(held):
            own = np.flatnonzero(label == c)
            assert d[m, own].sum() == pytest.approx(d[np.ix_(own, own)].sum(axis=1).min(), abs=1e-9)
        assert got[k].silhouette == pytest.approx(np.mean(brute_silhouette(d, label.tolist())), abs=1e-9)
        assert got[k].inertia == pytest.approx(d[:, held].min(axis=1).sum(), abs=1e-9)
