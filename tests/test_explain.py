"""Dependence, Shapley values and surrogates against plain numpy."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import explain

X = np.round(np.random.default_rng(5).normal(size=(23, 3)), 3)
NAMES = ["a", "b", "c"]


def table(spark, x=X):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, (99, None, 1.0, 1.0)], "id long, a double, b double, c double").repartition(3)


def plain(x):
    return x[:, 0] * x[:, 1] + 2 * x[:, 2]


def scorer(df):
    return df.withColumn("score", F.col("a") * F.col("b") + 2 * F.col("c"))


def test_partial_dependence(spark):
    grid = {"a": [-1.0, 2.0], "c": [0.5]}
    got = {(r.name, r.place): (r["mean"], r.n) for r in explain.partial_dependence(table(spark), "id", grid, NAMES, scorer).collect()}
    want = {}
    for name, values in grid.items():
        for v in values:
            z = X.copy()
            z[:, NAMES.index(name)] = v
            want[name, v] = (pytest.approx(plain(z).mean()), len(X))
    assert got == want


def test_individual_curves(spark):
    got = explain.individual_curves(table(spark), "id", {"b": [3.0]}, NAMES, scorer).collect()
    assert {r.id: r.score for r in got} == {i: pytest.approx(x[0] * 3 + 2 * x[2]) for i, x in enumerate(X)}
    assert explain.individual_curves(table(spark), "id", {"b": []}, NAMES, scorer).columns == ["id", "name", "place", "score"]
    assert explain.individual_curves(table(spark), "id", {}, NAMES, scorer).count() == 0


def test_grid(spark):
    assert explain.spread_grid(table(spark), ["a"], 3)["a"] == pytest.approx([X[:, 0].min(), (X[:, 0].min() + X[:, 0].max()) / 2, X[:, 0].max()])
    assert explain.spread_grid(table(spark).where("id < 0"), ["a"], 3) == {"a": []}


def test_shapley_values_add_up_and_average_all_orders(spark):
    df = table(spark)
    got = {r.id: r for r in explain.shapley(df, "id", NAMES, scorer, df.where("id < 4"), orders=2).collect()}
    assert sorted(got) == list(range(len(X)))
    for i, x in enumerate(X):
        r = got[i]
        assert r.score == pytest.approx(plain(x[None])[0]) and r.base == pytest.approx(plain(X[:4]).mean())
        assert r.phi_a + r.phi_b + r.phi_c == pytest.approx(r.score - r.base)
        want = np.zeros(3)
        for b in X[:4]:
            for order in permutations(range(3)):
                z = b.copy()
                for j in order:
                    before = plain(z[None])[0]
                    z[j] = x[j]
                    want[j] += (plain(z[None])[0] - before) / 24
        # an order and its reverse are enough for a score of pairs
        assert [r.phi_a, r.phi_b, r.phi_c] == pytest.approx(want.tolist())


def test_repeated_rows_come_once(spark):
    df = table(spark)
    once = explain.shapley(df, "id", NAMES, scorer, df.where("id < 2")).orderBy("id").collect()
    twice = explain.shapley(df.unionByName(df), "id", NAMES, scorer, df.where("id < 2")).orderBy("id").collect()
    assert [list(r) for r in twice] == [pytest.approx(list(r)) for r in once]
    assert explain.shapley(df.where("id < 0"), "id", NAMES, scorer, df.where("id < 2")).count() == 0


def test_background_is_bounded(spark):
    df = table(spark)
    with pytest.raises(ValueError):
        explain.shapley(df, "id", NAMES, scorer, df.where("id < 0"))
    many = spark.range(explain.BACKGROUND + 1).select("id", *(F.col("id").cast("double").alias(c) for c in NAMES))
    with pytest.raises(ValueError):
        explain.shapley(df, "id", NAMES, scorer, many)


def test_summary(spark):
    df = table(spark)
    got = {r.name: r for r in explain.shapley_summary(explain.shapley(df, "id", NAMES, scorer, df.where("id < 4")), NAMES).collect()}
    assert got["c"].direction == pytest.approx(1.0)
    assert got["c"].mean_abs == pytest.approx(np.abs(2 * (X[:, 2] - X[:4, 2].mean())).mean())


def test_surrogate_finds_slopes(spark):
    sd = X.std(axis=0)

    def linear(df):
        return df.withColumn("score", 3 * F.col("a") - F.col("b") + 5)

    got = explain.local_surrogate(table(spark).where("id < 23"), "id", NAMES, linear, ridge=0.0).orderBy("id").collect()
    assert len(got) == len(X)
    for x, r in zip(X, got, strict=True):
        assert [r.slope_a, r.slope_b, r.slope_c] == pytest.approx([3 * sd[0], -sd[1], 0.0], abs=1e-9)
        assert r.level == pytest.approx(3 * x[0] - x[1] + 5)
    flat = table(spark).where("id < 23").withColumn("c", F.lit(1.0))
    assert all(r.slope_c == 0 and abs(r.slope_a - 3 * sd[0]) < 1e-2 for r in explain.local_surrogate(flat, "id", NAMES, linear).collect())
