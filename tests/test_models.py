"""Mixtures, prototypes, autoencoders and distances against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import autoencoder, mixture, panel, partials, prototypes, statespace, warning
from marlstone.sources import tables


def frame(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)


def test_sums_over_blocks(spark):
    x = np.arange(60.0).reshape(30, 2)
    df = frame(spark, x, ["a", "b"]).unionByName(spark.createDataFrame([(None, 1.0)], "a double, b double"))
    got = partials.summed(df, ["a", "b"], lambda z: np.append(z.sum(axis=0), len(z)), 3)
    assert got.tolist() == [x[:, 0].sum(), x[:, 1].sum(), 30]
    assert partials.summed(df.limit(0), ["a", "b"], lambda z: z.sum(axis=0), 2).tolist() == [0, 0]


def test_digamma():
    x = np.array([0.1, 1.0, 2.5, 7.0, 100.0])
    step = 1e-5
    slopes = [(math.lgamma(v + step) - math.lgamma(v - step)) / (2 * step) for v in x]
    assert mixture.digamma(x) == pytest.approx(slopes, abs=1e-7)


def test_a_mixture_step_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 1, (40, 2)) for m in (0, 6)])
    df, k, d = frame(spark, x, ["a", "b"]), 3, 2
    n, prior = mixture.prior_of(df, ["a", "b"], k)
    assert n == 80 and prior.mean == pytest.approx(x.mean(axis=0)) and prior.scale == pytest.approx(np.cov(x.T))
    r = rng.dirichlet(np.ones(k), len(x))
    weights = {tuple(row): w for row, w in zip(x, r, strict=True)}
    got = mixture.updated(prior, *mixture.statistics(df, ["a", "b"], k, lambda z: np.array([weights[tuple(row)] for row in z])))
    for j in range(k):  # the textbook's formulas, component by component
        nj = r[:, j].sum()
        mean = (r[:, [j]] * x).sum(axis=0) / nj
        s = sum(w * np.outer(v - mean, v - mean) for w, v in zip(r[:, j], x, strict=True)) / nj + 1e-6 * np.eye(d)
        scale = np.cov(x.T) + nj * s + nj / (1 + nj) * np.outer(mean - x.mean(axis=0), mean - x.mean(axis=0))
        assert got.a[j] == pytest.approx(1 + nj) and got.b[j] == pytest.approx(1 / k + r[:, j + 1 :].sum())
        assert got.mean[j] == pytest.approx((x.mean(axis=0) + nj * mean) / (1 + nj)) and got.cov[j] == pytest.approx(scale / (d + nj))
    rho = got.log_rho(x)
    for j in range(k):
        precision = np.linalg.inv(got.cov[j])
        log_det = np.log(np.linalg.det(precision / got.freedom[j])) + d * math.log(2) + sum(mixture.digamma(np.array([(got.freedom[j] - i) / 2]))[0] for i in range(d))
        stick = mixture.digamma(got.a) - mixture.digamma(got.a + got.b)
        left = sum((mixture.digamma(got.b) - mixture.digamma(got.a + got.b))[:j])
        for i in (0, 50):
            gap = x[i] - got.mean[j]
            want = stick[j] + left + 0.5 * (log_det - d / got.mean_weight[j] - d * math.log(2 * math.pi) - gap @ precision @ gap)
            assert rho[i, j] == pytest.approx(want)


def test_components_fade(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 5, 10)])
    df = frame(spark, x, ["a", "b"]).unionByName(spark.createDataFrame([(None, 1.0)], "a double, b double"))
    posterior, _ = mixture.fit(df, ["a", "b"], k=8, steps=40)
    found = mixture.personas(df, ["a", "b"], posterior).collect()
    assert len(found) == 181 and {r.persona for r in found} == {0, 1, 2, None}
    for m in (0, 5, 10):
        assert len({r.persona for r in found if r.a is not None and abs(r.a - m) < 2}) == 1
    assert posterior.weights().sum() == pytest.approx(1)


def test_prototype_gradients_equal_differences():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(30, 2)), rng.integers(0, 3, 30), rng.normal(size=(2, 3, 2))
    loss, grad = prototypes.gradients(x, y, w)
    for s in range(2):
        want = 0.0
        for row, c in zip(x, y, strict=True):
            d = ((row - w[s]) ** 2).sum(axis=1)
            bad = min(d[k] for k in range(3) if k != c)
            want += (d[c] - bad) / (d[c] + bad)
        assert loss[s] == pytest.approx(want)
        for c in range(3):
            for j in range(2):
                up, down = w.copy(), w.copy()
                up[s, c, j] += 1e-6
                down[s, c, j] -= 1e-6
                assert grad[s, c, j] == pytest.approx((prototypes.gradients(x, y, up)[0][s] - prototypes.gradients(x, y, down)[0][s]) / 2e-6, abs=1e-5)


def test_steps_of_many_starts_equal_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 60)
    x = rng.normal(size=(60, 2)) + 3 * y[:, None]
    df = spark.createDataFrame([(int(c), float(a), float(b)) for c, (a, b) in zip(y, x, strict=True)], "label int, a double, b double")
    classes, got, loss = prototypes.learn(df, "label", ["a", "b"], starts=100, steps=5)
    _, now = prototypes.starts_from(df, "label", ["a", "b"], 100)
    assert classes == [0, 1] and now[0] == pytest.approx(np.array([x[y == c].mean(axis=0) for c in (0, 1)]))
    for t in range(1, 6):
        _, grad = prototypes.gradients(x, y, now)
        grad /= len(x)
        now = now - 0.1 / np.sqrt(t) * grad / np.sqrt((grad**2).sum(axis=(1, 2), keepdims=True))
    assert got == pytest.approx(now) and loss == pytest.approx(prototypes.gradients(x, y, now)[0] / len(x))


def test_autoencoder_gradient_equals_differences():
    rng = np.random.default_rng(5)
    layers = autoencoder.started([4, 5, 2, 5, 4])
    x, mask = rng.random((6, 4)), rng.random((6, 4)) < 0.7
    _, grad = autoencoder.loss_and_gradient(layers, x * mask, x, mask)
    v = autoencoder.flat(layers)
    for i in rng.choice(len(v), 25, replace=False):
        up, down = v.copy(), v.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        ends = [autoencoder.loss_and_gradient(autoencoder.shaped(z, layers), x * mask, x, mask)[0] for z in (up, down)]
        assert grad[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def test_autoencoder_learns_held_out_cells(spark):
    rng = np.random.default_rng(6)
    base = 1 / (1 + np.exp(-(rng.normal(size=(120, 1)) @ rng.normal(size=(1, 4)))))
    held = (rng.random(base.shape) < 0.1).astype(int)
    names, marks = [f"c{i}" for i in range(4)], [f"h{i}" for i in range(4)]
    rows = [(i, *map(float, r), *map(int, h)) for i, (r, h) in enumerate(zip(base, held, strict=True))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join([f"{c} double" for c in names] + [f"{h} int" for h in marks]))
    layers, losses = autoencoder.train(df, "id", names, marks, width=2, hidden=(8,), steps=25, rate=0.05)
    assert min(losses) < 0.7 * losses[0]
    back = {r.id: r for r in autoencoder.reconstructed(df, "id", names, marks, layers).collect()}
    error = np.mean([(back[i][c] - base[i, j]) ** 2 for i in range(120) for j, c in enumerate(names) if held[i, j]])
    assert error == pytest.approx(min(losses))


def test_mahalanobis(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 3))
    df = frame(spark, x, ["a", "b", "c"]).unionByName(spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double"))
    inverse = np.linalg.inv(np.cov(x.T))
    for r in warning.mahalanobis(df, ["a", "b", "c"]).collect():
        if r.a is None:
            assert r.d2 is None
        else:
            gap = np.array([r.a, r.b, r.c]) - x.mean(axis=0)
            assert r.d2 == pytest.approx(gap @ inverse @ gap)
    flat = df.withColumn("c", F.col("a"))
    assert warning.mahalanobis(flat, ["a", "c"]).where("d2 IS NOT NULL").count() == 0


def test_windowed_moments_with_gaps(spark):
    rows = [("s", i, float(i * i % 7), None if i == 6 else float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "scenario string, date int, a double, b double")
    got = {r.date: r for r in panel.windowed_moments(df, ["a", "b"], 3, "scenario").collect()}
    for i in range(12):
        past = rows[max(0, i - 3) : i]
        whole = len(past) == 3 and all(r[3] is not None for r in past)
        assert (got[i].sum_a_b is not None) == whole
        if whole:
            assert got[i].sum_a == sum(r[2] for r in past) and got[i].sum_a_b == sum(r[2] * r[3] for r in past) and got[i].sum_b_b == sum(r[3] ** 2 for r in past)


def test_kalman_grid_names():
    settings = statespace.grid([1e-3, 1e-2], [1.0], [0.1], adaptive=True)
    assert [s.name for s in settings] == ["0.001/1/0.1", "0.01/1/0.1"] and all(s.adaptive for s in settings)


@pytest.mark.parametrize("range_rows", [50_000, 10])
def test_quantiles_by_selection(spark, monkeypatch, range_rows):
    from marlstone.operators import stats

    monkeypatch.setattr(stats, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=301), "b": np.round(rng.normal(size=200)), "one": np.array([3.0]), "hot": np.concatenate([np.zeros(150), rng.normal(size=50)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: r.q for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, shares).tolist())


def test_stacking_does_not_leak(spark):
    """A tree that learns rows by heart knows nothing of rows in other folds; the second level is fitted on such scores only."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from marlstone.operators import learn

    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 160)
    rows = [(i, int(c), float(rng.normal()), float(c + rng.normal())) for i, c in enumerate(y)]
    df = spark.createDataFrame(rows, "id long, label int, noise double, signal double").repartition(2)
    heart = {"heart": lambda label: DecisionTreeClassifier(labelCol=label, maxDepth=15, minInstancesPerNode=1, maxBins=200)}
    ready = VectorAssembler(inputCols=["noise"], outputCol="features").transform(df)
    found = learn.out_of_fold(ready, "label", "id", heart, folds=3).collect()
    assert len(found) == 160
    right = np.mean([(r.heart >= 0.5) == (r.label == 1) for r in found])
    assert 0.3 < right < 0.7
    model = heart["heart"]("label").fit(ready)
    assert np.mean([(r.prediction == r.label) for r in model.transform(ready).collect()]) > 0.9
    plain = {"plain": lambda label: LogisticRegression(labelCol=label)}
    scored, cv = learn.stacked(df.where("id < 110"), df.where("id >= 110"), "label", "id", ["noise", "signal"], plain, heart, folds=3)
    got = scored.collect()
    assert len(got) == 50 and cv.keys() == {"heart"} and 0 <= cv["heart"] <= 1
    assert np.mean([(r.score >= 0.5) == (r.label == 1) for r in got]) > 0.6


def test_equal_rows_weigh_as_many(spark):
    """Prototypes learn from a table of the different rows, over several files."""
    rng = np.random.default_rng(8)
    x, y, times = rng.normal(size=(20, 2)), rng.integers(0, 3, 20), rng.integers(1, 5, 20)
    w = rng.normal(size=(4, 3, 2))
    many = prototypes.gradients(np.repeat(x, times, axis=0), np.repeat(y, times), w)
    for a, b in zip(prototypes.gradients(x, y, w, times.astype(float)), many, strict=True):
        assert a == pytest.approx(b)
    df = tables.spread(spark.range(100).coalesce(1), "numbers", "id")
    assert df.rdd.getNumPartitions() >= 4
