"""Fitted models beyond linear ones: a vote of classifiers, and a small network fitted walk-forward."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import backtest, panel, risk
from marlstone.sources import tables


def vote(train: DataFrame, rows: DataFrame, label: str, columns: list[str], seed: int = 42) -> DataFrame:
    """Adds score: the mean probability of class 1 over a forest, boosted trees, a logistic and a naive Bayes model.

    The scaled training rows are written once, dealt over all tasks: every fit passes over them many times.
    """
    assemble = VectorAssembler(inputCols=columns, outputCol="raw_features", handleInvalid="skip")
    scale = MinMaxScaler(inputCol="raw_features", outputCol="features").fit(assemble.transform(train))
    fit_on, own = tables.spread(scale.transform(assemble.transform(train)).select(label, "features"), "train"), scale.transform(assemble.transform(rows))
    models = [
        RandomForestClassifier(labelCol=label, numTrees=30, maxDepth=6, seed=seed),
        GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=seed),
        LogisticRegression(labelCol=label, regParam=0.01),
        NaiveBayes(labelCol=label, modelType="gaussian"),
    ]
    for i, m in enumerate(models):
        own = m.fit(fit_on).transform(own).withColumn(f"p{i}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    return own.withColumn("score", E.total(F.col(f"p{i}") for i in range(len(models))) / len(models)).drop("features", "raw_features", *(f"p{i}" for i in range(len(models))))


class _Net:
    """Two layers from features to weights; the loss is the mean squared active return and the weights' turnover."""

    def __init__(self, d: int, out: int, hidden: int, rng: np.random.Generator):
        self.p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.01, (hidden, out)), np.full(out, 1 / out)]
        self.m = [np.zeros_like(x) for x in self.p]
        self.v = [np.zeros_like(x) for x in self.p]
        self.t = 0

    def weights(self, phi: np.ndarray) -> np.ndarray:
        return np.maximum(phi @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def step(self, phi: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float, turnover: float) -> None:
        h = np.maximum(phi @ self.p[0] + self.p[1], 0)
        w = h @ self.p[2] + self.p[3]
        dw = 2 * ((w * x).sum(axis=1) - y)[:, None] * x / len(y)
        move = np.sign(np.diff(w, axis=0)) * turnover / len(y)
        dw[1:] += move
        dw[:-1] -= move
        dh = dw @ self.p[2].T * (h > 0)
        grads = [phi.T @ dh, dh.sum(axis=0), h.T @ dw, dw.sum(axis=0)]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def network_features(rows: DataFrame, names: list[str], regime: list[str], by: str = "scenario", target: str = "y", returns: tuple[int, ...] = (4, 12, 52), spreads: tuple[int, ...] = (12, 52), window: int = 52, alpha: float = 1e-3) -> tuple[DataFrame, list[str]]:
    """The rows with what may be known before each, and the names of these features; rows that lack one are left out.

    Compounded returns and annualised deviations of every instrument, the regime (compounded returns of other series
    and the target's deviation over twelve rows), and the coefficients of a ridge on the rows before as a warm start;
    all one row old.
    """
    roll, annual = panel.Roll(by), risk.ANNUAL**0.5
    made = {f"ret_{k}w_{n}": roll.compound(n, k) for k in returns for n in names}
    made |= {f"vol_{k}w_{n}": roll.std(n, k) * annual for k in spreads for n in names}
    made |= {f"regime_{n}_12w": roll.compound(n, 12) for n in regime} | {"regime_target_vol_12w": roll.std(target, 12) * annual}
    fitted = backtest.rolling_ridge(rows, names, window, alpha, by, target, inverted=True)
    warm = {f"warm_{n}": F.get("ridge", F.lit(i)) for i, n in enumerate(names)}
    known = fitted.withColumns(made | warm)
    lagged = {c: F.lag(c).over(roll.base) for c in (*made, *warm)}
    return known.select(by, "date", *names, target, *(e.alias(c) for c, e in lagged.items())).na.drop(), list(lagged)


def network_backtest(rows: DataFrame, features: list[str], names: list[str], by: str = "scenario", target: str = "y", window: int = 104, every: int = 4, members: int = 3, hidden: int = 16, epochs: int = 60, turnover: float = 1e-5, block: int = 12) -> DataFrame:
    """by, date, w_<name>: the mean weights of an ensemble of networks, fitted on the rows before each date.

    Every rebalance date gets the window of rows before it as an array. Members are keys and so are blocks of `block`
    dates: a member starts afresh at the first date of a block and goes on from its last fit inside it, so members x
    blocks tasks run side by side and no task holds more than a block's windows. Features must be known before their
    row (lagged); they are standardised on the fitting rows only.
    """
    w_names, d, m = [f"w_{n}" for n in names], len(features), len(names)
    along = Window.partitionBy(by).orderBy("date")
    place = F.row_number().over(along) - 1 - window
    numbers = F.array(*(F.col(c).cast("double") for c in [*features, *names, target]))
    dated = rows.select(by, "date", place.alias("place"), numbers.alias("own"), F.collect_list(numbers).over(along.rowsBetween(-window, -1)).alias("past"))
    dated = dated.where((F.col("place") >= 0) & (F.col("place") % every == 0)).withColumn("block", F.floor(F.col("place") / (every * block)))
    keyed = dated.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        net, out = _Net(d, m, hidden, np.random.default_rng(42 + int(own["member"].iloc[0]))), []
        for i, r in enumerate(own.sort_values("date").itertuples(index=False)):
            past, now = np.array([np.asarray(x, dtype=float) for x in r.past]), np.asarray(r.own, dtype=float)
            mean, sd = past[:, :d].mean(axis=0), past[:, :d].std(axis=0)
            sd = np.where(sd < 1e-8, 1.0, sd)
            for _ in range(epochs // 4 if i else epochs):
                net.step((past[:, :d] - mean) / sd, past[:, d : d + m], past[:, -1], 0.005, turnover)
            out.append((getattr(r, by), r.date, *net.weights((now[:d] - mean) / sd)))
        return pd.DataFrame(out, columns=[by, "date", *w_names])

    each = keyed.groupBy(by, "member", "block").applyInPandas(run, f"{by} string, date date, " + ", ".join(f"{c} double" for c in w_names))
    return each.groupBy(by, "date").agg(*(F.avg(c).alias(c) for c in w_names))


#: Makes an estimator with columns `features` and the label's name.
Base = Callable[[str], Estimator]


def _chance(model, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def out_of_fold(rows: DataFrame, label: str, key: str, bases: dict[str, Base], folds: int = 5) -> DataFrame:
    """Adds, for each base model, the probability of class 1 from a model that has not seen the row's fold.

    Folds follow from a hash of the key, so a key's rows are in one fold and reruns agree. rows: a written frame with
    `features`.
    """
    dealt = rows.withColumn("fold", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)).cast("int"))
    out = None
    for f in range(folds):
        seen, own = dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f)
        for name, base in bases.items():
            own = _chance(base(label).fit(seen), own, name)
        out = own if out is None else out.unionByName(own)
    return out


def fbeta_at(rows: DataFrame, label: str, score: str, threshold: float = 0.5, beta: float = 0.5) -> float:
    """F-beta of the rows whose score reaches a threshold; 0 where nothing is right."""
    said, pos = F.col(score) >= threshold, F.col(label) == 1
    one = rows.agg(F.count_if(said & pos).alias("tp"), F.count_if(said).alias("said"), F.count_if(pos).alias("pos")).first()
    return (1 + beta**2) * one.tp / (one.said + beta**2 * one.pos) if one.tp else 0.0


def stacked(train: DataFrame, rows: DataFrame, label: str, key: str, columns: list[str], bases: dict[str, Base], search: dict[str, Base], folds: int = 5) -> tuple[DataFrame, dict[str, float]]:
    """The rows with a score from a second-level model, and the cross-validated F0.5 of every setting searched.

    The setting of the best F0.5 over held-out folds joins the base models. The second-level logistic regression is fitted on
    their out-of-fold probabilities only; base models fitted on all training rows then score the rows.
    """
    assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    fit_on = tables.kept(assemble.transform(train), "train")
    first = tables.kept(out_of_fold(fit_on, label, key, bases | search, folds), "folds")
    found = {name: fbeta_at(first, label, name) for name in search}
    best = max(found, key=lambda n: (found[n], n)) if found else None
    chosen = bases | ({best: search[best]} if best else {})
    second = VectorAssembler(inputCols=list(chosen), outputCol="chances")
    meta = LogisticRegression(featuresCol="chances", labelCol=label, regParam=0.01).fit(second.transform(first.drop("features")))
    own = assemble.transform(rows)
    for name, base in chosen.items():
        own = _chance(base(label).fit(fit_on), own, name)
    return _chance(meta, second.transform(own.drop("features")), "score").drop("chances"), found
