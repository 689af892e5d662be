"""Backtests: evaluation of given weights, walk-forward fitting, scenario grids and selection.

A scenario is a partition key: all scenarios run in one job. Fitting is a Python callable on the rows before a
rebalance date. A window gathers these rows into an array of the date's own row, so fits of different dates know
nothing of each other and spread over tasks, however few scenarios there are. What one rebalance hands to the next
(trade filters, costs of moving) is a walk over one small row for each date. Realising, costs, caps and metrics are
column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.functions import linalg as L
from marlstone.operators import panel, risk

Fit = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Config:
    """A backtest's settings; what is out of range raises."""

    window: int = 156
    rebalance_every: int = 4
    max_exposure: float = risk.MAX_EXPOSURE
    max_var: float = risk.MAX_VAR
    confidence: float = risk.CONFIDENCE
    horizon: int = risk.HORIZON
    cost_bps: float = risk.COST_BPS
    roll_bps: float = 0.0
    roll_every: int = 13
    roll_offset: int = 0
    var_rows: int = 52
    clip: tuple[float, float] | None = None
    scaling: str = "none"
    threshold_l1: float = 0.0
    min_trade: float = 0.0

    def __post_init__(self) -> None:
        wrong = [
            n
            for n, bad in {
                "window": self.window < 2,
                "rebalance_every": self.rebalance_every < 1,
                "max_exposure": self.max_exposure <= 0,
                "max_var": self.max_var <= 0,
                "confidence": not 0 < self.confidence < 0.5,
                "horizon": self.horizon < 1,
                "cost_bps": self.cost_bps < 0,
                "roll_bps": self.roll_bps < 0,
                "roll_every": self.roll_every < 1,
                "var_rows": self.var_rows < 2,
                "clip": self.clip is not None and not 0 <= self.clip[0] < self.clip[1] <= 1,
                "scaling": self.scaling not in ("none", "scale_only", "zscore"),
                "threshold_l1": self.threshold_l1 < 0,
                "min_trade": self.min_trade < 0,
            }.items()
            if bad
        ]
        if wrong:
            raise ValueError("out of range: " + ", ".join(wrong))


def evaluate_weights(rows: DataFrame, weights: DataFrame, names: list[str], cost_bps: float = risk.COST_BPS, by: str = "scenario", target: str = "y", var_rows: int = 52, roll_bps: float = 0.0, roll_every: int = 13, roll_offset: int = 0, cost: risk.CostModel | None = None) -> DataFrame:
    """Weekly results of given weights: rows hold returns under `names`, weights the weights under w_<name>.

    Sparse weights are held until the next; rows before the first are left out. A row on which the held weights
    change trades, the first from zero. No cap is applied. The value at risk of a row is that of the row's weights
    over the last var_rows rows: the root of w'Cw with windowed covariances C, no Python needed. With roll_bps every
    roll_every-th row also pays for rolling the whole exposure. Another cost model takes the place of these two.
    """
    w = [f"w_{n}" for n in names]
    held = panel.as_of(rows.select(by, "date"), weights, [by], w).na.drop(subset=w)
    every = windowed_covariances(rows, names, by, var_rows).join(held, [by, "date"])
    along = Window.partitionBy(by).orderBy("date")
    turnover = E.total(F.abs(F.col(c) - F.coalesce(F.lag(c).over(along), F.lit(0.0))) for c in w)
    own = every.withColumns({"gross": E.total(F.col(n) * F.col(f"w_{n}") for n in names), "ge": E.total(F.abs(c) for c in w), "turnover": turnover})
    own = own.withColumn("rebalanced", F.col("turnover") > 1e-12).withColumn("turnover", F.when(F.col("rebalanced"), F.col("turnover")).otherwise(0.0))
    rolls = (F.row_number().over(along) - 1 - roll_offset) % roll_every == 0
    charged = cost or risk.proportional(cost_bps, roll_bps)
    own = own.withColumn("tc", charged(F.col("turnover"), F.col("ge"), rolls))
    variance = E.total(F.col(f"w_{a}") * F.col(f"w_{b}") * F.col(cov_name(a, b)) * (1 if a == b else 2) for i, a in enumerate(names) for b in names[i:])
    factor = -E.normal_quantile(risk.CONFIDENCE) * risk.HORIZON**0.5
    var = F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)) * factor
    return own.select(by, "date", "gross", (F.col("gross") - F.col("tc")).alias("net"), F.col(target).alias("target"), "ge", var.alias("var"), "turnover", "tc", "rebalanced", *w)


def cov_name(a: str, b: str) -> str:
    """Column of the covariance of a and b, a not after b."""
    return f"cov_{a}_{b}"


def windowed_covariances(rows: DataFrame, names: list[str], by: str, k: int) -> DataFrame:
    """Adds the sample covariances of all pairs over the k rows before the row; NULL until there are as many."""
    own = panel.windowed_moments(rows, names, k, by)
    sums = [panel.product_name(a, b) for i, a in enumerate(names) for b in names[i:]] + [f"sum_{n}" for n in names]

    def cov(a: str, b: str) -> Column:
        return (F.col(panel.product_name(a, b)) - F.col(f"sum_{a}") * F.col(f"sum_{b}") / k) / (k - 1)

    return own.withColumns({cov_name(a, b): cov(a, b) for i, a in enumerate(names) for b in names[i:]}).drop(*sums)


def rolling_ridge(rows: DataFrame, names: list[str], k: int, alpha: float, by: str = "scenario", target: str = "y", scaled: bool = True, inverted: bool = False) -> DataFrame:
    """Adds ridge, the array of coefficients without intercept fitted on the k rows before the row; NULL until there are k.

    scaled brings each column to [0, 1] over its window before the fit and the coefficients back to raw units after it
    (a column without range counts as of range 1); inverted multiplies them by the ranges instead. All fits come from windowed moments: X'X of the scaled columns is
    that of the raw ones less the terms of the least values, and Cholesky runs as array expressions. No row is
    gathered, no Python runs.
    """
    n, before = len(names), panel.Roll(by).before(k)
    own = panel.windowed_moments(rows, [*names, target], k, by)
    drop = [c for c in own.columns if c not in rows.columns]
    ends = {f"low_{c}": F.min(c).over(before) for c in names} | {f"high_{c}": F.max(c).over(before) for c in names} if scaled else {}
    own = own.withColumns(ends)

    def span(c: str) -> Column:
        gap = F.col(f"high_{c}") - F.col(f"low_{c}")
        return F.when(gap > 0, gap).otherwise(1.0)

    def entry(i: int, j: int) -> Column:
        a, b = names[i], names[j]
        value = F.col(panel.product_name(a, b))
        if scaled:
            la, lb = F.col(f"low_{a}"), F.col(f"low_{b}")
            value = (value - la * F.col(f"sum_{b}") - lb * F.col(f"sum_{a}") + k * la * lb) / (span(a) * span(b))
        return value + alpha if i == j else value

    def side(c: str) -> Column:
        value = F.col(panel.product_name(c, target))
        return (value - F.col(f"low_{c}") * F.col(f"sum_{target}")) / span(c) if scaled else value

    own = own.withColumns({"gram": L.symmetric(entry, n), "side": F.array(*map(side, names)), "spans": F.array(*(span(c) if scaled else F.lit(1.0) for c in names))})
    fitted = F.when(F.col(f"sum_{target}").isNotNull(), L.solved(F.col("gram"), F.col("side"), n))
    return own.withColumn("ridge", F.zip_with(fitted, "spans", lambda w, s: w * s if inverted else w / s)).drop(*drop, *ends, "gram", "side", "spans")


def restrict(weekly: DataFrame, start: str, end: str, by: str = "scenario") -> DataFrame:
    """The weeks between two dates, both in, with the cumulative cost counted from the first of them."""
    own = weekly.where(F.col("date").between(start, end))
    return own.withColumn("cumulative_tc", panel.Roll(by).running_sum("tc"))


def ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares without an intercept."""
    return np.linalg.lstsq(x, y, rcond=None)[0]


def ridge(alpha: float) -> Fit:
    """Ridge without an intercept: alpha is added to the diagonal of X'X."""
    return lambda x, y: np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def huber(delta: float = 1.35, steps: int = 50) -> Fit:
    """Huber regression by reweighted least squares, the scale from the median absolute deviation."""

    def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = ols(x, y)
        for _ in range(steps):
            e = y - x @ w
            s = max(1.4826 * np.median(np.abs(e - np.median(e))), 1e-12)
            k = np.sqrt(np.minimum(1.0, delta * s / np.maximum(np.abs(e), 1e-15)))
            new = ols(x * k[:, None], y * k)
            if np.abs(new - w).max() < 1e-10:
                break
            w = new
        return w

    return fit


def elastic_net(alpha: float, l1_ratio: float, steps: int = 1000) -> Fit:
    """Elastic net without an intercept by coordinate descent on the mean squared error over two."""

    def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, d = x.shape
        gram, xy = x.T @ x / n, x.T @ y / n
        # without the absolute penalty this is the optimum; with it, a start close to it
        w = np.linalg.solve(gram + (alpha * (1 - l1_ratio) + 1e-15) * np.eye(d), xy)
        if alpha * l1_ratio == 0:
            return w
        rest, diagonal = xy - gram @ w, np.diag(gram).tolist()
        for _ in range(steps):
            most = 0.0
            for j in range(d):
                old = float(w[j])
                r = float(rest[j]) + diagonal[j] * old
                new = math.copysign(max(abs(r) - alpha * l1_ratio, 0.0), r) / (diagonal[j] + alpha * (1 - l1_ratio) + 1e-15)
                if new != old:
                    w[j] = new
                    rest -= gram[j] * (new - old)
                    most = max(most, abs(new - old))
            if most < 1e-10:
                break
        return w

    return fit


def minmax_elastic_net(alpha: float, l1_ratio: float, inverted: bool = True) -> Fit:
    """Elastic net on columns and target brought to [0, 1].

    inverted multiplies the coefficients by the ranges of the columns, as the constraint track does; without, they
    are brought back to raw units.
    """

    def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        span = np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1.0)
        height = np.ptp(y) or 1.0
        w = elastic_net(alpha, l1_ratio)((x - x.min(axis=0)) / span, (y - y.min()) / height)
        return w * span if inverted else w * height / span

    return fit


def standardised(fit: Fit, mode: str) -> Fit:
    """Fits on scaled columns and target (population deviation, 0 counts as 1) and scales the coefficients back."""
    if mode == "none":
        return fit

    def own(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sx, sy = x.std(axis=0), y.std()
        sx, sy = np.where(sx > 0, sx, 1.0), sy or 1.0
        if mode == "zscore":
            x, y = x - x.mean(axis=0), y - y.mean()
        return fit(x / sx, y / sy) * sy / sx

    return own


def clipped(x: np.ndarray, y: np.ndarray, q: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Training rows brought to the quantiles of each column."""
    if q is None:
        return x, y
    return np.clip(x, *np.quantile(x, q, axis=0)), np.clip(y, *np.quantile(y, q))


def recent_covariance(x: np.ndarray, config: Config) -> np.ndarray:
    """Sample covariance of the last var_rows rows; zero for a single one."""
    recent = x[-config.var_rows :]
    return np.atleast_2d(np.cov(recent.T)) if len(recent) > 1 else np.zeros((x.shape[1], x.shape[1]))


def capped_by(w: np.ndarray, cov: np.ndarray, config: Config) -> np.ndarray:
    """Gross exposure brought to its cap, then the Gaussian value at risk under a covariance."""
    gross = np.abs(w).sum()
    if gross > config.max_exposure:
        w = w * config.max_exposure / gross
    var = -E.normal_quantile(config.confidence) * math.sqrt(max(float(w @ cov @ w), 0.0) * config.horizon)
    return w * config.max_var / var if var > config.max_var else w


def apply_caps(w: np.ndarray, x: np.ndarray, config: Config) -> np.ndarray:
    """Gross exposure brought to its cap, then the Gaussian value at risk over the last rows."""
    return capped_by(w, recent_covariance(x, config), config)


def iterative_var_scale(w: np.ndarray, x: np.ndarray, max_var: float, step: float = 0.01, least: float = 0.0, confidence: float = risk.CONFIDENCE, horizon: int = risk.HORIZON) -> tuple[float, float]:
    """Largest of the scalings 1, 1 - step, ... down to `least` whose historical value at risk passes the cap, else the
    last of them; and its risk.

    Compounding makes the risk no multiple of the scaling, so the scalings are tried in turn, counted in whole steps.
    """
    returns, scale, var = x @ w, 1.0, np.nan
    for i in range(math.floor((1 - least) / step + 1e-9) + 1):
        scale = max(1 - i * step, least)
        path = np.cumprod(np.concatenate(([1.0], 1 + returns * scale)))
        moves = path[horizon:] / path[:-horizon] - 1
        var = -np.quantile(moves, confidence) if len(moves) else np.nan
        if not var > max_var:
            break
    return scale, var


def training_windows(rows: DataFrame, names: list[str], config: Config, by: str = "scenario", target: str = "y") -> DataFrame:
    """by, date, past: each rebalance date with the `window` rows before it, as arrays of the returns and the target.

    Rows from position `window` on are evaluated; every rebalance_every-th of them rebalances.
    """
    along = Window.partitionBy(by).orderBy("date")
    at = F.row_number().over(along) - 1 - config.window
    past = F.collect_list(F.array(*(F.col(c).cast("double") for c in [*names, target]))).over(along.rowsBetween(-config.window, -1))
    dated = rows.select(by, F.col("date"), at.alias("at"), past.alias("past")).where((F.col("at") >= 0) & (F.col("at") % config.rebalance_every == 0))
    return dated.select(by, "date", "past").repartition(by, "date")


Pass = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def fitted_by_date(windows: DataFrame, fit: Pass, columns: list[str], by: str = "scenario") -> DataFrame:
    """by, date and array columns: what `fit` makes of each date's rows, every date by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            made = []
            for past in own["past"]:
                z = np.array([np.asarray(r, dtype=float) for r in past])
                made.append(fit(z[:, :-1], z[:, -1]))
            yield pd.DataFrame({by: own[by], "date": own["date"]} | {c: [np.ravel(m[c]).tolist() for m in made] for c in columns})

    return windows.mapInPandas(run, f"{by} string, date date, " + ", ".join(f"{c} array<double>" for c in columns))


Walk = Callable[[np.ndarray, pd.Series], np.ndarray]


def walked(fits: DataFrame, walk: Walk, names: list[str], by: str = "scenario") -> DataFrame:
    """by, date, w_<name>: weights in the order of dates, each from the weights before it and the date's own fit."""
    w = [f"w_{n}" for n in names]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        out, current = [], np.zeros(len(names))
        for row in own.sort_values("date").itertuples(index=False):
            current = walk(current, row)
            out.append((getattr(row, by), row.date, *current))
        return pd.DataFrame(out, columns=[by, "date", *w])

    return fits.groupBy(by).applyInPandas(run, f"{by} string, date date, " + ", ".join(f"{c} double" for c in w))


def walk_forward(rows: DataFrame, names: list[str], fit: Fit, config: Config, by: str = "scenario", target: str = "y") -> DataFrame:
    """by, date, w_<name>: the weights of each rebalance date, fitted on the window of rows before it only.

    Dates are fitted side by side. Only trade filters make a rebalance depend on the one before; with them, a walk
    over the dates' weights and covariances follows.
    """

    def one(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cov = recent_covariance(x, config)
        new = standardised(fit, config.scaling)(*clipped(x, y, config.clip))
        return {"w": capped_by(capped_by(new, cov, config), cov, config), "cov": cov}

    fits = fitted_by_date(training_windows(rows, names, config, by, target), one, ["w", "cov"], by)
    if not (config.threshold_l1 or config.min_trade):
        return fits.select(by, "date", *(F.col("w")[i].alias(f"w_{n}") for i, n in enumerate(names)))

    def filtered(current: np.ndarray, row) -> np.ndarray:
        new = np.asarray(row.w, dtype=float)
        change = new - current
        if config.threshold_l1 and np.abs(change).sum() < config.threshold_l1:
            new = current
        elif config.min_trade:
            new = np.where(np.abs(change) < config.min_trade, current, new)
        return capped_by(new, np.asarray(row.cov, dtype=float).reshape(len(names), -1), config)

    return walked(fits, filtered, names, by)


def scenario_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """scenario (S001, ...) and a column for each axis: the Cartesian product in the order of the axes."""
    names = list(axes)
    rows = [(f"S{i:03d}", *values) for i, values in enumerate(product(*axes.values()), 1)]
    return spark.createDataFrame(rows, ["scenario", *names])


def scenario_search(rows: DataFrame, grid: DataFrame, names: list[str], target: str = "y") -> DataFrame:
    """Weekly results of every scenario of a grid, in one job; a scenario that fails gives a row with its error.

    Grid columns: scenario, window, alpha, l1_ratio, rebalance_every, max_exposure, max_var. The panel is joined with
    the grid, so each scenario's group holds the panel once.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("date")
        c = own.iloc[0]
        try:
            fit = minmax_elastic_net(float(c.alpha), float(c.l1_ratio))
            x, y = own[names].to_numpy(float), own[target].to_numpy(float)
            w, out, since = np.zeros(len(names)), [], int(c.rebalance_every)
            for t in range(int(c.window), len(own) - 1):
                turnover = 0.0
                past = slice(t - int(c.window), t)
                if since >= int(c.rebalance_every):
                    new = fit(x[past], y[past])
                    gross = np.abs(new).sum()
                    new = new * c.max_exposure / gross if gross > c.max_exposure else new
                    scale, var = iterative_var_scale(new, x[past], float(c.max_var), step=0.005)
                    turnover, w, since = float(np.abs(new * scale - w).sum()), new * scale, 0
                since += 1
                out.append((c.scenario, own["date"].iloc[t], float(x[t] @ w), float(y[t]), float(np.abs(w).sum()), float(var), turnover, None))
        except (np.linalg.LinAlgError, ValueError) as e:
            out = [(c.scenario, None, None, None, None, None, None, str(e))]
        return pd.DataFrame(out, columns=["scenario", "date", "gross", "target", "ge", "var", "turnover", "error"])

    schema = "scenario string, date date, gross double, target double, ge double, var double, turnover double, error string"
    joined = rows.drop("scenario").crossJoin(F.broadcast(grid))  # a row for each scenario
    return joined.groupBy("scenario").applyInPandas(run, schema)


def select_scenarios(metrics: DataFrame) -> DataFrame:
    """Adds a composite z-score over scenarios and its rank: returns and correlation up, error, turnover and drawdown down."""
    whole = Window.partitionBy()
    signs = {"ir": 1, "net_ir": 1, "rho": 1, "te": -1, "turnover": -1, "mdd": -1}
    z = [s * (F.col(c) - F.avg(c).over(whole)) / (F.stddev_samp(c).over(whole) + 1e-12) for c, s in signs.items()]
    own = metrics.withColumn("composite", E.total(z) / len(signs))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "scenario")))  # a row for each scenario


def winners(metrics: DataFrame) -> DataFrame:
    """The best scenario by each metric, the first on ties."""
    best = {"ir": F.desc, "net_ir": F.desc, "rho": F.desc, "te": F.asc, "turnover": F.asc, "mdd": F.asc}
    out = None
    for c, order in best.items():
        row = metrics.where(F.col(c).isNotNull()).orderBy(order(c), "scenario").limit(1).select(F.lit(c).alias("metric"), "scenario", F.col(c).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def shrunk_covariance(x: np.ndarray, ledoit_wolf: bool = True) -> np.ndarray:
    """Covariance, shrunk towards a multiple of the identity by the published estimate, with its eigenvalues floored."""
    n, d = x.shape
    z = x - x.mean(axis=0)
    if ledoit_wolf:
        s = z.T @ z / n
        mu = np.trace(s) / d
        spread = ((s - mu * np.eye(d)) ** 2).sum()
        noise = min(spread, sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2)
        share = noise / spread if spread else 1.0
        s = share * mu * np.eye(d) + (1 - share) * s
    else:
        s = z.T @ z / (n - 1)
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    return vectors @ np.diag(np.maximum(values, 1e-10)) @ vectors.T


def optimise(mu: np.ndarray, cov: np.ndarray, before: np.ndarray, risk_aversion: float = 2.0, cost: float = 5e-4, max_exposure: float = 2.0, cap: float = 0.5, long_only: bool = False, steps: int = 2000) -> np.ndarray:
    """Weights that maximise mu'w - risk w'Cw / 2 - cost |w - before| under gross, single and sign limits, by ADMM.

    The smooth part is solved exactly in each step; the cost is a soft threshold; the limits are a projection.
    """
    d = len(mu)
    rho = max(float(np.trace(cov)) / d * risk_aversion, 1e-6)
    solve = np.linalg.inv(risk_aversion * cov + 2 * rho * np.eye(d))
    z, v, a, b = before.copy(), before.copy(), np.zeros(d), np.zeros(d)
    for _ in range(steps):
        w = solve @ (mu + rho * (z - a) + rho * (v - b))
        gap = w + a - before
        z_new = before + np.sign(gap) * np.maximum(np.abs(gap) - cost / rho, 0)
        v_new = _limited(w + b, max_exposure, cap, long_only)
        a, b = a + w - z_new, b + w - v_new
        done = max(np.abs(w - z_new).max(), np.abs(w - v_new).max(), np.abs(z - z_new).max(), np.abs(v - v_new).max()) < 1e-9
        z, v = z_new, v_new
        if done:
            break
    return v


def _limited(w: np.ndarray, max_exposure: float, cap: float, long_only: bool) -> np.ndarray:
    """Projection on a box and a ball of absolute sums: the soft threshold that meets the sum, found by halving."""
    w = np.maximum(w, 0) if long_only else w
    size = np.abs(w)
    if np.minimum(size, cap).sum() > max_exposure:
        low, high = 0.0, float(size.max())
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(size - mid, 0, cap).sum() > max_exposure else (low, mid)
        size = size - high
    return np.sign(w) * np.clip(size, 0, cap)


@dataclass(frozen=True)
class OptimiserConfig:
    """Settings of predict_then_optimise beside the backtest's own; what is out of range raises."""

    top_k: int = 5
    risk_aversion: float = 2.0
    cap: float = 0.5
    long_only: bool = False
    ledoit_wolf: bool = True

    def __post_init__(self) -> None:
        if self.top_k < 1 or self.risk_aversion <= 0 or self.cap <= 0:
            raise ValueError("top_k, risk_aversion and cap must be above 0")


def predict_then_optimise(rows: DataFrame, names: list[str], fit: Fit, config: Config, optimiser: OptimiserConfig = OptimiserConfig(), by: str = "scenario", target: str = "y") -> DataFrame:
    """Rebalance weights from a fit on the columns most correlated with the target, then a cost-aware optimisation.

    Choice of columns, fit and shrunk covariance are each date's own and run side by side; the optimum depends on the
    weights before it, so it follows in a walk.
    """
    d = len(names)

    def one(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        close = np.array([abs(np.corrcoef(x[:, j], y)[0, 1]) if x[:, j].std() else 0.0 for j in range(d)])
        active = np.sort(np.argsort(-close, kind="stable")[: optimiser.top_k])
        cov = shrunk_covariance(x[:, active], optimiser.ledoit_wolf) * risk.ANNUAL
        return {"active": active.astype(float), "alpha": fit(x[:, active], y), "cov": cov}

    def best(current: np.ndarray, row) -> np.ndarray:
        active = np.asarray(row.active, dtype=int)
        cov, alpha = np.asarray(row.cov, dtype=float).reshape(len(active), -1), np.asarray(row.alpha, dtype=float)
        # with slack limits and no cost the optimum is the fit itself
        wanted = optimiser.risk_aversion * cov @ alpha
        part = optimise(wanted, cov, current[active], optimiser.risk_aversion, config.cost_bps / 1e4, config.max_exposure, optimiser.cap, optimiser.long_only)
        new = np.zeros(d)
        new[active] = part
        return new

    fits = fitted_by_date(training_windows(rows, names, config, by, target), one, ["active", "alpha", "cov"], by)
    return walked(fits, best, names, by)


def config_map(config: Config) -> Column:
    """A configuration as a map of strings, for results that carry it."""
    return F.create_map(*(F.lit(str(v)) for f in fields(config) for v in (f.name, getattr(config, f.name))))
