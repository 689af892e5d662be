"""Portfolio weights as a hidden random walk, filtered from returns: Kalman filters as folds in the JVM.

A scenario's dates become one array, ordered, and `aggregate` folds the filter's state over it: weights, their covariance,
the weights that are held. Settings are rows of a table, and each (scenario, setting) is a row of its own, so that a
grid of filters spreads over tasks. No Python runs.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.functions import linalg as L
from marlstone.operators import backtest, panel, risk
from marlstone.sources import tables


@dataclass(frozen=True)
class Setting:
    """A filter: deviation of the walk, factor on the target's variance, first variance of the weights, share of a new
    estimate that is held at once, whether noise follows volatility, caps of exposure and of value at risk."""

    name: str = "basic"
    drift: float = 1e-3
    noise: float = 1.0
    start: float = 1.0
    damping: float = 1.0
    adaptive: bool = False
    max_exposure: float = risk.MAX_EXPOSURE
    max_var: float = 0.08


def settings_frame(spark: SparkSession, settings: list[Setting]) -> DataFrame:
    """A row for each setting."""
    kinds = {"name": "string", "adaptive": "boolean"}
    return spark.createDataFrame([astuple(s) for s in settings], ", ".join(f"{f.name} {kinds.get(f.name, 'double')}" for f in fields(Setting)))


def grid(drifts: list[float], noises: list[float], starts: list[float], **more) -> list[Setting]:
    """All combinations, named by their values."""
    return [Setting(f"{d:g}/{n:g}/{p:g}", d, n, p, **more) for d in drifts for n in noises for p in starts]


def _observations(rows: DataFrame, names: list[str], by: str, target: str, window: int, alpha: float, short: int, var_rows: int) -> DataFrame:
    """by, obs, first, variance: the dates from position `window` on, with what is known before each; and where to start.

    A date has returns x, target y, the factor by which noise follows volatility (variance of the target over the
    `short` rows before it to that over the `window` rows before it) and the covariance of returns before it.
    """
    roll, n = panel.Roll(by), len(names)
    own = backtest.rolling_ridge(rows, names, window, alpha, by, target, scaled=False)
    own = backtest.windowed_covariances(own, names, by, var_rows)
    cov = F.when(F.col(backtest.cov_name(names[0], names[0])).isNotNull(), L.symmetric(lambda i, j: F.col(backtest.cov_name(names[i], names[j])), n))
    recent, whole = F.var_samp(target).over(roll.before(short)), F.var_samp(target).over(roll.before(window))
    own = own.select(
        by, "date", (roll.position() - window).alias("at"), F.array(*names).alias("x"), F.col(target).alias("y"), "ridge", cov.alias("cov"),
        F.coalesce(E.ratio(recent, whole), F.lit(1.0)).alias("calm"), whole.alias("variance"),
    ).where("at >= 0")
    begun = F.col("at") == 0
    return own.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("date", "x", "y", "calm", "cov"))).alias("obs"),
        F.max(F.when(begun, F.col("ridge"))).alias("first"),
        F.max(F.when(begun, F.col("variance"))).alias("variance"),
    )


def _constrained(w: Column, cov: Column, cap: Column, var_cap: Column) -> Column:
    """Weights scaled down to the cap of exposure, then to that of the value at risk where a covariance is known."""
    factor = -E.normal_quantile(risk.CONFIDENCE) * risk.HORIZON**0.5
    capped = L.let(E.norm1(w), lambda g: E.scaled(w, F.when(g > cap, cap / g).otherwise(1.0)))

    def guarded(own: Column) -> Column:
        variance = L.quadratic(cov, own)
        var = factor * F.sqrt(F.when(variance < 0, 0.0).otherwise(variance))
        return L.let(var, lambda v: E.scaled(own, F.when(v > var_cap, var_cap / v).otherwise(1.0)))

    return L.let(capped, guarded)


def kalman(rows: DataFrame, names: list[str], settings: list[Setting], by: str = "scenario", target: str = "y", window: int = 52, alpha: float = 1e-3, short: int = 12, var_rows: int = 52) -> DataFrame:
    """by, setting, date, w_<name>: held weights of every filter; those of a date know only rows before it.

    A filter starts at position `window` from a ridge on the rows before, with the target's variance there times `noise` for
    the variance of an observation. An estimate is blended into the held weights by `damping`, then capped. Adaptive
    filters scale both variances by the factor of the date.
    """
    n = len(names)
    observed = _observations(rows, names, by, target, window, alpha, short, var_rows)
    own = observed.crossJoin(F.broadcast(settings_frame(rows.sparkSession, settings))).repartition(by, "name")  # a row a setting
    calm = lambda o: F.when(F.col("adaptive"), o["calm"]).otherwise(1.0)

    def filtered(acc: Column, o: Column) -> Column:
        """Struct (state, p) after the date's return is known."""

        def known(p: Column, px: Column, scale: Column) -> Column:
            error = o["y"] - E.dot(o["x"], acc["state"])
            state = F.zip_with(acc["state"], px, lambda w, g: w + g * error / scale)
            cov = F.zip_with(p, px, lambda row, g: F.zip_with(row, px, lambda v, h: v - g * h / scale))
            return F.struct(state.alias("state"), cov.alias("p"))

        noise = F.col("variance") * F.col("noise") * calm(o)
        walked = L.with_diagonal(acc["p"], F.col("drift") * F.col("drift") * calm(o))
        return L.let(walked, lambda p: L.let(L.times(p, o["x"]), lambda px: L.let(E.dot(o["x"], px) + noise, lambda scale: known(p, px, scale))))

    def step(acc: Column, o: Column) -> Column:
        def after(w: Column, s: Column) -> Column:
            out = F.concat(acc["out"], F.array(F.struct(o["date"].alias("date"), w.alias("w"))))
            return F.struct(s["state"].alias("state"), s["p"].alias("p"), L.blend(w, s["state"], F.col("damping")).alias("held"), out.alias("out"))

        final = _constrained(acc["held"], o["cov"], F.col("max_exposure"), F.col("max_var"))
        return L.let(final, lambda w: L.let(filtered(acc, o), lambda s: after(w, s)))

    first, none = F.col("first"), F.array().cast("array<struct<date:date,w:array<double>>>")
    zero = F.struct(first.alias("state"), L.diagonal(n, F.col("start")).alias("p"), first.alias("held"), none.alias("out"))
    folded = own.select(by, F.col("name").alias("setting"), F.explode(F.aggregate("obs", zero, step, lambda acc: acc["out"])).alias("h"))
    return folded.select(by, "setting", "h.date", *(F.get("h.w", F.lit(i)).alias(f"w_{c}") for i, c in enumerate(names)))


def scores(rows: DataFrame, weights: DataFrame, names: list[str], by: str = "scenario") -> DataFrame:
    """by, setting, score, rho, te, turnover, mdd, best: the replication score of every filter; best marks the greatest.

    Ties go to the setting that comes first by name.
    """
    keyed = tables.kept(weights, "weights").withColumn("run", F.concat_ws("|", by, "setting"))
    names_of = keyed.select(by, "setting", "run").distinct()
    every = rows.join(F.broadcast(names_of), by).drop(by)  # a row for each scenario and setting
    weekly = tables.kept(backtest.evaluate_weights(every, keyed.drop(by, "setting"), names, by="run"), "weekly")
    active = F.col("net") - F.col("target")
    one = weekly.groupBy("run").agg(E.safe_corr("net", "target").alias("rho"), risk.tracking_error(active).alias("te"), F.avg("turnover").alias("turnover"))
    own = one.join(risk.max_drawdown(weekly, "run", "net"), "run").join(F.broadcast(names_of), "run")
    own = own.withColumn("score", risk.replication_score(F.col("rho"), F.col("te"), F.col("turnover"), F.col("mdd")))
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "setting")
    return own.withColumn("best", F.row_number().over(order) == 1).select(by, "setting", "score", "rho", "te", "turnover", "mdd", "best")
