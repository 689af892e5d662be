"""Risk measures, caps, trading costs and the three sets of performance metrics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators.panel import Roll

#: Rows in a year, cost in basis points, tail probability, horizon and caps: fixed values.
ANNUAL = 52
COST_BPS = 5.0
CONFIDENCE = 0.01
HORIZON = 4
MAX_VAR = 0.20
MAX_EXPOSURE = 2.0


def gaussian_var(c: str | Column, confidence: float = CONFIDENCE, horizon: int = HORIZON) -> Column:
    """Value at risk from the sample deviation over a horizon; the mean does not count. NULL below two values."""
    return F.lit(-E.normal_quantile(confidence) * math.sqrt(horizon)) * F.stddev_samp(E.col(c))


def tracking_error(c: str | Column) -> Column:
    """Annualised sample deviation of an active return."""
    return F.stddev_samp(E.col(c)) * math.sqrt(ANNUAL)


def information_ratio(c: str | Column) -> Column:
    """Annualised mean over tracking error; 0 where that is undefined or 0."""
    return F.coalesce(E.ratio(F.avg(E.col(c)) * ANNUAL, tracking_error(c)), F.lit(0.0))


def historical_var(returns: DataFrame, by: str, value: str, confidence: float = CONFIDENCE, horizon: int = HORIZON) -> DataFrame:
    """by, hist_var: minus the quantile of compounded returns over the horizon; NULL with fewer rows than that."""
    own = returns.withColumn("h", Roll(by).compound(value, horizon))
    return own.groupBy(by).agg((-F.percentile("h", confidence)).alias("hist_var"))


def max_drawdown(returns: DataFrame, by: str, value: str) -> DataFrame:
    """by, mdd: deepest fall of wealth from its running top, the path starting at the first return."""
    roll = Roll(by)
    wealth = returns.withColumn("wealth", roll.wealth(value))
    return wealth.withColumn("fall", 1 - E.ratio("wealth", F.max("wealth").over(roll.sofar))).groupBy(by).agg(F.max("fall").alias("mdd"))


def capped(weights: Column, cap: float = MAX_EXPOSURE) -> Column:
    """Struct (w, scale): an array of weights brought down to a gross exposure."""
    gross = E.norm1(weights)
    scale = F.when(gross > cap, F.lit(cap) / gross).otherwise(1.0)
    return F.struct(E.scaled(weights, scale).alias("w"), scale.alias("scale"))


def var_scale(var: Column, cap: float = MAX_VAR) -> Column:
    """Factor that brings a value at risk, proportional to the weights, down to a cap."""
    return F.when(var > cap, F.lit(cap) / var).otherwise(1.0)


#: Cost of a row from its turnover, its gross exposure and whether it rolls.
CostModel = Callable[[Column, Column, Column], Column]


def proportional(bps: float, roll_bps: float = 0.0) -> CostModel:
    """Basis points of turnover, and of the whole exposure on rows that roll."""
    return lambda turnover, exposure, rolls: trade_cost(turnover, bps) + F.when(rolls, trade_cost(exposure, roll_bps)).otherwise(0.0)


def with_impact(bps: float, impact: float, power: float = 1.5) -> CostModel:
    """Basis points of turnover and an impact that grows faster than it."""
    return lambda turnover, exposure, rolls: trade_cost(turnover, bps) + impact * F.pow(turnover, power)


def trade_cost(traded: Column, bps: float = COST_BPS) -> Column:
    """Cost of an absolute traded amount."""
    return traded * (bps / 1e4)


def blotter(weights: DataFrame, by: str, names: list[str], bps: float = COST_BPS, order: str = "date") -> DataFrame:
    """One row per rebalance and asset: old and new weight, trade, its size and its share of the day's cost.

    weights: rebalance rows. The first trade is from zero.
    """
    along = Window.partitionBy(by).orderBy(order)
    parts = [F.struct(F.lit(n).alias("asset"), F.coalesce(F.lag(n).over(along), F.lit(0.0)).alias("old_weight"), F.col(n).alias("new_weight")) for n in names]
    rows = weights.select(by, order, F.array(*parts).alias("x")).select(by, order, F.explode("x").alias("x")).select(by, order, "x.*")
    rows = rows.withColumn("trade", F.col("new_weight") - F.col("old_weight")).withColumn("abs_trade", F.abs("trade"))
    day = F.sum("abs_trade").over(Window.partitionBy(by, order))
    cost = trade_cost(day, bps) * F.coalesce(E.ratio("abs_trade", day), F.lit(0.0))
    return rows.withColumn("execution_tc", cost)


def evaluator_metrics(weekly: DataFrame, by: str = "scenario") -> DataFrame:
    """The evaluator's metrics by scenario, from weekly rows with gross, net, target, ge, var, turnover, tc and rebalanced.

    Tracking error with n - 1; information ratio on gross returns, 0 where undefined; correlation of net returns;
    turnover a mean over all weeks.
    """
    active, net_active = F.col("gross") - F.col("target"), F.col("net") - F.col("target")
    one = weekly.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        information_ratio(active).alias("ir"),
        tracking_error(active).alias("te"),
        information_ratio(net_active).alias("net_ir"),
        tracking_error(net_active).alias("net_te"),
        E.safe_corr("net", "target").alias("rho"),
        E.safe_beta("net", "target").alias("beta"),
        F.avg("ge").alias("avg_ge"),
        F.max("ge").alias("max_ge"),
        F.avg("var").alias("avg_var"),
        F.max("var").alias("max_var"),
        F.avg("turnover").alias("turnover"),
        (F.avg("gross") * ANNUAL).alias("gross_return"),
        (F.avg("net") * ANNUAL).alias("net_return"),
        (F.avg("target") * ANNUAL).alias("target_return"),
        (F.stddev_samp("net") * math.sqrt(ANNUAL)).alias("net_vol"),
        F.coalesce(E.ratio(F.avg("net") * ANNUAL, F.stddev_samp("net") * math.sqrt(ANNUAL)), F.lit(0.0)).alias("sharpe"),
        F.avg(((F.signum("net") == F.signum("target"))).cast("double")).alias("hit_ratio"),
        (F.sum("tc") * 1e4).alias("tc_bps_total"),
        (F.sum("tc") * 1e4 * ANNUAL / F.count(F.lit(1))).alias("tc_bps_per_year"),
        F.sum(F.col("rebalanced").cast("long")).alias("n_rebalances"),
        F.count_if(F.col("ge") > MAX_EXPOSURE + 1e-10).alias("ge_breaches"),
        F.count_if(F.col("var") > MAX_VAR + 1e-10).alias("var_breaches"),
    )
    return one.join(max_drawdown(weekly, by, "net"), by)


def constraint_metrics(weekly: DataFrame, by: str = "scenario", bps: float = COST_BPS) -> DataFrame:
    """The constraint track's metrics: ratios of annual means, NULL where undefined, first trade left out of turnover."""
    active = F.col("gross") - F.col("target")
    along = Window.partitionBy(by).orderBy("date")
    rows = weekly.withColumn("later", F.when(F.row_number().over(along) > 1, F.col("turnover")))
    one = rows.groupBy(by).agg(
        (F.avg("gross") * ANNUAL).alias("rep_return"),
        (F.avg("target") * ANNUAL).alias("tgt_return"),
        tracking_error(active).alias("te"),
        E.safe_corr("gross", "target").alias("rho"),
        F.avg("ge").alias("avg_ge"),
        F.avg("var").alias("avg_var"),
        F.avg("later").alias("turnover"),
    )
    cost = F.col("turnover") * (bps / 1e4) * ANNUAL
    own = one.withColumns({"ir": E.ratio(F.col("rep_return") - F.col("tgt_return"), "te"), "net_return": F.col("rep_return") - cost})
    return own.withColumn("net_ir", E.ratio(F.col("net_return") - F.col("tgt_return"), "te")).join(max_drawdown(weekly, by, "gross"), by)


def network_metrics(weekly: DataFrame, by: str = "scenario", bps: float = COST_BPS, confidence: float = CONFIDENCE, horizon: int = HORIZON) -> DataFrame:
    """The network track's metrics: population deviations, every row's turnover charged, one value at risk."""
    active = F.col("gross") - F.col("target")
    net = active - F.col("turnover") * (bps / 1e4)
    te = F.stddev_pop(active) * math.sqrt(ANNUAL)
    return weekly.groupBy(by).agg(
        te.alias("te"),
        E.ratio(F.avg(active) * ANNUAL, te).alias("ir"),
        E.ratio(F.avg(net) * ANNUAL, F.stddev_pop(net) * math.sqrt(ANNUAL)).alias("net_ir"),
        E.safe_corr("gross", "target").alias("rho"),
        F.avg("ge").alias("avg_ge"),
        F.avg("turnover").alias("turnover"),
        (F.avg("turnover") * (bps / 1e4) * ANNUAL).alias("cost_drag"),
        (F.lit(-E.normal_quantile(confidence) * math.sqrt(horizon)) * F.stddev_pop("gross")).alias("var"),
    )


def replication_score(rho: Column, te: Column, turnover: Column, mdd: Column) -> Column:
    """rho - 2 TE - 0.5 turnover - 0.1 drawdown."""
    return rho - 2 * te - 0.5 * turnover - 0.1 * mdd


def crisis_window(weekly: DataFrame, start: str, end: str, by: str = "scenario") -> DataFrame:
    """Compounded returns, drawdowns and historical values at risk of replica and target between two dates, both in."""
    own = weekly.where(F.col("date").between(start, end))
    one = own.groupBy(by).agg((F.product(1 + F.col("gross")) - 1).alias("rep_return"), (F.product(1 + F.col("target")) - 1).alias("tgt_return"))
    for side, name in (("gross", "rep"), ("target", "tgt")):
        one = one.join(max_drawdown(own, by, side).withColumnRenamed("mdd", f"{name}_mdd"), by).join(historical_var(own, by, side).withColumnRenamed("hist_var", f"{name}_var"), by)
    return one
