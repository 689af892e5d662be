"""Queries on portfolio returns: evaluation of weights, metrics, caps, costs, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import backtest, panel, risk
from marlstone.plans import frames
from marlstone.plans.registry import query

_R = E.rounded
N = frames.NAMES
W = [f"w_{n}" for n in N]


def schedule(rows: DataFrame) -> DataFrame:
    """Weights of every fourth row: equal ones, tilted in turn."""
    own = rows.withColumn("k", panel.Roll("scenario").position()).where("k % 4 = 0")
    tilt = [(F.lit(1 / 11) + 0.01 * ((F.floor(F.col("k") / 4) + a) % 3 - 1)).alias(w) for a, w in enumerate(W)]
    return own.select("scenario", "date", *tilt)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly results of the schedule."""
    rows = frames.replication(spark, sf_dir)
    return backtest.evaluate_weights(rows, schedule(rows), N)


_WS = [f"(1 / 11.0::DOUBLE + 0.01::DOUBLE * ((k // 4 + {a}) % 3 - 1))" for a in frames.ASSETS]
_VARS = " + ".join(f"w.{w} * h.{n}" for w, n in zip(W, N, strict=True))
WEEKLY = f"""{frames.REPLICATION}, rp AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS k FROM rep),
ww AS (SELECT k, date, y, {", ".join(N)}, {", ".join(f"{e} AS {w}" for e, w in zip(_WS, W, strict=True))} FROM rp),
vv AS (SELECT w.k, stddev_samp({_VARS}) * 2.3263478740408408 * 2 AS var FROM ww w JOIN rp h ON h.k BETWEEN w.k - 52 AND w.k - 1 GROUP BY w.k HAVING count(*) = 52),
wk AS (SELECT ww.*, {" + ".join(f"{n} * {w}" for n, w in zip(N, W, strict=True))} AS gross, {" + ".join(f"abs({w})" for w in W)} AS ge,
 {" + ".join(f"abs({w} - coalesce(lag({w}) OVER (ORDER BY date), 0))" for w in W)} AS turn FROM ww),
weekly AS (SELECT wk.k, date, gross, gross - CASE WHEN turn > 1e-12 THEN turn ELSE 0 END * 0.0005::DOUBLE AS net, y AS target, ge, var, CASE WHEN turn > 1e-12 THEN turn ELSE 0 END AS turnover,
 CASE WHEN turn > 1e-12 THEN turn ELSE 0 END * 0.0005::DOUBLE AS tc, turn > 1e-12 AS rebalanced FROM wk LEFT JOIN vv USING (k))"""


@query(f"WITH {WEEKLY} SELECT date, round(gross, 6) AS gross, round(net, 6) AS net, round(target, 6) AS target, round(ge, 6) AS ge, round(var, 5) AS var, round(turnover, 6) AS turnover, round(tc, 8) AS tc, rebalanced FROM weekly")
def risk_evaluate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly results of sparse weights, held between rebalances; value at risk of today's weights over past rows."""
    own = weekly(spark, sf_dir)
    return own.select("date", *(_R(c).alias(c) for c in ("gross", "net", "target", "ge")), _R("var", 5).alias("var"), _R("turnover").alias("turnover"), _R("tc", 8).alias("tc"), "rebalanced")


def _mdd(side: str) -> str:
    return f"(SELECT max(1 - w / t) FROM (SELECT w, max(w) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS t FROM (SELECT date, product(1 + {side}) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM weekly)))"


@query(
    f"""WITH {WEEKLY} SELECT CAST(count(*) AS BIGINT) AS n_weeks, round(avg(gross - target) * 52 / (stddev_samp(gross - target) * sqrt(52)), 5) AS ir, round(stddev_samp(gross - target) * sqrt(52), 5) AS te,
 round(avg(net - target) * 52 / (stddev_samp(net - target) * sqrt(52)), 5) AS net_ir, round(corr(net, target), 5) AS rho, round(regr_slope(net, target), 5) AS beta, round(avg(ge), 6) AS avg_ge, round(max(ge), 6) AS max_ge,
 round(avg(var), 5) AS avg_var, round(max(var), 5) AS max_var, round(avg(turnover), 6) AS turnover, round(avg(gross) * 52, 5) AS gross_return, round(avg(net) * 52, 5) AS net_return, round(stddev_samp(net) * sqrt(52), 5) AS net_vol,
 round(avg(net) * 52 / (stddev_samp(net) * sqrt(52)), 5) AS sharpe, round(avg(CASE WHEN sign(net) = sign(target) THEN 1.0 ELSE 0.0 END), 6) AS hit_ratio, round(sum(tc) * 10000, 4) AS tc_bps_total,
 CAST(sum(CASE WHEN rebalanced THEN 1 ELSE 0 END) AS BIGINT) AS n_rebalances, CAST(count(*) FILTER (WHERE ge > 2.0 + 1e-10) AS BIGINT) AS ge_breaches, CAST(count(*) FILTER (WHERE var > 0.2::DOUBLE + 1e-10) AS BIGINT) AS var_breaches, round({_mdd('net')}, 5) AS mdd FROM weekly"""
)
def risk_evaluator_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator's metric row."""
    own = risk.evaluator_metrics(weekly(spark, sf_dir))
    five = ["ir", "te", "net_ir", "rho", "beta", "avg_var", "max_var", "gross_return", "net_return", "net_vol", "sharpe", "mdd"]
    return own.select(
        "n_weeks", *(_R(c, 5).alias(c) for c in five), *(_R(c).alias(c) for c in ("avg_ge", "max_ge", "turnover", "hit_ratio")), _R("tc_bps_total", 4).alias("tc_bps_total"), "n_rebalances", "ge_breaches", "var_breaches"
    )


@query(
    f"""WITH {WEEKLY}, l AS (SELECT avg(turnover) FILTER (WHERE k > 0) AS t FROM weekly), m AS (SELECT avg(gross) * 52 AS rr, avg(target) * 52 AS tr, stddev_samp(gross - target) * sqrt(52) AS te, corr(gross, target) AS rho, avg(ge) AS avg_ge, avg(var) AS avg_var FROM weekly)
 SELECT round(rr, 5) AS rep_return, round(tr, 5) AS tgt_return, round(te, 5) AS te, round(rho, 5) AS rho, round(avg_ge, 6) AS avg_ge, round(avg_var, 5) AS avg_var, round(t, 6) AS turnover, round((rr - tr) / te, 5) AS ir,
 round(rr - t * 0.0005 * 52, 5) AS net_return, round((rr - t * 0.0005 * 52 - tr) / te, 5) AS net_ir, round({_mdd('gross')}, 5) AS mdd FROM m, l"""
)
def risk_constraint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constraint track's metric row."""
    own = risk.constraint_metrics(weekly(spark, sf_dir))
    return own.select(*(_R(c, 6 if c in ("avg_ge", "turnover") else 5).alias(c) for c in own.columns if c != "scenario"))


@query(
    f"""WITH {WEEKLY}, m AS (SELECT stddev_pop(gross - target) * sqrt(52) AS te, avg(gross - target) * 52 AS a, avg(gross - target - turnover * 0.0005) * 52 AS na, stddev_pop(gross - target - turnover * 0.0005) * sqrt(52) AS nte,
 corr(gross, target) AS rho, avg(ge) AS avg_ge, avg(turnover) AS turnover, stddev_pop(gross) AS sg FROM weekly)
 SELECT round(te, 5) AS te, round(a / te, 5) AS ir, round(na / nte, 5) AS net_ir, round(rho, 5) AS rho, round(avg_ge, 6) AS avg_ge, round(turnover, 6) AS turnover, round(turnover * 0.0005 * 52, 8) AS cost_drag, round(2.3263478740408408 * 2 * sg, 5) AS var FROM m"""
)
def risk_network_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network track's metric row."""
    own = risk.network_metrics(weekly(spark, sf_dir))
    return own.select(*(_R(c, {"avg_ge": 6, "turnover": 6, "cost_drag": 8}.get(c, 5)).alias(c) for c in own.columns if c != "scenario"))


@query(
    f"""WITH {frames.RETURNS}, h AS (SELECT asset, r, CASE WHEN count(r) OVER w = 4 THEN product(1 + r) OVER w - 1 END AS h FROM returns WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
 t AS (SELECT asset, date, product(1 + r) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM returns WHERE r IS NOT NULL), d AS (SELECT asset, 1 - w / max(w) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS f FROM t),
 dd AS (SELECT asset, max(f) AS mdd FROM d GROUP BY asset) SELECT asset, round(stddev_samp(r) * 2.3263478740408408 * 2, 5) AS gauss_var, round(-quantile_cont(h, 0.01), 5) AS hist_var, round(any_value(mdd), 5) AS mdd FROM h JOIN dd USING (asset) GROUP BY asset"""
)
def risk_value_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian and historical value at risk and drawdown by instrument."""
    own = frames.returns(spark, sf_dir).where("r IS NOT NULL")
    gauss = own.groupBy("asset").agg(risk.gaussian_var("r").alias("gauss_var"))
    joined = gauss.join(risk.historical_var(own, "asset", "r"), "asset").join(risk.max_drawdown(own, "asset", "r"), "asset")
    return joined.select("asset", *(_R(c, 5).alias(c) for c in ("gauss_var", "hist_var", "mdd")))


@query(
    f"""WITH {WEEKLY}, rb AS (SELECT * FROM ww WHERE k % 4 = 0), u AS ({" UNION ALL ".join(f"SELECT date, '{n}' AS asset, coalesce(lag(w_{n}) OVER (ORDER BY date), 0) AS o, w_{n} AS n FROM rb" for n in N)}),
 b AS (SELECT *, n - o AS t, abs(n - o) AS a, sum(abs(n - o)) OVER (PARTITION BY date) AS day FROM u)
 SELECT date, asset, round(o, 6) AS old_weight, round(n, 6) AS new_weight, round(t, 6) AS trade, round(a, 6) AS abs_trade, round(CASE WHEN day = 0 THEN 0 ELSE day * 0.0005 * a / day END, 8) AS execution_tc FROM b"""
)
def risk_blotter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the schedule with costs dealt by size."""
    own = risk.blotter(schedule(frames.replication(spark, sf_dir)).toDF("scenario", "date", *N), "scenario", N)
    return own.select("date", "asset", *(_R(c).alias(c) for c in ("old_weight", "new_weight", "trade", "abs_trade")), _R("execution_tc", 8).alias("execution_tc"))


@query(
    f"""WITH {frames.REPLICATION}, n AS (SELECT date, {" + ".join(f"abs({c} * 3)" for c in N)} AS g, {", ".join(N)} FROM rep)
 SELECT date, round(CASE WHEN g > 2 THEN 2 / g ELSE 1 END, 6) AS scale, round(least(g, 2.0), 6) AS ge, round(r0 * 3 * CASE WHEN g > 2 THEN 2 / g ELSE 1 END, 6) AS w0 FROM n"""
)
def risk_exposure_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights brought down to the gross exposure cap."""
    own = frames.replication(spark, sf_dir).withColumn("c", risk.capped(F.array(*(F.col(n) * 3 for n in N))))
    return own.select("date", _R("c.scale").alias("scale"), _R(E.norm1(F.col("c.w"))).alias("ge"), _R(F.get("c.w", F.lit(0))).alias("w0"))


@query(
    f"""WITH {WEEKLY}, c AS (SELECT * FROM weekly WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30')
 SELECT date, round(sum(tc) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 8) AS cumulative_tc, round(product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS net_total FROM c"""
)
def risk_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of weeks with its cost counted anew."""
    own = backtest.restrict(weekly(spark, sf_dir), "1997-01-01", "1998-06-30")
    return own.select("date", _R("cumulative_tc", 8).alias("cumulative_tc"), _R(panel.Roll("scenario").wealth("net") - 1).alias("net_total"))


@query(f"WITH {WEEKLY} SELECT round(product(1 + gross) - 1, 6) AS rep_return, round(product(1 + target) - 1, 6) AS tgt_return FROM weekly WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def risk_crisis_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounded returns of a crisis window."""
    return risk.crisis_window(weekly(spark, sf_dir), "1998-01-01", "1998-12-31").select(_R("rep_return").alias("rep_return"), _R("tgt_return").alias("tgt_return"))


@query("""WITH a(w) AS (VALUES (52), (104), (156)), b(al) AS (VALUES (0.001::DOUBLE), (0.01::DOUBLE)), c(l1) AS (VALUES (0.0::DOUBLE), (0.2::DOUBLE)) SELECT 'S' || lpad(CAST(row_number() OVER (ORDER BY w, al, l1) AS VARCHAR), 3, '0') AS scenario, CAST(w AS BIGINT) AS window, al AS alpha, l1 AS l1_ratio FROM a, b, c""")
def risk_scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled Cartesian product of settings."""
    return backtest.scenario_grid(spark, window=[52, 104, 156], alpha=[0.001, 0.01], l1_ratio=[0.0, 0.2])


@query()
def backtest_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric row of a walk-forward ridge with both caps."""
    rows = frames.replication(spark, sf_dir)
    weights = backtest.walk_forward(rows, N, backtest.ridge(0.01), backtest.Config(window=104))
    return risk.evaluator_metrics(backtest.evaluate_weights(rows, weights, N))


@query()
def backtest_trade_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a walk-forward Huber fit with clipping, scaling and no-trade filters."""
    rows = frames.replication(spark, sf_dir)
    config = backtest.Config(window=104, clip=(0.01, 0.99), scaling="scale_only", threshold_l1=0.05, min_trade=0.01)
    return backtest.walk_forward(rows, N, backtest.huber(), config)


@query()
def backtest_scenario_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of scenarios, measured, scored and ranked."""
    grid = backtest.scenario_grid(spark, window=[104, 156], alpha=[0.001, 0.01], l1_ratio=[0.0, 0.2], rebalance_every=[4], max_exposure=[1.0, 2.0], max_var=[0.08])
    results = backtest.scenario_search(frames.replication(spark, sf_dir), grid, N).where("error IS NULL")
    return backtest.select_scenarios(risk.constraint_metrics(results))


@query()
def backtest_predict_then_optimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric row of correlated instruments, shrunk covariance and a cost-aware optimum."""
    rows = frames.replication(spark, sf_dir)
    weights = backtest.predict_then_optimise(rows, N, backtest.ols, backtest.Config(window=104))
    return risk.evaluator_metrics(backtest.evaluate_weights(rows, weights, N))


@query(
    f"""WITH {frames.REPLICATION} SELECT date, CASE WHEN count(*) OVER w = 104 THEN round(covar_samp(r0, y) OVER w / var_samp(r0) OVER w, 5) END AS slope FROM rep WINDOW w AS (ORDER BY date ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING)"""
)
def backtest_rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the target on one instrument over the rows before, from windowed moments alone."""
    past = Window.partitionBy("scenario").orderBy("date").rowsBetween(-104, -1)
    slope = E.ratio(F.covar_samp("r0", "y").over(past), F.var_samp("r0").over(past))
    return frames.replication(spark, sf_dir).select("date", _R(F.when(F.count(F.lit(1)).over(past) == 104, slope), 5).alias("slope"))


_PAST = "OVER (ORDER BY date ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING)"
_RECENT = "OVER (ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)"


@query(
    f"""WITH {frames.REPLICATION}, m AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, sum(r0 * r0) {_PAST} + 0.01::DOUBLE AS a, sum(r0 * r1) {_PAST} AS b,
 sum(r1 * r1) {_PAST} + 0.01::DOUBLE AS c, sum(r0 * y) {_PAST} AS u, sum(r1 * y) {_PAST} AS v, var_samp(r0) {_RECENT} AS s0, covar_samp(r0, r1) {_RECENT} AS s01, var_samp(r1) {_RECENT} AS s1 FROM rep),
 f AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS x0, (a * v - b * u) / (a * c - b * b) AS x1 FROM m WHERE k >= 104 AND (k - 104) % 4 = 0),
 g AS (SELECT *, 2 / greatest(abs(x0) + abs(x1), 2) AS cap FROM f),
 h AS (SELECT *, 2.3263478740408408::DOUBLE * sqrt(4 * (x0 * x0 * s0 + 2 * x0 * x1 * s01 + x1 * x1 * s1)) * cap AS var FROM g)
 SELECT date, round(x0 * cap * least(1, 0.08::DOUBLE / var), 6) AS w0, round(x1 * cap * least(1, 0.08::DOUBLE / var), 6) AS w1 FROM h"""
)
def backtest_ridge_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a walk-forward ridge on two instruments with both caps, which closed forms can check."""
    config = backtest.Config(window=104, max_exposure=2.0, max_var=0.08)
    weights = backtest.walk_forward(frames.replication(spark, sf_dir), N[:2], backtest.ridge(0.01), config)
    return weights.select("date", _R("w_r0").alias("w0"), _R("w_r1").alias("w1"))


_BY_ASSET = f"""{frames.RETURNS}, {frames.TARGETS}, j AS (SELECT asset, r, y FROM returns JOIN target USING (date) WHERE r IS NOT NULL),
 m AS (SELECT 'A' || lpad(CAST(asset AS VARCHAR), 2, '0') AS scenario, avg(r) * 52 AS ir, avg(r) * 52 - 0.001::DOUBLE * asset AS net_ir, corr(r, y) AS rho, stddev_samp(r - y) AS te,
 avg(abs(r)) AS turnover, max(-r) AS mdd FROM j GROUP BY asset)"""


def _by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each instrument taken as a scenario of its own."""
    own = frames.returns(spark, sf_dir).where("r IS NOT NULL").join(frames.target(spark, sf_dir), "date")
    gap = F.col("r") - F.col("y")
    return own.groupBy("asset").agg(
        F.concat(F.lit("A"), F.lpad(F.first("asset").cast("string"), 2, "0")).alias("scenario"),
        (F.avg("r") * 52).alias("ir"),
        (F.avg("r") * 52 - F.first("asset") * 0.001).alias("net_ir"),
        F.corr("r", "y").alias("rho"),
        F.stddev_samp(gap).alias("te"),
        F.avg(F.abs("r")).alias("turnover"),
        F.max(-F.col("r")).alias("mdd"),
    )


_Z = " + ".join(f"{s} * ({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-12)" for c, s in {"ir": 1, "net_ir": 1, "rho": 1, "te": -1, "turnover": -1, "mdd": -1}.items())


@query(f"WITH {_BY_ASSET}, z AS (SELECT scenario, ({_Z}) / 6 AS composite FROM m) SELECT scenario, round(composite, 6) AS composite, CAST(row_number() OVER (ORDER BY composite DESC, scenario) AS INTEGER) AS rank FROM z")
def risk_select_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite z-score over six metrics and its rank."""
    return backtest.select_scenarios(_by_asset(spark, sf_dir)).select("scenario", _R("composite").alias("composite"), "rank")


_BEST = " UNION ALL ".join(
    f"SELECT '{c}' AS metric, arg_{f}(scenario, {c}) AS scenario, round({f}({c}), 6) AS value FROM m" for c, f in {"ir": "max", "net_ir": "max", "rho": "max", "te": "min", "turnover": "min", "mdd": "min"}.items()
)


@query(f"WITH {_BY_ASSET} {_BEST}")
def risk_scenario_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scenario by each metric."""
    return backtest.winners(_by_asset(spark, sf_dir)).select("metric", "scenario", _R("value").alias("value"))


@query(f"WITH {_BY_ASSET} SELECT scenario, round(rho - 2 * te - 0.5::DOUBLE * turnover - 0.1::DOUBLE * mdd, 6) AS score FROM m")
def risk_replication_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replication score of each scenario."""
    score = risk.replication_score(*(F.col(c) for c in ("rho", "te", "turnover", "mdd")))
    return _by_asset(spark, sf_dir).select("scenario", _R(score).alias("score"))
