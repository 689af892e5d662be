"""Registry of the analytics queries: one callable and, where SQL can say it, one oracle per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators import backtest, risk
from marlstone.plans import client_queries, explain_queries, frames, model_queries, more_queries, panel_queries, risk_queries, stats_queries, warning_queries  # noqa: F401  they register their queries
from marlstone.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    """Every registered query by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric row of a held, regularly rebalanced portfolio on monthly rows (the smoke tables hold few full weeks)."""
    rows = frames.replication(spark, sf_dir, "month")
    return risk.evaluator_metrics(backtest.evaluate_weights(rows, risk_queries.schedule(rows), frames.NAMES, var_rows=12))
