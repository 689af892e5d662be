"""The analytics' input frames, built from the driver's tables, and the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import panel
from marlstone.sources.tables import table

#: Instruments of the price panel.
ASSETS = list(range(11))
#: Target weights by component: fixed values.
TARGET = {"O": 0.5, "F": 0.25, "P": 0.25}


def prices(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """asset, date, price: mean extended price by discount step and week."""
    date = F.date_trunc(grain, "l_shipdate").cast("date").alias("date")
    return table(spark, sf_dir, "lineitem").groupBy(F.round(F.col("l_discount") * 100).cast("int").alias("asset"), date).agg(F.avg("l_extendedprice").alias("price"))


PRICES = """prices AS (SELECT CAST(round(l_discount * 100) AS INTEGER) AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
 avg(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)"""
RETURNS = PRICES + ", returns AS (SELECT *, price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS r FROM prices)"


def returns(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """asset, date, price, r."""
    return panel.return_panel(prices(spark, sf_dir, grain))


def target(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """date, y: weighted return of the order status components, on dates on which all have one."""
    date = F.date_trunc(grain, "o_orderdate").cast("date").alias("date")
    parts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("asset"), date).agg(F.avg("o_totalprice").alias("price"))
    weight = F.coalesce(*(F.when(F.col("asset") == k, w) for k, w in TARGET.items()))
    moved = panel.return_panel(parts).where("r IS NOT NULL")
    return moved.groupBy("date").agg(F.sum(F.col("r") * weight).alias("y"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(TARGET)).drop("n")


TARGETS = """comp AS (SELECT o_orderstatus AS asset, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2),
compr AS (SELECT *, price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS r FROM comp),
target AS (SELECT date, sum(r * CASE asset WHEN 'O' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) AS y FROM compr WHERE r IS NOT NULL GROUP BY date HAVING count(*) = 3)"""

NAMES = [f"r{a}" for a in ASSETS]


def replication(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """scenario, date, r0..r10, y: the dates on which every return is known."""
    x = panel.wide(returns(spark, sf_dir, grain), "asset", ASSETS, "r", "r")
    return x.join(target(spark, sf_dir, grain), "date").na.drop().select(F.lit("all").alias("scenario"), "date", *NAMES, "y")


_WIDE = ", ".join(f"max(r) FILTER (WHERE asset = {a}) AS r{a}" for a in ASSETS)
_ALL = " AND ".join(f"r{a} IS NOT NULL" for a in ASSETS)
REPLICATION = f"{RETURNS}, {TARGETS}, wide AS (SELECT date, {_WIDE} FROM returns GROUP BY date), rep AS (SELECT wide.*, y FROM wide JOIN target USING (date) WHERE {_ALL} AND y IS NOT NULL)"


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, age, gender, family, risk, income, wealth, segment, region: one row per customer."""
    bought = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("income"), F.count(F.lit(1)).alias("n_orders"))
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_custkey") % 61 + 20).cast("double").alias("age"),
        (F.col("c_custkey") % 2).cast("int").alias("gender"),
        (F.col("c_custkey") % 5 + 1).cast("int").alias("family"),
        ((F.col("c_custkey") % 100) / 99.0).alias("risk"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("wealth"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
    )
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return base.join(regions, "nation", "left").join(bought, "id", "left").select(
        "id", "age", "gender", "family", "risk", F.coalesce("income", F.lit(0.0)).alias("income"), "wealth", "segment", "region", F.coalesce("n_orders", F.lit(0)).alias("n_orders")
    )


CLIENTS = """bought AS (SELECT o_custkey AS id, avg(o_totalprice) AS income, count(*) AS n_orders FROM orders GROUP BY 1),
clients AS (SELECT c_custkey AS id, CAST(c_custkey % 61 + 20 AS DOUBLE) AS age, CAST(c_custkey % 2 AS INTEGER) AS gender, CAST(c_custkey % 5 + 1 AS INTEGER) AS family,
 (c_custkey % 100) / 99.0::DOUBLE AS risk, coalesce(income, 0.0::DOUBLE) AS income, greatest(c_acctbal, 0.0::DOUBLE) AS wealth, c_mktsegment AS segment, n_regionkey AS region, coalesce(n_orders, 0) AS n_orders
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN bought ON c_custkey = id)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, kind (1 accumulation, 0 income), prisk: eleven products, each a range of sizes of all parts."""
    size = F.col("p_size") - 1
    part = table(spark, sf_dir, "part").withColumn("product", F.floor(size * 11 / 50).cast("long"))
    return part.groupBy("product").agg(F.max(F.col("product") % 2).cast("int").alias("kind"), (F.sum(size.cast("long")) / F.count(F.lit(1)) / 49.0).alias("prisk"))


PRODUCTS = """products AS (SELECT (p_size - 1) * 11 // 50 AS product, CAST((p_size - 1) * 11 // 50 % 2 AS INTEGER) AS kind,
 sum(p_size - 1) / count(*) / 49.0::DOUBLE AS prisk FROM part GROUP BY 1)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, hour, n, value: the early-warning panel, gaps filled with 0."""
    events = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"), "value")
    seen = events.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    span = events.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    grid = span.crossJoin(F.broadcast(events.select("event_type").distinct()))  # five event types
    filled = grid.join(seen, ["event_type", "hour"], "left")
    return filled.select("event_type", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("value", F.lit(0.0)).alias("value"))


HOURLY = """ev AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, avg(value) AS value FROM events GROUP BY 1, 2),
span AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM ev),
hourly AS (SELECT t.event_type, span.hour, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(value, 0.0::DOUBLE) AS value
 FROM span CROSS JOIN (SELECT DISTINCT event_type FROM ev) t LEFT JOIN ev ON ev.event_type = t.event_type AND ev.hour = span.hour)"""
