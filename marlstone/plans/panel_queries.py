"""Queries on the price panel: returns, rolling and cumulative windows, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import panel
from marlstone.plans import frames
from marlstone.plans.registry import query


def _r(c, digits: int = 6):
    return E.rounded(c, digits)


@query(
    f"""WITH {frames.RETURNS} SELECT asset, date, round(ln(price), 6) AS log_price, round(r, 6) AS r, round(ln(price / lag(price) OVER w), 6) AS log_r, round((price - lag(price, 4) OVER w) / price, 6) AS diff4,
 round((price - lag(price, 12) OVER w) / price, 6) AS diff12 FROM returns WINDOW w AS (PARTITION BY asset ORDER BY date)"""
)
def panel_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple and log returns and differences (as shares of the price)."""
    roll = panel.Roll("asset")
    own = frames.returns(spark, sf_dir)
    diffs = [_r(E.ratio(roll.difference("price", k), "price")).alias(f"diff{k}") for k in (4, 12)]
    return own.select("asset", "date", _r(F.ln("price")).alias("log_price"), _r("r").alias("r"), _r(roll.log_return("price")).alias("log_r"), *diffs)


_ROLL = "OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _guard(value: str, c: str, k: int) -> str:
    over = _ROLL.format(k - 1)
    return f"CASE WHEN count({c}) {over} = {k} THEN round({value.format(over=over)}, 6) END"


@query(
    f"""WITH {frames.RETURNS} SELECT asset, date, {_guard('stddev_samp(r) {over}', 'r', 4)} AS std4, {_guard('stddev_samp(r) {over}', 'r', 26)} AS std26,
 {_guard('sum(r) {over}', 'r', 12)} AS sum12, {_guard('price / max(price) {over} - 1', 'price', 26)} AS dd26, {_guard('product(1 + r) {over} - 1', 'r', 12)} AS comp12, {_guard('avg(r) {over}', 'r', 52)} AS mean52 FROM returns"""
)
def panel_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling spread, momentum, drawdown, compounded and mean return; null until the frame is full."""
    roll = panel.Roll("asset")
    return frames.returns(spark, sf_dir).select(
        "asset",
        "date",
        _r(roll.std("r", 4)).alias("std4"),
        _r(roll.std("r", 26)).alias("std26"),
        _r(roll.sum("r", 12)).alias("sum12"),
        _r(roll.drawdown("price", 26)).alias("dd26"),
        _r(roll.compound("r", 12)).alias("comp12"),
        _r(roll.mean("r", 52)).alias("mean52"),
    )


@query(
    f"""WITH {frames.RETURNS} SELECT asset, date, round(product(1 + r) OVER w, 6) AS wealth, round(sum(r) OVER w, 6) AS total, round(ln(max(price) OVER w), 6) AS top,
 CAST(row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS INTEGER) AS pos FROM returns WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)"""
)
def panel_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wealth, running sum and maximum, position."""
    roll = panel.Roll("asset")
    return frames.returns(spark, sf_dir).select(
        "asset", "date", _r(roll.wealth("r")).alias("wealth"), _r(roll.running_sum("r")).alias("total"), _r(F.ln(roll.running_max("price"))).alias("top"), roll.position().cast("int").alias("pos")
    )


@query(
    f"""WITH {frames.RETURNS}, ref AS (SELECT date, r AS b FROM returns WHERE asset = 0), j AS (SELECT asset, date, r, b FROM returns LEFT JOIN ref USING (date) WHERE asset > 0)
 SELECT asset, date, CASE WHEN count(CASE WHEN b IS NOT NULL THEN r END) OVER w = 12 THEN round(corr(r, b) OVER w, 6) END AS corr12 FROM j
 WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
)
def panel_rolling_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling correlation with a reference asset."""
    own = frames.returns(spark, sf_dir)
    ref = own.where("asset = 0").select("date", F.col("r").alias("b"))
    joined = own.where("asset > 0").join(ref, "date", "left")
    return joined.select("asset", "date", _r(panel.Roll("asset").corr("r", "b", 12)).alias("corr12"))


@query(
    f"""WITH {frames.RETURNS}, q AS (SELECT *, CASE WHEN count(r) OVER w = 26 THEN quantile_cont(r, 0.1) OVER w END AS lo, CASE WHEN count(r) OVER w = 26 THEN quantile_cont(r, 0.9) OVER w END AS hi
 FROM returns WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING))
 SELECT asset, date, round(lo, 6) AS lo, round(hi, 6) AS hi, round(CASE WHEN lo IS NULL THEN r ELSE least(greatest(r, lo), hi) END, 6) AS clipped FROM q WHERE r IS NOT NULL"""
)
def panel_trailing_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns clipped to trailing quantiles that leave the current row out."""
    roll = panel.Roll("asset")
    own = frames.returns(spark, sf_dir).withColumns({"lo": roll.quantile("r", 26, 0.1), "hi": roll.quantile("r", 26, 0.9)}).where("r IS NOT NULL")
    clipped = F.when(F.col("lo").isNull(), F.col("r")).otherwise(F.least(F.greatest("r", "lo"), "hi"))
    return own.select("asset", "date", _r("lo").alias("lo"), _r("hi").alias("hi"), _r(clipped).alias("clipped"))


@query(
    f"""WITH {frames.PRICES}, sparse AS (SELECT asset, date, price FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS k FROM prices) WHERE k % 4 = 0)
 SELECT p.asset, p.date, round(ln(s.price), 6) AS held FROM prices p ASOF LEFT JOIN sparse s ON p.asset = s.asset AND p.date >= s.date"""
)
def panel_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth price, held until the next."""
    own = frames.prices(spark, sf_dir)
    sparse = own.withColumn("k", panel.Roll("asset").position()).where("k % 4 = 0")
    return panel.as_of(own, sparse, ["asset"], ["price"]).select("asset", "date", _r(F.ln("price")).alias("held"))


@query(
    f"""WITH {frames.REPLICATION} SELECT 'all' AS scenario, date, {", ".join(f"round({n}, 6) AS {n}" for n in frames.NAMES)}, round(y, 6) AS y FROM rep"""
)
def replication_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of eleven instruments beside the composite target."""
    return frames.replication(spark, sf_dir).select("scenario", "date", *(_r(n).alias(n) for n in [*frames.NAMES, "y"]))


@query(
    f"""WITH {frames.RETURNS}, f AS (SELECT asset, date, r, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY asset) AS n FROM returns WHERE r IS NOT NULL)
 SELECT asset, CASE WHEN k < floor(n * 0.6::DOUBLE) THEN 'train' WHEN k < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'valid' ELSE 'test' END AS part, CAST(count(*) AS BIGINT) AS n, min(date) AS first, max(date) AS last, round(avg(r), 6) AS mean FROM f GROUP BY 1, 2"""
)
def panel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological 60/20/20 split, summarised."""
    own = frames.returns(spark, sf_dir).where("r IS NOT NULL")
    dealt = panel.chronological(own, ["asset"], "date", [("train", 0.6), ("valid", 0.2), ("test", 0.2)])
    return dealt.groupBy("asset", "part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), _r(F.avg("r")).alias("mean"))


@query(
    f"""WITH {frames.RETURNS}, f AS (SELECT asset, date, r, lead(r, 1) OVER w AS r1, lead(r, 2) OVER w AS r2, lead(r, 3) OVER w AS r3 FROM (SELECT * FROM returns WHERE r IS NOT NULL) WINDOW w AS (PARTITION BY asset ORDER BY date))
 SELECT asset, date, round((1 + r) * (1 + r1) * (1 + r2) * (1 + r3) - 1, 6) AS ahead FROM f WHERE r3 IS NOT NULL"""
)
def panel_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounded return of the row and the three after it; an incomplete tail is dropped."""
    ahead = panel.forward_rows(frames.returns(spark, sf_dir).where("r IS NOT NULL"), "asset", "r", 4)
    compounded = F.aggregate("ahead", F.lit(1.0), lambda s, x: s * (1 + x)) - 1
    return ahead.select("asset", "date", _r(compounded).alias("ahead"))


@query(
    f"""WITH {frames.PRICES}, a AS (SELECT DISTINCT date FROM prices WHERE asset = 1), b AS (SELECT DISTINCT date FROM prices WHERE asset = 2), t AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders)
 SELECT 'both' AS which, CAST(count(*) AS BIGINT) AS n FROM (SELECT date FROM a INTERSECT SELECT date FROM b INTERSECT SELECT date FROM t)
 UNION ALL SELECT 'only_prices', CAST(count(*) AS BIGINT) FROM (SELECT date FROM a EXCEPT SELECT date FROM t)
 UNION ALL SELECT 'any', CAST(count(*) AS BIGINT) FROM (SELECT date FROM a UNION SELECT date FROM b UNION SELECT date FROM t)"""
)
def panel_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of calendars."""
    own = frames.prices(spark, sf_dir)
    a, b = (own.where(F.col("asset") == k).select("date").distinct() for k in (1, 2))
    t = frames.table(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).distinct()
    sets = {"both": a.intersect(b).intersect(t), "only_prices": a.subtract(t), "any": a.union(b).union(t).distinct()}
    out = None
    for name, days in sets.items():
        row = days.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("which"), "n")
        out = row if out is None else out.unionByName(row)
    return out
