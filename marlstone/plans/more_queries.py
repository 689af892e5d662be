"""Queries on sources, selection, composite features, detectors and learners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import backtest, learn, metrics, panel, recommend, risk, segment, stats, warning
from marlstone.plans import client_queries, frames, risk_queries, warning_queries
from marlstone.plans.registry import query
from marlstone.sources import tables
from marlstone.streaming import events as streams

_R = E.rounded
N = frames.NAMES


_LOGS = ", ".join(f"round(ln(max(price) FILTER (WHERE asset = {a})), 6) AS log{a}" for a in frames.ASSETS)


@query(f"WITH {frames.PRICES} SELECT date, {_LOGS} FROM prices GROUP BY date")
def source_header_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of all instruments under a preamble and a header row, found and coerced."""
    own = panel.wide(frames.prices(spark, sf_dir), "asset", frames.ASSETS, "price", "c")
    cells = [F.col(f"c{a}").cast("string").alias(f"c{i}") for i, a in enumerate(frames.ASSETS, 1)]
    body = own.select((F.datediff("date", F.lit("1900-01-01").cast("date")) + 2).alias("pos"), F.col("date").cast("string").alias("c0"), *cells)
    blank = [None] * len(frames.ASSETS)
    rows = [(0, "exported", *blank), (1, "Ticker ", *(f"A{a}" for a in frames.ASSETS)), (10**6, "not a date", *("1" for _ in blank))]
    top = spark.createDataFrame(rows, "pos int, c0 string, " + ", ".join(f"c{i} string" for i, _ in enumerate(blank, 1)))
    names = ["date", *(f"p{a}" for a in frames.ASSETS)]
    return tables.below_header(body.unionByName(top), "Ticker", names).select("date", *(_R(F.ln(f"p{a}")).alias(f"log{a}") for a in frames.ASSETS))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 11")
def source_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven longest documents."""
    own = frames.table(spark, sf_dir, "documents").select("doc_id", (-F.col("n_chars")).alias("less"), "n_chars")
    return tables.bounded(own, 11, "less", "doc_id").select("doc_id", "n_chars")


_ROW = """CAST('0x' || substr(md5(concat_ws('|', 'c_custkey,c_nationkey,c_mktsegment,c_acctbal', coalesce(CAST(c_custkey AS VARCHAR), '\\N'),
 coalesce(CAST(c_nationkey AS VARCHAR), '\\N'), coalesce(c_mktsegment, '\\N'), coalesce(CAST(c_acctbal AS VARCHAR), '\\N'))), 1, 15) AS BIGINT)"""


@query(f"SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, CAST(sum(h % 2147483648) AS BIGINT) AS sum_hash FROM (SELECT {_ROW} AS h FROM customer)")
def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free hash of a table."""
    return tables.fingerprint(frames.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"))


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def source_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as Parquet by brand and read back."""
    own = frames.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return tables.overwrite(own, tables.scratch(spark, "part"), "p_brand").select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey".replace("min_by(o_orderkey, (o_orderdate, o_orderkey))", "arg_min(o_orderkey, (o_orderdate, o_orderkey))").replace("max_by(o_orderkey, (o_orderdate, o_orderkey))", "arg_max(o_orderkey, (o_orderdate, o_orderkey))"))
def panel_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last order of each customer."""
    own = frames.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    first = panel.keep_one(own, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first"))
    last = panel.keep_one(own, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("last"))
    return first.join(last, "o_custkey")


@query(f"""WITH {frames.REPLICATION}, k AS (SELECT date, r0, floor((row_number() OVER (ORDER BY date) - 1) / 3) % 2 AS w FROM rep) SELECT date, coalesce(abs(w - lag(w) OVER (ORDER BY date)) > 1e-12, true) AS changed FROM k""")
def panel_change_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which held weights change."""
    own = frames.replication(spark, sf_dir).withColumn("w", (F.floor(panel.Roll("scenario").position() / 3) % 2).cast("double"))
    return panel.change_days(own, "scenario", ["w"]).select("date", "changed")


@query(f"""WITH {frames.RETURNS}, y AS (SELECT asset, CAST(year(date) AS INTEGER) AS year, round(product(1 + r) - 1, 6) AS total, CAST(count(r) AS BIGINT) AS n FROM returns WHERE r IS NOT NULL GROUP BY 1, 2) SELECT * FROM y""")
def panel_yearly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounded return by instrument and year."""
    own = frames.returns(spark, sf_dir).where("r IS NOT NULL")
    return own.groupBy("asset", F.year("date").alias("year")).agg(_R(F.product(1 + F.col("r")) - 1).alias("total"), F.count("r").alias("n"))


@query(f"WITH {frames.CLIENTS} SELECT segment, round(median(age), 6) AS age, (SELECT family FROM clients d WHERE d.segment = c.segment GROUP BY family ORDER BY count(*) DESC, family LIMIT 1) AS family FROM clients c GROUP BY segment")
def stats_median_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of a number and most frequent code by group."""
    return frames.clients(spark, sf_dir).groupBy("segment").agg(_R(F.median("age")).alias("age"), F.mode("family", True).alias("family"))


@query(f"WITH {frames.REPLICATION}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, corr({n}, y) AS r FROM rep" for n in N) + ") SELECT name, round(r, 6) AS r FROM c ORDER BY abs(r) DESC, name LIMIT 5")
def stats_top_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five instruments most correlated with the target."""
    own = stats.correlations_with(frames.replication(spark, sf_dir), N, "y")
    return own.orderBy(F.desc(F.abs("r")), "name").limit(5).select("name", _R("r").alias("r"))


@query(f"""WITH {frames.REPLICATION}, v AS (SELECT stddev_pop({" + ".join(N)}) * 2.3263478740408408 * 2 AS var FROM rep) SELECT round(var, 5) AS var, round(CASE WHEN var > 0.08::DOUBLE THEN 0.08::DOUBLE / var ELSE 1 END, 6) AS scale FROM v""")
def risk_var_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale that brings equal unit weights to a value-at-risk cap, with the population deviation."""
    factor = -E.normal_quantile(risk.CONFIDENCE) * risk.HORIZON**0.5
    one = frames.replication(spark, sf_dir).agg((F.stddev_pop(E.total(F.col(n) for n in N)) * factor).alias("var"))
    return one.select(_R("var", 5).alias("var"), _R(risk.var_scale(F.col("var"), 0.08)).alias("scale"))


_K = len(N)
_DRIFT = "OVER (PARTITION BY k // 4 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {frames.REPLICATION}, f AS (SELECT date, {", ".join(N)}, row_number() OVER (ORDER BY date) - 1 AS k FROM rep),
 g AS (SELECT date, {", ".join(f"coalesce(product(1 + {n}) {_DRIFT}, 1) / {_K} AS v{i}" for i, n in enumerate(N))} FROM f),
 h AS (SELECT *, greatest({" + ".join(f"v{i}" for i in range(_K))}, 0.001) AS whole FROM g)
 SELECT date, {", ".join(f"round(v{i} / whole, 6) AS w{i}" for i in range(_K))} FROM h""")
def risk_weight_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that drift with returns inside blocks of four rows and are brought back to one."""
    own = frames.replication(spark, sf_dir).withColumn("block", F.floor(panel.Roll("scenario").position() / 4))
    before = Window.partitionBy("scenario", "block").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({f"v{i}": F.coalesce(F.product(1 + F.col(n)).over(before), F.lit(1.0)) / _K for i, n in enumerate(N)})
    whole = F.greatest(E.total(F.col(f"v{i}") for i in range(_K)), F.lit(1e-3))
    return own.select("date", *(_R(F.col(f"v{i}") / whole).alias(f"w{i}") for i in range(_K)))


@query()
def eval_voting_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC on held-out clients of four classifiers' mean probability."""
    own = frames.clients(spark, sf_dir).withColumn("label", (F.col("n_orders") * 10 + F.col("age") + F.col("id") % 7 * 10 > 160).cast("int"))
    dealt = tables.spread(segment.stratified(tables.spread(own, "labelled", "id"), "label", "id", 0.7), "dealt", "id")
    columns = ["age", "income", "wealth", "risk", "n_orders"]
    return metrics.roc_auc(learn.vote(dealt.where("train"), dealt.where("NOT train"), "label", columns), "label", "score")


_HALF = [f"-ln(least(cume_dist() OVER (ORDER BY {n}), cume_dist() OVER (ORDER BY {n} DESC)))" for n in N]


@query(f"""WITH {frames.REPLICATION}, t AS (SELECT date, y, {", ".join(f"{e} AS t{i}" for i, e in enumerate(_HALF))} FROM rep), g AS (SELECT date, ({" + ".join(f"t{i}" for i in range(6))}) / 6 AS a, ({" + ".join(f"t{i}" for i in range(6, 11))}) / 5 AS b FROM t)
 SELECT date, round(a, 6) AS first, round(b, 6) AS second, round((-ln(least(cume_dist() OVER (ORDER BY a), cume_dist() OVER (ORDER BY a DESC))) - ln(least(cume_dist() OVER (ORDER BY b), cume_dist() OVER (ORDER BY b DESC)))) / 2, 6) AS meta FROM g""")
def warning_stacked_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail scores of two groups of columns, and the tail score of these scores."""
    own = frames.replication(spark, sf_dir)
    a = warning.tail_scores(own, N[:6], by="scenario").withColumnRenamed("tail", "first").select(*own.columns, "first")
    b = warning.tail_scores(a, N[6:], by="scenario").withColumnRenamed("tail", "second").select("scenario", "date", "first", "second")
    return warning.tail_scores(b, ["first", "second"], by="scenario").select("date", _R("first").alias("first"), _R("second").alias("second"), _R("tail").alias("meta"))


def _outside(c: str, fitted: str) -> str:
    """A held-out tail score in SQL."""
    sides = ", ".join(f"sum({fitted}) OVER (ORDER BY {c}{d}) + 1" for d in ("", " DESC"))
    return f"-ln(least({sides}) / (sum({fitted}) OVER () + 1))"


_GROUPS = (N[:6], N[6:])


@query(f"""WITH {frames.REPLICATION}, k AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM rep),
 p AS (SELECT *, CAST(i < floor(n * 0.6::DOUBLE) AS INTEGER) AS early, CAST(i >= floor(n * 0.6::DOUBLE) AND i < floor(n * 0.8::DOUBLE) AS INTEGER) AS later FROM k),
 t AS (SELECT date, early, later, {", ".join(f"{_outside(n, 'early')} AS t{i}" for i, n in enumerate(N))} FROM p),
 g AS (SELECT *, ({" + ".join(f"t{i}" for i in range(6))}) / 6 AS a, ({" + ".join(f"t{i}" for i in range(6, 11))}) / 5 AS b FROM t)
 SELECT date, round(a, 6) AS first, round(b, 6) AS second, round(({_outside("round(a, 9)", "later")} + {_outside("round(b, 9)", "later")}) / 2, 6) AS master FROM g""")
def warning_held_out_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail scores of two groups fitted on the first 60 %, and a master fitted on their scores on the next 20 %."""
    own = frames.replication(spark, sf_dir)
    dealt = panel.chronological(own, ["scenario"], "date", [("early", 0.6), ("later", 0.2), ("last", 0.2)])
    dealt = dealt.withColumns({"early": F.col("part") == "early", "later": F.col("part") == "later"})
    for name, columns in zip(("first", "second"), _GROUPS, strict=True):
        dealt = warning.held_out_tails(dealt, columns, "early", "scenario").withColumn(name, F.round("tail", 9)).drop("tail")
    done = warning.held_out_tails(dealt, ["first", "second"], "later", "scenario")
    return done.select("date", _R("first").alias("first"), _R("second").alias("second"), _R("tail").alias("master"))


@query(f"""WITH {warning_queries._L}, q AS (SELECT i AS percent, quantile_cont(score, i / 100.0) AS t FROM lab, range(30, 99) r(i) GROUP BY i), c AS (SELECT percent, count(*) FILTER (WHERE label = 1 AND score > t + 1e-9) AS tp, count(*) FILTER (WHERE score > t + 1e-9) AS said, sum(label) AS pos FROM q, lab GROUP BY percent)
 SELECT CAST(percent AS INTEGER) AS percent, round(CASE WHEN tp = 0 THEN 0 ELSE 5 * (tp / said) * (tp / pos) / (4 * (tp / said) + tp / pos) END, 6) AS f2 FROM c""".replace("quantile_cont(score, i / 100.0)", "(SELECT quantile_cont(score, 0.5) FROM lab) * i / 50.0::DOUBLE").replace(" FROM lab, range(30, 99) r(i) GROUP BY i)", " FROM range(30, 99) r(i))"))
def warning_percent_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 over a grid of thresholds that follow from the median score."""
    own = warning_queries._labelled(spark, sf_dir)
    cuts = own.agg(F.median("score").alias("m")).select(F.explode(F.sequence(F.lit(30), F.lit(98))).alias("percent"), "m")
    grid = cuts.select("percent", (F.col("m") * F.col("percent") / 50.0 + 1e-9).alias("t"))
    every = own.select("label", "score").crossJoin(F.broadcast(grid))  # 69 rows
    counts = every.groupBy("percent").agg(F.count_if((F.col("label") == 1) & (F.col("score") > F.col("t"))).alias("tp"), F.count_if(F.col("score") > F.col("t")).alias("said"), F.sum("label").alias("pos"))
    p, r = F.coalesce(E.ratio("tp", "said"), F.lit(0.0)), E.ratio("tp", "pos")
    return counts.select("percent", _R(metrics.fbeta(p, r, 2.0)).alias("f2"))


@query(f"""WITH {frames.CLIENTS}, {frames.PRODUCTS}, {client_queries._IA}, t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, product) AS k FROM ru WHERE id = 10) SELECT CAST(k AS INTEGER) AS rank, product, kind, round(prisk, 6) AS prisk FROM t WHERE k <= 3""")
def reco_for_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client's three products with what is known of them."""
    _, _, ruled = client_queries._scored(spark, sf_dir)
    ranked = metrics.top_k(ruled.select("id", "product", _R("score", 9).alias("score")), "id", "product", "score", 3)
    return recommend.recommendations_for(ranked, frames.products(spark, sf_dir), "id", 10).select("rank", "product", "kind", _R("prisk").alias("prisk"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling event windows, computed by a stream over the table."""
    table = frames.table(spark, sf_dir, "events")
    stream = streams.event_stream(spark, f"{sf_dir}/event[s].parquet", table.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    own = streams.latest_windows(streams.windowed_counts(stream), tables.scratch(spark, "windows"), ["start", "event_type"])
    return own.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _R("value").alias("value"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def clients_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no order names."""
    orders = frames.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return frames.table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')")
def clients_without_late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no order of the last months names; others have some."""
    late = frames.table(spark, sf_dir, "orders").where("o_orderdate >= DATE '2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return frames.table(spark, sf_dir, "customer").select("c_custkey").join(late, "c_custkey", "left_anti")


@query(f"WITH {risk_queries.WEEKLY} SELECT date, round(tc + CASE WHEN k % 13 = 0 THEN ge * 0.0002::DOUBLE ELSE 0 END, 8) AS tc, round(net - CASE WHEN k % 13 = 0 THEN ge * 0.0002::DOUBLE ELSE 0 END, 6) AS net FROM weekly")
def risk_roll_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs with those of rolling the exposure every thirteenth week."""
    rows = frames.replication(spark, sf_dir)
    weekly = backtest.evaluate_weights(rows, risk_queries.schedule(rows), N, roll_bps=2.0)
    return weekly.select("date", _R("tc", 8).alias("tc"), _R("net").alias("net"))


@query(f"WITH {risk_queries.WEEKLY} SELECT date, round(tc + 0.001::DOUBLE * power(turnover, 1.5::DOUBLE), 8) AS tc, round(net - 0.001::DOUBLE * power(turnover, 1.5::DOUBLE), 6) AS net FROM weekly")
def risk_impact_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs under another cost model: with an impact beside the basis points."""
    rows = frames.replication(spark, sf_dir)
    weekly = backtest.evaluate_weights(rows, risk_queries.schedule(rows), N, cost=risk.with_impact(risk.COST_BPS, 0.001))
    return weekly.select("date", _R("tc", 8).alias("tc"), _R("net").alias("net"))
