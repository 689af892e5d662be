"""Queries on clients and products: cleaning, features, segmentation, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import clean, gower, metrics, recommend, segment
from marlstone.plans import frames
from marlstone.plans.registry import query
from marlstone.sources import tables

_R = E.rounded
_C = frames.CLIENTS


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients as text with blanks, wrong codes and repeated rows."""
    own = frames.clients(spark, sf_dir)
    text = own.select(
        F.col("id"),
        F.when(F.col("id") % 17 == 0, "N/A").when(F.col("id") % 19 == 0, "abc").otherwise(F.col("age").cast("int").cast("string")).alias("age"),
        F.when(F.col("id") % 23 == 0, "--").otherwise((F.col("id") * 7 % 1000).cast("string")).alias("income"),
        F.when(F.col("id") % 29 == 0, "9").otherwise(F.col("gender").cast("string")).alias("gender"),
        F.lit("1").alias("flat"),
    )
    first, again, other = (text.withColumn("pos", F.col("id") * 4 + i) for i in range(3))
    return first.unionByName(again.where("id % 5 = 0")).unionByName(other.where("id % 7 = 0").withColumn("income", F.lit("1")))


@query(f"""WITH {_C}, t AS (SELECT id, CASE WHEN id % 17 = 0 OR id % 19 = 0 THEN NULL ELSE age END AS age, CASE WHEN id % 23 = 0 THEN NULL ELSE CAST(id * 7 % 1000 AS DOUBLE) END AS income, CASE WHEN id % 29 = 0 THEN NULL ELSE gender END AS gender FROM clients),
 g AS (SELECT gender FROM t WHERE gender IS NOT NULL GROUP BY gender ORDER BY count(*) DESC, gender LIMIT 1)
 SELECT id, coalesce(age, (SELECT median(age) FROM t)) AS age, coalesce(income, (SELECT median(income) FROM t)) AS income, coalesce(gender, (SELECT gender FROM g)) AS gender, CAST(1 AS INTEGER) AS flat FROM t""")
def clean_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text clients without blanks, duplicates and wrong codes, imputed."""
    done, _ = clean.audited(_raw(spark, sf_dir), "id", "pos", ["age", "income"], {"gender": [0, 1], "flat": [1]})
    return done.select("id", "age", "income", "gender", "flat")


@query(f"""WITH {_C} SELECT 'rows_in' AS step, '' AS "column", CAST(count(*) + count(*) FILTER (WHERE id % 5 = 0) + count(*) FILTER (WHERE id % 7 = 0) AS DOUBLE) AS value FROM clients
 UNION ALL SELECT 'rows_out', '', CAST(count(*) AS DOUBLE) FROM clients UNION ALL SELECT 'nulls', 'age', CAST(count(*) FILTER (WHERE id % 17 = 0 OR id % 19 = 0) AS DOUBLE) FROM clients
 UNION ALL SELECT 'nulls', 'income', CAST(count(*) FILTER (WHERE id % 23 = 0) AS DOUBLE) FROM clients UNION ALL SELECT 'nulls', 'gender', CAST(count(*) FILTER (WHERE id % 29 = 0) AS DOUBLE) FROM clients UNION ALL SELECT 'nulls', 'flat', 0.0 FROM (SELECT 1)
 UNION ALL SELECT 'zero_variance', 'flat', round(1.0 / count(*), 6) FROM clients""")
def clean_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cleaning found."""
    _, audit = clean.audited(_raw(spark, sf_dir), "id", "pos", ["age", "income"], {"gender": [0, 1], "flat": [1]})
    return audit.select("step", "column", _R("value").alias("value"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IN (0, 1) AND toxic IN (0, 1)")
def clean_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with every binary target known."""
    own = frames.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return clean.binary_targets(own, ["quality", "toxic"])


@query(f"""WITH {_C} SELECT id, round(CASE WHEN wealth = 0 THEN NULL ELSE income / wealth END, 4) AS income_to_wealth, round(ln(1 + wealth), 6) AS log_wealth, round(age * risk, 6) AS age_risk, round(age * age, 2) AS age2,
 CAST(age < 35 AS INTEGER) AS young, CAST(age >= 35 AND age < 55 AS INTEGER) AS middle, CAST(age >= 55 AND age < 70 AS INTEGER) AS senior, CAST(age >= 70 AS INTEGER) AS elder FROM clients""")
def client_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, interactions, logarithms and age bins."""
    age = F.col("age")
    bins = {"young": age < 35, "middle": (age >= 35) & (age < 55), "senior": (age >= 55) & (age < 70), "elder": age >= 70}
    return frames.clients(spark, sf_dir).select(
        "id", _R(E.ratio("income", "wealth"), 4).alias("income_to_wealth"), _R(F.log1p("wealth")).alias("log_wealth"), _R(age * F.col("risk")).alias("age_risk"), _R(age * age, 2).alias("age2"), *(c.cast("int").alias(n) for n, c in bins.items())
    )


@query(f"""WITH {_C} SELECT id, round((age - avg(age) OVER ()) / stddev_pop(age) OVER (), 6) AS age, round((wealth - avg(wealth) OVER ()) / stddev_pop(wealth) OVER (), 6) AS wealth,
 round((risk - min(risk) OVER ()) / (max(risk) OVER () - min(risk) OVER ()), 6) AS risk, CAST(segment = 'BUILDING' AS INTEGER) AS segment_BUILDING, CAST(segment = 'MACHINERY' AS INTEGER) AS segment_MACHINERY FROM clients""")
def client_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised, range-scaled and one-hot columns."""
    own = segment.minmax(segment.standardised(frames.clients(spark, sf_dir), ["age", "wealth"]), ["risk"])
    own = segment.one_hot(own, "segment", ["BUILDING", "MACHINERY"])
    return own.select("id", *(_R(c).alias(c) for c in ("age", "wealth", "risk")), "segment_BUILDING", "segment_MACHINERY")


@query(f"WITH {_C} SELECT id, segment, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS INTEGER) AS code, CASE gender WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS gender_name FROM clients")
def client_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label codes and mapped values."""
    own = frames.clients(spark, sf_dir)
    return own.join(F.broadcast(segment.label_codes(own, "segment")), "segment").select("id", "segment", "code", E.mapped("gender", {0: "Male", 1: "Female"}).alias("gender_name"))


_GOWER = """sp AS (SELECT max(age) - min(age) AS a, max(wealth) - min(wealth) AS w, max(risk) - min(risk) AS r FROM clients),
 gw AS (SELECT q.id AS q, c.id, (abs(c.age - q.age) / a + abs(c.wealth - q.wealth) / w + abs(c.risk - q.risk) / r + CAST(c.gender <> q.gender AS DOUBLE) + CAST(c.segment <> q.segment AS DOUBLE)) / 5 AS distance FROM clients c, sp, (SELECT * FROM clients WHERE id % 50 = 0) q)"""


_NUMBERS, _CODES = ["age", "wealth", "risk"], ["gender", "segment"]


@query(f"WITH {_C}, {_GOWER} SELECT q, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(distance, 9), id) AS k FROM gw WHERE q <> id) WHERE k <= 5")
def segment_gower_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest clients of the query clients (every fiftieth) under Gower distance."""
    own = frames.clients(spark, sf_dir)
    found = segment.nearest(own.where("id % 50 = 0"), own, "id", _NUMBERS, _CODES, 5)
    return found.select("q", "id", _R("distance").alias("distance"))


_PAIRS = _GOWER.replace(" WHERE id % 50 = 0", "")


@query(f"""WITH {_C}, {_PAIRS}, m AS (SELECT gw.q, o.region AS own, c.region AS label, avg(distance) AS d FROM gw JOIN clients c ON c.id = gw.id JOIN clients o ON o.id = gw.q WHERE gw.q <> gw.id GROUP BY 1, 2, 3),
 s AS (SELECT q, max(d) FILTER (WHERE own = label) AS a, min(d) FILTER (WHERE own <> label) AS b FROM m GROUP BY q)
 SELECT id, region AS label, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM clients LEFT JOIN s ON q = id""")
def segment_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of every client for a given grouping, from sums over features; the SQL takes all pairs."""
    own = frames.clients(spark, sf_dir)
    labels = own.select("id", F.col("region").cast("int").alias("label"))
    rows = gower.scaled_rows(own, "id", _NUMBERS, _CODES).join(labels, "id")
    return gower.silhouettes(rows, [], "id", _NUMBERS, _CODES, 5).select("id", "label", _R("silhouette").alias("silhouette"))


@query(f"""WITH {_C}, t AS (SELECT region, gender, count(*) AS n, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, gender) AS k FROM clients GROUP BY 1, 2),
 s AS (SELECT region, count(*) AS size, round(avg(age), 6) AS mean_age, round(avg(wealth), 4) AS mean_wealth FROM clients GROUP BY region)
 SELECT s.region, CAST(size AS BIGINT) AS size, mean_age, mean_wealth, round(size / sum(size) OVER (), 6) AS share, t.gender AS top_gender, round(n / size, 6) AS share_gender,
 CASE WHEN n / size >= 0.75 THEN 'strong' WHEN n / size >= 0.55 THEN 'moderate' ELSE 'weak' END AS tag_gender FROM s JOIN t ON s.region = t.region AND k = 1""")
def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, dominant category and size of each group."""
    own = segment.profile(frames.clients(spark, sf_dir), "region", ["age", "wealth"], ["gender"])
    return own.select("region", "size", _R("mean_age").alias("mean_age"), _R("mean_wealth", 4).alias("mean_wealth"), _R("share").alias("share"), "top_gender", _R("share_gender").alias("share_gender"), "tag_gender")


@query(f"""WITH {_C}, p AS (SELECT region AS nearest, avg(age) AS a, avg(risk) AS r, avg(family) AS f FROM clients GROUP BY region), d AS (SELECT id, nearest, power(age - a, 2) + power(risk - r, 2) + power(family - f, 2) AS g FROM clients, p)
 SELECT id, arg_min(nearest, g) AS nearest FROM d GROUP BY id""")
def segment_nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of the nearest class mean."""
    own = frames.clients(spark, sf_dir)
    columns = ["age", "risk", "family"]
    return segment.nearest_prototype(own, segment.prototypes(own, "region", columns), "region", columns, "id")


@query()
def segment_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters around medoids."""
    return gower.k_medoids(frames.clients(spark, sf_dir), "id", _NUMBERS, _CODES, 5)


@query()
def segment_medoid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette and inertia of 3 to 14 medoids over all clients, and which number is best."""
    return gower.medoid_counts(frames.clients(spark, sf_dir), "id", _NUMBERS, _CODES, list(range(3, 15)))


@query()
def segment_principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients on two principal axes."""
    own, _ = segment.principal_axes(segment.standardised(frames.clients(spark, sf_dir), ["age", "income", "wealth", "risk"]), ["age", "income", "wealth", "risk"], 2)
    return own.select("id", "pc1", "pc2")


@query(f"""WITH {_C}, z AS (SELECT (age - avg(age) OVER ()) / stddev_pop(age) OVER () AS a, (wealth - avg(wealth) OVER ()) / stddev_pop(wealth) OVER () AS b FROM clients),
 m AS (SELECT var_samp(a) AS a, var_samp(b) AS c, covar_samp(a, b) AS b FROM z), e AS (SELECT (a + c) / 2 AS mid, sqrt(power((a - c) / 2, 2) + b * b) AS half FROM m)
 SELECT 1 AS axis, round(mid + half, 6) AS variance, round((mid + half) / (2 * mid), 6) AS share FROM e UNION ALL SELECT 2, round(mid - half, 6), round((mid - half) / (2 * mid), 6) FROM e""")
def segment_axis_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance along two principal axes of two columns, and their shares, which a closed form can check."""
    columns = ["age", "wealth"]
    own, shares = segment.principal_axes(segment.standardised(frames.clients(spark, sf_dir), columns), columns, 2)
    one = own.agg(F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2"))
    rows = F.array(*(F.struct(F.lit(i).alias("axis"), _R(F.col(f"v{i}")).alias("variance"), _R(F.lit(s)).alias("share")) for i, s in enumerate(shares, 1)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


@query()
def segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced tree's predictions of groups."""
    own = segment.stratified(frames.clients(spark, sf_dir).withColumn("group", F.col("gender")), "group", "id", 0.8)
    model, _ = segment.balanced_tree(own.where("train"), "group", ["age", "income", "wealth", "risk"])
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["age", "income", "wealth", "risk"], outputCol="features").transform(own.where("NOT train"))
    return model.transform(rows).select("id", "group", F.col("prediction").cast("int").alias("predicted"))


_IA = """cl AS (SELECT *, 0.2::DOUBLE + 0.6::DOUBLE * (id % 11) / 10.0::DOUBLE AS p_income, 0.9::DOUBLE - 0.7::DOUBLE * (id % 13) / 12.0::DOUBLE AS p_accumulation FROM clients),
 ia AS (SELECT id, product, kind, prisk, risk, age, wealth, greatest(CASE WHEN kind = 1 THEN p_accumulation ELSE p_income END * (1 - 0.3::DOUBLE * abs(risk - prisk)), 0) AS score FROM cl, products),
 md AS (SELECT median(wealth) AS m FROM clients),
 ru AS (SELECT id, product, kind, prisk, score AS base, score * CASE WHEN age > 70 AND kind = 1 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN age < 30 AND kind = 0 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN wealth < m AND prisk > 0.6::DOUBLE THEN 0.8::DOUBLE ELSE 1 END
 * CASE WHEN abs(risk - prisk) > 0.45::DOUBLE THEN 0.75::DOUBLE ELSE 1 END AS score FROM ia, md)"""


def _chances(own: DataFrame) -> DataFrame:
    return own.withColumns({"p_income": 0.2 + 0.6 * (F.col("id") % 11) / 10.0, "p_accumulation": 0.9 - 0.7 * (F.col("id") % 13) / 12.0})


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = tables.spread(frames.clients(spark, sf_dir), "clients", "id")
    scored = recommend.interactions(_chances(own), frames.products(spark, sf_dir))
    return own, scored, recommend.ruled(scored, own)


@query(f"WITH {_C}, {frames.PRODUCTS}, {_IA} SELECT id, product, round(base, 6) AS base, round(score, 6) AS score FROM ru")
def reco_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction scores before and after the business rules."""
    _, _, ruled = _scored(spark, sf_dir)
    return ruled.select("id", "product", _R("base").alias("base"), _R("score").alias("score"))


@query(f"WITH {_C}, {frames.PRODUCTS}, {_IA} SELECT id, product, CAST(k AS INTEGER) AS rank, round(ln(1 + score), 6) AS log_score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, product) AS k FROM ru) WHERE k <= 3")
def reco_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best products of each client."""
    own = tables.spread(frames.clients(spark, sf_dir), "clients", "id")
    top = recommend.best_ruled(_chances(own), frames.products(spark, sf_dir), 3)
    return top.select("id", "product", "rank", _R(F.log1p("score")).alias("log_score"))


@query(f"""WITH {_C}, {frames.PRODUCTS}, {_IA}, b AS (SELECT id, product, round(base, 9) AS rel, round(score, 9) AS score FROM ru), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rel DESC, product) AS best, row_number() OVER (PARTITION BY id ORDER BY score DESC, product) AS rank FROM b),
 u AS (SELECT id, count(*) FILTER (WHERE best <= 3 AND rank <= 3) / 3.0 AS p, sum((power(2, rel) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 3) / sum((power(2, rel) - 1) / log2(best + 1)) FILTER (WHERE best <= 3) AS g FROM r GROUP BY id)
 SELECT CAST(count(*) AS BIGINT) AS users, round(avg(p), 6) AS precision, round(avg(p), 6) AS recall, round(avg(g), 6) AS ndcg FROM u""")
def reco_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and NDCG at 3 of ruled against plain scores."""
    _, scored, ruled = _scored(spark, sf_dir)
    truth = scored.select("id", "product", _R("score", 9).alias("rel"))
    own = metrics.ranking_metrics(truth, ruled.select("id", "product", _R("score", 9).alias("score")), "id", "product", 3)
    return own.agg(F.count(F.lit(1)).alias("users"), *(_R(F.avg(c)).alias(c) for c in ("precision", "recall", "ndcg")))


@query()
def reco_low_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE and count on held-out cells of a rank-6 approximation of the others."""
    _, scored, _ = _scored(spark, sf_dir)
    cells = scored.select("id", "product", "score").withColumn("out", recommend.held_out("id", "product"))
    fitted = recommend.low_rank(cells.withColumn("score", F.when(F.col("out"), 0.0).otherwise(F.col("score"))), "id", "product", frames.ASSETS, 6)
    truth = cells.where("out").select("id", "product", F.col("score").alias("rel"))
    return truth.join(fitted, ["id", "product"]).agg(F.sqrt(F.avg(F.pow(F.col("rel") - F.col("score"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query()
def reco_rank_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE on held-out cells by the rank of the approximation, 2 to 10."""
    _, scored, _ = _scored(spark, sf_dir)
    cells = scored.select("id", "product", "score").withColumn("out", recommend.held_out("id", "product"))
    seen = cells.withColumn("score", F.when(F.col("out"), 0.0).otherwise(F.col("score")))
    fitted = recommend.low_ranks(seen, "id", "product", frames.ASSETS, list(range(2, 11)))
    truth = cells.where("out").select("id", "product", F.col("score").alias("rel"))
    return truth.join(fitted, ["id", "product"]).groupBy("rank").agg(F.sqrt(F.avg(F.pow(F.col("rel") - F.col("score"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n"))
