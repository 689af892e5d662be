"""Queries that explain scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import explain
from marlstone.plans import frames
from marlstone.plans.model_queries import _judged_documents
from marlstone.plans.registry import query
from marlstone.sources import tables

_R = E.rounded
_GRID = {"age": [20.0, 35.0, 50.0, 65.0, 80.0], "risk": [0.0, 0.25, 0.5, 0.75, 1.0]}
_RULE = "1 / (1 + exp(-({age} / 20 + {risk} * 2 - n_orders * 0.1::DOUBLE - 3)))"


def _rule(df: DataFrame) -> DataFrame:
    """A closed form, so that SQL can check the operator."""
    return df.withColumn("score", 1 / (1 + F.exp(-(F.col("age") / 20 + F.col("risk") * 2 - F.col("n_orders") * 0.1 - 3))))


_POINTS = " UNION ALL ".join(f"SELECT '{c}' AS name, {v}::DOUBLE AS place" for c, values in _GRID.items() for v in values)
_MOVED = _RULE.format(**{c: f"CASE WHEN name = '{c}' THEN place ELSE {c} END" for c in _GRID})


@query(f"WITH {frames.CLIENTS}, g AS ({_POINTS}) SELECT name, place, round(avg({_MOVED}), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM g, clients GROUP BY name, place")
def explain_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial dependence of a score of all clients on two columns."""
    found = explain.partial_dependence(frames.clients(spark, sf_dir), "id", _GRID, ["age", "risk", "n_orders"], _rule)
    return found.select("name", "place", _R("mean").alias("mean"), "n")


@query(f"WITH {frames.CLIENTS}, g AS ({_POINTS}) SELECT id, name, place, round({_MOVED}, 6) AS score FROM g, clients WHERE id % 50 = 0")
def explain_individual_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of single clients, those whose id is divisible by 50."""
    asked = frames.clients(spark, sf_dir).where("id % 50 = 0")
    return explain.individual_curves(asked, "id", _GRID, ["age", "risk", "n_orders"], _rule).select("id", "name", "place", _R("score").alias("score"))


@query(f"""WITH {frames.CLIENTS}, b AS (SELECT age AS ba, risk AS br FROM clients ORDER BY id LIMIT 4)
 SELECT id, round(avg((age - ba) * (risk + br) / 2), 6) AS phi_age, round(avg((risk - br) * (age + ba) / 2), 6) AS phi_risk,
 round(avg(age * risk), 6) AS score, round(avg(ba * br), 6) AS base FROM clients, b GROUP BY id""")
def explain_shapley_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of all clients in two columns, which are exact."""
    own = frames.clients(spark, sf_dir)
    product = lambda df: df.withColumn("score", F.col("age") * F.col("risk"))
    found = explain.shapley(own, "id", ["age", "risk"], product, own.orderBy("id").limit(4), orders=2)
    return found.select("id", *(_R(c).alias(c) for c in ("phi_age", "phi_risk", "score", "base")))


def _forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], explain.Scorer]:
    """Labelled documents, their measures, and the chance of good quality from a forest fitted on seven tenths of them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    own, columns = _judged_documents(spark, sf_dir)
    assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    held = F.pmod(F.crc32(F.concat(F.lit("held:"), F.col("doc_id").cast("string"))), F.lit(10)) < 3
    model = RandomForestClassifier(labelCol="label", numTrees=30, maxDepth=6, seed=42).fit(assemble.transform(own.where(~held)))

    def score(df: DataFrame) -> DataFrame:
        done = model.transform(assemble.transform(df)).withColumn("score", vector_to_array("probability")[1])
        return done.drop("features", "probability", "rawPrediction", "prediction")

    return own, columns, score


@query()
def explain_forest_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial dependence of a forest's score on every measure of a document, at ten places of its range."""
    own, columns, score = _forest(spark, sf_dir)
    return explain.partial_dependence(own, "doc_id", explain.spread_grid(own, columns), columns, score)


@query()
def explain_forest_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and direction of the Shapley values of a forest's score over all labelled documents."""
    own, columns, score = _forest(spark, sf_dir)
    background = own.orderBy(F.xxhash64("doc_id")).limit(8)
    values = tables.kept(explain.shapley(own, "doc_id", columns, score, background, orders=2), "shapley")
    return explain.shapley_summary(values, columns)


@query()
def explain_forest_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of a linear model around single documents, those whose id is divisible by 50, in deviations of all."""
    own, columns, score = _forest(spark, sf_dir)
    found = explain.local_surrogate(own, "doc_id", columns, score)
    return found.where("doc_id % 50 = 0").select("doc_id", *(f"slope_{c}" for c in columns), "level")
