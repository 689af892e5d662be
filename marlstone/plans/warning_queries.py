"""Queries on early warning and evaluation: features, tail scores, metrics, sweeps, routing, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import metrics, panel, segment, warning
from marlstone.plans import frames
from marlstone.plans.registry import query
from marlstone.sources import tables

_R = E.rounded


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, score, wild: labels with a score that depends on them in part, with ties."""
    own = frames.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"), F.col("toxic").cast("int").alias("toxic"))
    noise = F.col("doc_id") * 37 % 101  # whole numbers, so that both engines agree on ties
    return own.withColumns({"score": (30 * F.col("label") + F.floor(noise * 7 / 10)) / 100.0, "predicted": (300 * F.col("label") + 7 * noise > 500).cast("int")})


_L = """lab AS (SELECT doc_id, CAST(quality AS INTEGER) AS label, CAST(toxic AS INTEGER) AS toxic, (30 * quality + (doc_id * 37 % 101) * 7 // 10) / 100.0::DOUBLE AS score,
 CAST(300 * quality + 7 * (doc_id * 37 % 101) > 500 AS INTEGER) AS predicted FROM labels)"""
_CM = """cm AS (SELECT count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND predicted = 1) AS fp, count(*) FILTER (WHERE label <> 1 AND predicted <> 1) AS tn, count(*) FILTER (WHERE label = 1 AND predicted <> 1) AS fn FROM lab)"""


@query(f"""WITH {_L}, {_CM}, p AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM cm)
 SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(fn / (tp + fn), 6) AS fnr,
 round(2 * p * r / (p + r), 6) AS f1, round(5 * p * r / (4 * p + r), 6) AS f2 FROM p""")
def eval_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and the scores from them."""
    own = metrics.scores(metrics.confusion(_labelled(spark, sf_dir), "label", "predicted"))
    return own.select("tp", "fp", "tn", "fn", *(_R(c).alias(c) for c in ("accuracy", "precision", "recall", "fnr", "f1")), _R("fbeta").alias("f2"))


@query(f"""WITH {_L}, c AS (SELECT CAST(label AS VARCHAR) AS name, count(*) AS s, count(*) FILTER (WHERE label = predicted) AS h FROM lab GROUP BY label), s AS (SELECT CAST(predicted AS VARCHAR) AS name, count(*) AS n FROM lab GROUP BY predicted),
 e AS (SELECT c.name, h / n AS p, h / s AS r, s FROM c JOIN s USING (name)), f AS (SELECT *, 2 * p * r / (p + r) AS f FROM e)
 SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM f UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM f
 UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class, macro and weighted scores."""
    return metrics.report(_labelled(spark, sf_dir), "label", "predicted").select("name", *(_R(c).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_L} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM lab p, lab n WHERE p.label = 1 AND n.label = 0")
def eval_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve with ties."""
    return metrics.roc_auc(_labelled(spark, sf_dir), "label", "score").select(_R("auc").alias("auc"))


@query(f"""WITH {_L}, s AS (SELECT DISTINCT score FROM lab) SELECT s.score, round((SELECT count(*) FROM lab WHERE label = 0 AND lab.score >= s.score) / (SELECT count(*) FROM lab WHERE label = 0), 6) AS fpr,
 round((SELECT count(*) FROM lab WHERE label = 1 AND lab.score >= s.score) / (SELECT count(*) FROM lab WHERE label = 1), 6) AS tpr FROM s""")
def eval_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the ROC curve."""
    return metrics.roc_curve(_labelled(spark, sf_dir), "label", "score").select("score", _R("fpr").alias("fpr"), _R("tpr").alias("tpr"))


@query(f"""WITH {_L}, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM lab GROUP BY score), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS m, sum(p) OVER () AS a FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
 SELECT round(sum(p / a * tp / m), 6) AS ap FROM c""")
def eval_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision."""
    return metrics.average_precision(_labelled(spark, sf_dir), "label", "score").select(_R("ap").alias("ap"))


# 199 times the score in hundredths: a whole number, and so is every threshold between the least and the greatest
_STEPS = f"""{_L}, whole AS (SELECT label, 199 * round(score * 100) AS s FROM lab), e AS (SELECT min(s) AS a, max(s) AS b FROM whole),
 g AS (SELECT i AS step, a + (b - a) * i / 199 AS t FROM e, range(200) r(i)),
 c AS (SELECT step, t, count(*) FILTER (WHERE label = 1 AND s > t) AS tp, count(*) FILTER (WHERE s > t) AS said,
 count(*) FILTER (WHERE label = 1) AS pos FROM g, whole GROUP BY step, t),
 p AS (SELECT step, CASE WHEN said = 0 THEN 0 ELSE tp / said END AS p, tp / pos AS r FROM c)"""


@query(f"""WITH {_STEPS} SELECT CAST(step AS INTEGER) AS step, round(p, 6) AS precision, round(r, 6) AS recall,
 round(CASE WHEN 4 * p + r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END, 6) AS f2 FROM p""")
def eval_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F2 at 200 thresholds, exact where a threshold meets a score."""
    own = _labelled(spark, sf_dir).withColumn("score", 199 * F.round(F.col("score") * 100))
    swept = metrics.sweep(own, "label", "score")
    return swept.select("step", _R("precision").alias("precision"), _R("recall").alias("recall"), _R("fbeta").alias("f2"))


@query(f"""WITH {_L}, q AS (SELECT quantile_cont(score, 0.85) AS red, quantile_cont(score, 0.6) AS amber FROM lab), r AS (SELECT label, CASE WHEN score > red THEN 'red' WHEN score > amber THEN 'amber' ELSE 'green' END AS light FROM lab, q)
 SELECT light, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS positives FROM r GROUP BY light""")
def eval_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red, amber and green by score quantiles, counted."""
    own = _labelled(spark, sf_dir)
    cuts = own.agg(F.percentile("score", [0.85, 0.6]).alias("q"))
    lit = own.crossJoin(F.broadcast(cuts)).withColumn("light", metrics.traffic_light(F.col("score"), F.col("q")[1], F.col("q")[0]))  # one row
    return lit.groupBy("light").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("positives"))


@query(f"WITH {_L} SELECT CASE WHEN label = 1 AND predicted = 1 THEN 'TP' WHEN label <> 1 AND predicted <> 1 THEN 'TN' WHEN predicted = 1 THEN 'FP' ELSE 'FN' END AS outcome, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first, round(avg(score), 6) AS mean FROM lab GROUP BY 1")
def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by outcome."""
    own = _labelled(spark, sf_dir).withColumn("outcome", metrics.outcome("label", "predicted"))
    return own.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), _R(F.avg("score")).alias("mean"))


@query("""WITH l AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) SELECT quality, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY quality""")
def eval_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by class."""
    return frames.table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


#: Columns of the panel, one for each event type in alphabetical order, and what kind of series each stands for.
PANEL = ["p0", "p1", "p2", "p3", "p4"]
PRICES, RATES, LEVELS = PANEL[:3], PANEL[3:4], PANEL[4:]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel, hour and the mean value of every event type by hour, above 0."""
    own = frames.hourly(spark, sf_dir).withColumn("value", F.col("value") + 1.0)
    coded = own.join(F.broadcast(segment.label_codes(own, "event_type")), "event_type")  # five event types
    wide = coded.groupBy("hour").agg(*(F.max(F.when(F.col("code") == i, F.col("value"))).alias(c) for i, c in enumerate(PANEL)))
    return wide.select(F.lit("all").alias("panel"), "hour", *PANEL)


_W = f"""{frames.HOURLY}, ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM hourly)),
 wd AS (SELECT hour, {", ".join(f"max(value + 1) FILTER (WHERE i = {i}) AS {c}" for i, c in enumerate(PANEL))} FROM hourly JOIN ty USING (event_type) GROUP BY hour),
 wr AS (SELECT *, {", ".join(f"ln({c} / lag({c}) OVER (ORDER BY hour)) AS {c}_r" for c in PRICES)} FROM wd)"""


def _features() -> dict[str, str]:
    """The features in SQL by name."""

    def over(value: str, k: int, known: str) -> str:
        frame = f"OVER (ORDER BY hour ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count({known}) {frame} = {k} THEN round({value.replace('$', frame)}, 6) END"

    made = {}
    for p in PRICES:
        r = f"{p}_r"
        made |= {f"{p}_vol{k}": over(f"stddev_samp({r}) $", k, r) for k in (4, 12, 26)}
        made |= {f"{p}_mom{k}": over(f"sum({r}) $", k, r) for k in (4, 12, 26)}
        made |= {f"{p}_dd{k}": over(f"{p} / max({p}) $ - 1", k, p) for k in (26, 52)}
    for c in RATES + LEVELS:
        steps = (4, 12) if c in RATES else (1, 4, 12)
        made |= {f"{c}_d{k}": f"round({c} - lag({c}, {k}) OVER (ORDER BY hour), 6)" for k in steps}
    for c in LEVELS:
        made |= {f"{c}_vol{k}": over(f"stddev_samp({c}) $", k, c) for k in (12, 26)}
    first = f"{PRICES[0]}_r"
    for p in PRICES[1:]:
        both = f"CASE WHEN {first} IS NOT NULL THEN {p}_r END"
        made |= {f"{p}_r_corr{k}": over(f"corr({p}_r, {first}) $", k, both) for k in (12, 26)}
    return made


FEATURES = _features()


@query(f"SELECT event_type, hour, n, round(value, 6) AS value FROM (WITH {frames.HOURLY} SELECT * FROM hourly)")
def warning_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and means by event type without gaps."""
    return frames.hourly(spark, sf_dir).select("event_type", "hour", "n", _R("value").alias("value"))


@query(f"WITH {_W} SELECT hour, {', '.join(f'{e} AS {n}' for n, e in FEATURES.items())} FROM wr")
def warning_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the panel: volatility, momentum, drawdown, changes, levels, correlations."""
    own = warning.warning_features(_wide(spark, sf_dir), PRICES, RATES, LEVELS, "panel", "hour")
    return own.select("hour", *(_R(c).alias(c) for c in FEATURES))


@query(f"""WITH {frames.RETURNS}, f AS (SELECT asset, date, r FROM returns WHERE r IS NOT NULL) SELECT asset, date, round(-ln(least(cume_dist() OVER (PARTITION BY asset ORDER BY r), cume_dist() OVER (PARTITION BY asset ORDER BY r DESC))), 6) AS tail FROM f""")
def warning_tail_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus the log of the smaller empirical tail of each return."""
    own = warning.tail_scores(frames.returns(spark, sf_dir).where("r IS NOT NULL"), ["r"], by="asset")
    return own.select("asset", "date", _R("tail").alias("tail"))


def _detector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Rows with all features, a label and their part, as a written table (fits and scores read it again), and the features."""
    columns = list(FEATURES)
    own = warning.warning_features(_wide(spark, sf_dir), PRICES, RATES, LEVELS, "panel", "hour")
    own = tables.overwrite(own.select("panel", "hour", "p0_r", *columns), tables.scratch(spark, "features")).na.drop(subset=columns)
    far = F.abs("p0_r") > F.percentile(F.abs("p0_r"), 0.9).over(Window.partitionBy("panel"))
    dealt = panel.chronological(own.withColumn("label", far.cast("int")), ["panel"], "hour", [("train", 0.6), ("valid", 0.2), ("test", 0.2)])
    return tables.overwrite(dealt, tables.scratch(spark, "detector")), columns


@query()
def warning_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector fitted on normal training rows: AUC by part."""
    own, columns = _detector(spark, sf_dir)
    forest = warning.isolation_forest(own.where("part = 'train' AND label = 0"), columns, trees=50)
    return metrics.roc_auc(warning.forest_scores(own, columns, forest), "label", "anomaly", "part")


@query()
def warning_forest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best F2 threshold of the detector on validation rows."""
    own, columns = _detector(spark, sf_dir)
    forest = warning.isolation_forest(own.where("part = 'train' AND label = 0"), columns, trees=50)
    return metrics.best_threshold(metrics.sweep(warning.forest_scores(own.where("part = 'valid'"), columns, forest), "label", "anomaly"))


@query()
def warning_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance of the detector's features."""
    own, columns = _detector(spark, sf_dir)
    forest = warning.isolation_forest(own.where("part = 'train' AND label = 0"), columns, trees=30)
    return warning.permutation_importance(own.where("part <> 'train'"), columns, forest, "label", repeats=2)


@query()
def warning_forest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of all percentiles for a grid of forests: the ten best by F2 on validation rows."""
    own, columns = _detector(spark, sf_dir)
    percents = [100 - p / 2 for p in range(70, 1, -1)]  # alerts from 1 to 35 in a hundred, by halves
    grid = warning.forest_grid(own, columns, "label", [100, 200, 300], [128, 256, 512], [0.5, 0.7, 1.0], percents)
    return grid.orderBy(F.desc("f2"), F.desc("recall"), F.desc("precision"), "trees", "sample", "share", "percent").limit(10)


@query()
def warning_refit_on_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by part of detectors refitted on the most important features only."""
    own, columns = _detector(spark, sf_dir)
    forest = warning.isolation_forest(own.where("part = 'train' AND label = 0"), columns, trees=30)
    importance = warning.permutation_importance(own.where("part = 'valid'"), columns, forest, "label", repeats=2)
    return warning.refit_on_top(own, columns, "label", importance, [5, 10, 20])
