"""Classification and ranking metrics, threshold sweeps and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators.panel import value_range


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(E.ratio(a, b), F.lit(0.0))


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    """(1 + b^2) P R / (b^2 P + R), 0 where undefined."""
    return _share((1 + beta**2) * precision * recall, beta**2 * precision + recall)


def confusion(df: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """tp, fp, tn, fn by group."""
    yes, said = F.col(label) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(~yes & ~said).alias("tn"), F.count_if(yes & ~said).alias("fn"))


def scores(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    """Adds accuracy, precision, recall, f1, fbeta and fnr to confusion counts; a class that is absent gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    own = counts.withColumns({"accuracy": _share(tp + tn, tp + fp + tn + fn), "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "fnr": _share(fn, tp + fn)})
    return own.withColumns({"f1": fbeta(F.col("precision"), F.col("recall"), 1.0), "fbeta": fbeta(F.col("precision"), F.col("recall"), beta)})


def outcome(label: str, predicted: str) -> Column:
    """TP, TN, FP or FN of a row."""
    yes, said = F.col(label) == 1, F.col(predicted) == 1
    return F.when(yes & said, "TP").when(~yes & ~said, "TN").when(said, "FP").otherwise("FN")


def report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """name, precision, recall, f1, support: one row per class, and the macro and weighted means."""
    n = df.groupBy(F.col(label).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(label) == F.col(predicted)).alias("hit"))
    said = df.groupBy(F.col(predicted).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("said"))
    own = n.join(said, "name", "full").select("name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hit", "said")))
    p, r = _share(F.col("hit"), F.col("said")), _share(F.col("hit"), F.col("support"))
    each = own.select("name", p.alias("precision"), r.alias("recall"), fbeta(p, r, 1.0).alias("f1"), "support")
    values = ("precision", "recall", "f1")
    macro = each.agg(*(F.avg(c).alias(c) for c in values), F.sum("support").alias("support")).select(F.lit("macro avg").alias("name"), *values, "support")
    weighted = each.agg(*(E.ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in values), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted.select(F.lit("weighted avg").alias("name"), *values, "support"))


def score_groups(df: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """by, score, pos, neg and their counts at higher scores and in all: one row per distinct score.

    Equal scores are summed before the ordered window, which then sees distinct scores only. Without a group the
    order is laid over ranges of scores, each of which is ordered by itself.
    """
    each = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    if by:
        above = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        return each.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "n_pos": F.sum("pos").over(whole), "n_neg": F.sum("neg").over(whole)})
    ranged = each.withColumn("range", value_range(each, "score"))
    beyond = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    offsets = sums.select(  # a row for each range
        "range",
        *(F.coalesce(F.sum(c).over(beyond), F.lit(0)).alias(f"{c}_beyond") for c in "pq"),
        F.sum("p").over(Window.partitionBy()).alias("n_pos"),
        F.sum("q").over(Window.partitionBy()).alias("n_neg"),
    )
    above = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.join(F.broadcast(offsets), "range").withColumns({"tp": F.sum("pos").over(above) + F.col("p_beyond"), "fp": F.sum("neg").over(above) + F.col("q_beyond")})
    return own.drop("range", "p_beyond", "q_beyond")


def roc_auc(df: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """by, auc: how often a positive scores above a negative, ties counting half; NULL with one class only."""
    own = score_groups(df, label, score, *by)
    higher = (F.col("tp") - F.col("pos")) * F.col("neg") + 0.5 * F.col("pos") * F.col("neg")
    return own.groupBy(*by).agg(E.ratio(F.sum(higher), F.max(F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """score, fpr, tpr: one point per distinct score."""
    return score_groups(df, label, score, *by).select(*by, "score", E.ratio("fp", "n_neg").alias("fpr"), E.ratio("tp", "n_pos").alias("tpr"))


def average_precision(df: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """by, ap: sum of precision times the step in recall."""
    own = score_groups(df, label, score, *by)
    return own.groupBy(*by).agg(F.sum(E.ratio("pos", "n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def sweep(df: DataFrame, label: str, score: str, steps: int = 200, beta: float = 2.0) -> DataFrame:
    """step, threshold, precision, recall, fbeta for equal steps from the least to the greatest score; above is positive.

    Rows are counted by the step they pass before the cumulative sum, so the data are read once and not once a step.
    """
    ends = df.agg(F.min(score).alias("a"), F.max(score).alias("b"))
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    grid = grid.select("step", (F.col("a") + (F.col("b") - F.col("a")) * F.col("step") / (steps - 1)).alias("threshold"))
    cuts = grid.agg(F.array_sort(F.collect_list("threshold")).alias("cuts"))  # one row of `steps` numbers
    passed = F.size(F.filter("cuts", lambda t: t < F.col(score)))
    counts = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(cuts)).groupBy(passed.alias("passed")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    every = grid.join(F.broadcast(counts), F.col("passed") > F.col("step"), "left").groupBy("step", "threshold").agg(F.sum("pos").alias("tp"), F.sum("n").alias("said"))
    total = counts.agg(F.sum("pos").alias("all_pos"))
    own = every.crossJoin(F.broadcast(total)).select("step", "threshold", _share(F.coalesce("tp", F.lit(0)), F.col("said")).alias("precision"), _share(F.coalesce("tp", F.lit(0)), F.col("all_pos")).alias("recall"))
    return own.withColumn("fbeta", fbeta(F.col("precision"), F.col("recall"), beta))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The step of the best fbeta, the first on ties."""
    return swept.orderBy(F.desc("fbeta"), "step").limit(1)


def traffic_light(score: Column, amber: Column, red: Column) -> Column:
    """red above its bound, else amber above its own, else green."""
    return F.when(score > red, "red").when(score > amber, "amber").otherwise("green")


def top_k(df: DataFrame, user: str, item: str, score: str, k: int) -> DataFrame:
    """The k best items of each user, ties by item, with their rank."""
    best = Window.partitionBy(user).orderBy(F.desc(score), item)
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranking_metrics(truth: DataFrame, predicted: DataFrame, user: str, item: str, k: int) -> DataFrame:
    """user, n, precision, recall, ndcg at k; truth has column rel, predicted column score, on the same pairs.

    k is at most the number of a user's items, so precision and recall are equal by construction.
    """
    both = truth.join(predicted, [user, item])
    ideal, ranked = Window.partitionBy(user).orderBy(F.desc("rel"), item), Window.partitionBy(user).orderBy(F.desc("score"), item)
    own = both.withColumns({"best": F.row_number().over(ideal), "rank": F.row_number().over(ranked), "n": F.count(F.lit(1)).over(Window.partitionBy(user))})
    reach = F.least(F.col("n"), F.lit(k))
    gain = F.pow(F.lit(2.0), "rel") - 1
    one = own.groupBy(user, "n").agg(
        F.count_if((F.col("best") <= reach) & (F.col("rank") <= reach)).alias("hits"),
        F.sum(F.when(F.col("rank") <= reach, gain / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.sum(F.when(F.col("best") <= reach, gain / F.log2(F.col("best") + 1.0))).alias("ideal"),
    )
    share = F.col("hits") / F.least(F.col("n"), F.lit(k))
    return one.select(user, "n", share.alias("precision"), share.alias("recall"), E.ratio("dcg", "ideal").alias("ndcg"))
