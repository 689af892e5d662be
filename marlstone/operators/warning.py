"""Early warning: features, tail scores, isolation forests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators.panel import Roll, value_range

#: Frame lengths of volatility, momentum and drawdown, and of rate and level changes: fixed values.
VOL, MOMENTUM, DRAWDOWN, CORR = (4, 12, 26), (4, 12, 26), (26, 52), (12, 26)
CHANGES = (4, 12)


def price_features(c: str, r: str, roll: Roll) -> dict[str, Column]:
    """Volatility and momentum of returns, drawdown of prices."""
    return (
        {f"{c}_vol{k}": roll.std(r, k) for k in VOL}
        | {f"{c}_mom{k}": roll.sum(r, k) for k in MOMENTUM}
        | {f"{c}_dd{k}": roll.drawdown(c, k) for k in DRAWDOWN}
    )


def rate_features(c: str, roll: Roll) -> dict[str, Column]:
    """Changes over 4 and 12 rows."""
    return {f"{c}_d{k}": roll.difference(c, k) for k in CHANGES}


def level_features(c: str, roll: Roll) -> dict[str, Column]:
    """Changes over 1, 4 and 12 rows and the spread over 12 and 26."""
    return {f"{c}_d{k}": roll.difference(c, k) for k in (1, *CHANGES)} | {f"{c}_vol{k}": roll.std(c, k) for k in (12, 26)}


def correlation_features(r: str, reference: str, roll: Roll) -> dict[str, Column]:
    """Rolling correlations with a reference return."""
    return {f"{r}_corr{k}": roll.corr(r, reference, k) for k in CORR}


def warning_features(wide: DataFrame, prices: list[str], rates: list[str], levels: list[str], by: str, order: str = "date") -> DataFrame:
    """All features in one projection over one window order, and base returns and changes; infinities are NULL."""
    roll = Roll(by, order)
    base = wide.withColumns({f"{p}_r": roll.log_return(p) for p in prices} | {f"{r}_d": roll.difference(r) for r in rates})
    made: dict[str, Column] = {}
    for p in prices:
        made |= price_features(p, f"{p}_r", roll)
    for r in rates:
        made |= rate_features(r, roll)
    for level in levels:
        made |= level_features(level, roll)
    for p in prices[1:]:
        made |= correlation_features(f"{p}_r", f"{prices[0]}_r", roll)
    return base.withColumns(made).withColumns({c: E.finite(c) for c in made})


def tail_scores(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Adds tail: the mean over columns of minus the log of the smaller tail probability of the empirical distribution.

    Without a key the order of a column is laid over ranges of its values, so that no task sorts all rows.
    """
    out = df
    if by:
        for c in columns:
            up = F.cume_dist().over(Window.partitionBy(by).orderBy(c))
            down = F.cume_dist().over(Window.partitionBy(by).orderBy(F.desc(c)))
            out = out.withColumn(f"{c}_tail", -F.ln(F.least(up, down)))
    else:
        for c in columns:
            out = in_ranges(out, c).withColumn(f"{c}_tail", -F.ln(F.least("up", "down"))).drop("up", "down")
    return out.withColumn("tail", E.total(F.col(f"{c}_tail") for c in columns) / len(columns))


def held_out_tails(df: DataFrame, columns: list[str], fitted: str, by: str) -> DataFrame:
    """Adds tail as tail_scores does, but from the distribution of the rows marked by the column `fitted` alone.

    Every probability is (rows at or beyond + 1) over (rows + 1), so what lies outside all fitted rows has one too.
    """
    out = df.withColumn("_fit", F.col(fitted).cast("int"))
    n = F.sum("_fit").over(Window.partitionBy(by))
    for c in columns:
        low, high = (F.sum("_fit").over(Window.partitionBy(by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)) for order in (F.asc(c), F.desc(c)))
        out = out.withColumn(f"{c}_tail", -F.ln(F.least(low + 1, high + 1) / (n + 1)))
    return out.withColumn("tail", E.total(F.col(f"{c}_tail") for c in columns) / len(columns)).drop("_fit")


def in_ranges(df: DataFrame, c: str) -> DataFrame:
    """Adds up and down: the shares of rows with a value of c at most, and at least, as large; NULL where c is."""
    cut = df.withColumn("_range", value_range(df, c))
    sizes = cut.where(F.col(c).isNotNull()).groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))  # a row for each range
    held = cut.join(F.broadcast(sizes), "_range", "left")
    low = F.cume_dist().over(Window.partitionBy("_range").orderBy(c)) * F.col("_n")
    high = F.cume_dist().over(Window.partitionBy("_range").orderBy(F.desc(c))) * F.col("_n")
    known = F.col(c).isNotNull()
    up = F.when(known, (F.col("_before") + F.round(low)) / F.col("_all"))
    down = F.when(known, (F.col("_all") - F.col("_before") - F.col("_n") + F.round(high)) / F.col("_all"))
    return held.withColumns({"up": up, "down": down}).drop("_range", "_n", "_before", "_all")


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list:
    if depth == 0 or len(x) <= 1 or (np.ptp(x, axis=0) == 0).all():
        return [len(x)]
    j = rng.choice(np.flatnonzero(np.ptp(x, axis=0) > 0))
    cut = rng.uniform(x[:, j].min(), x[:, j].max())
    left = x[:, j] < cut
    return [int(j), float(cut), _grow(x[left], rng, depth - 1), _grow(x[~left], rng, depth - 1)]


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _paths(tree: list, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _expected(tree[0]))
    left = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _paths(tree[2], x[left], depth + 1), _paths(tree[3], x[~left], depth + 1)
    return out


def _picked(train: DataFrame, columns: list[str], n: int, seed: int) -> np.ndarray:
    """At most n rows, picked by a hash, whatever the size of the frame."""
    return train.na.drop(subset=columns).orderBy(F.xxhash64(F.lit(seed), *columns)).limit(n).select(*columns).toPandas().to_numpy(float)


def _grown(picked: np.ndarray, trees: int, sample: int, seed: int) -> list:
    """Trees, each on its own sample of the rows."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(sample, 2)))
    return [_grow(picked[rng.choice(len(picked), min(sample, len(picked)), replace=False)], rng, limit) for _ in range(trees)] if len(picked) else []


def isolation_forest(train: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> list:
    """Trees, each grown on its own sample of `sample` rows of the training frame.

    The driver gets trees x sample rows at most, picked by a hash, whatever the size of the frame.
    """
    return _grown(_picked(train, columns, trees * sample, seed), trees, sample, seed)


def forest_scores(df: DataFrame, columns: list[str], forest: list, sample: int = 256) -> DataFrame:
    """Adds anomaly: 2 to the minus of the mean path over its expectation; higher is more abnormal."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in values])
        trees = held.value
        mean = np.mean([_paths(t, x) for t in trees], axis=0) if trees else np.zeros(len(x))
        return pd.Series(2.0 ** (-mean / max(_expected(sample), 1e-12)))

    return df.withColumn("anomaly", score(*columns))


def permutation_importance(df: DataFrame, columns: list[str], forest: list, label: str, repeats: int = 5, buckets: int = 8) -> DataFrame:
    """name, mean, std: the fall of AUC when a column's values are dealt anew, over repeats; one job for all.

    A row is given once for each column and repeat, and once as it is; the one value that changes goes to another row
    of a bucket, which a hash deals out.
    """
    from marlstone.operators.metrics import roc_auc

    runs = [("", 0), *((c, k) for c in columns for k in range(repeats))]
    grid = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(k).alias("k")) for c, k in runs))
    every = df.select(label, *columns, F.explode(grid).alias("g")).select("g.name", "g.k", label, *columns)
    at = Window.partitionBy("name", "k", F.pmod(F.xxhash64("k", *columns), F.lit(buckets)))
    along = at.orderBy(F.xxhash64(F.col("k") + 1, *columns))
    own = every.withColumn("own", F.coalesce(*(F.when(F.col("name") == c, F.col(c)) for c in columns)))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = own.withColumn("dealt", F.coalesce(F.lead("own").over(along), F.first("own").over(whole)))
    dealt = dealt.select("name", "k", label, *(F.when(F.col("name") == c, F.col("dealt")).otherwise(F.col(c)).alias(c) for c in columns))
    auc = roc_auc(forest_scores(dealt, columns, forest), label, "anomaly", "name", "k")
    base = auc.where("name = ''").select(F.coalesce("auc", F.lit(0.0)).alias("base"))
    falls = auc.where("name <> ''").crossJoin(F.broadcast(base))  # one row
    return falls.groupBy("name").agg(F.avg(F.col("base") - F.col("auc")).alias("mean"), F.stddev_pop(F.col("base") - F.col("auc")).alias("std"))


def _drawn(picked: np.ndarray, trees: int, sample: int, share: float, seed: int) -> list:
    """Trees on samples of the rows, each on its own draw of that share of the columns."""
    rng, d = np.random.default_rng(seed), picked.shape[1]
    limit, width = math.ceil(math.log2(max(sample, 2))), max(1, round(share * picked.shape[1]))

    def placed(tree: list, columns: np.ndarray) -> list:
        return tree if len(tree) == 1 else [int(columns[tree[0]]), tree[1], placed(tree[2], columns), placed(tree[3], columns)]

    out = []
    for _ in range(trees if len(picked) else 0):
        columns = np.sort(rng.choice(d, width, replace=False))
        rows = picked[rng.choice(len(picked), min(sample, len(picked)), replace=False)]
        out.append(placed(_grow(rows[:, columns], rng, limit), columns))
    return out


def forest_grid(df: DataFrame, columns: list[str], label: str, trees: list[int], samples: list[int], shares: list[float], percents: list[float], part: str = "part") -> DataFrame:
    """trees, sample, share, percent, precision, recall, f2: forests over a grid of settings and thresholds.

    A forest is fitted on the normal rows of part 'train'; each of its trees draws that share of the columns. Forests of one
    sample and share are the first trees of the largest. Thresholds are percentiles (ascending) of the scores of
    part 'valid', where they are judged, too: a row at or above one is an alert. All forests score a row in one pass,
    and rows are counted by the thresholds that they pass before anything is summed up.
    """
    settings = [(t, n, q) for n in samples for q in shares for t in sorted(trees)]
    picked = _picked(df.where((F.col(part) == "train") & (F.col(label) == 0)), columns, max(trees) * max(samples), 42)
    held = [(_drawn(picked, max(trees), n, q, 42), n) for n in samples for q in shares]
    forests, counts = df.sparkSession.sparkContext.broadcast(held), sorted(trees)

    @F.pandas_udf("array<double>")
    def score(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in values])
        every = []
        for forest, n in forests.value:
            total = np.zeros(len(x))
            for i, tree in enumerate(forest, 1):
                total = total + _paths(tree, x)
                if i in counts:
                    every.append(2.0 ** (-total / i / max(_expected(n), 1e-12)))
            if not forest:
                every += [np.ones(len(x))] * len(counts)
        return pd.Series(list(np.array(every).T))

    scored = df.where(F.col(part) == "valid").select(label, score(*columns).alias("s")).select(label, F.posexplode("s").alias("setting", "score"))
    cuts = scored.groupBy("setting").agg(F.percentile("score", [p / 100 for p in percents]).alias("cuts"))
    passed = F.size(F.filter("cuts", lambda c: c <= F.col("score")))
    judged = scored.join(F.broadcast(cuts), "setting")  # one row for each setting
    counts_of = judged.groupBy("setting", passed.alias("passed")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("percent")) for i, p in enumerate(percents)))
    every = counts_of.select("*", F.explode(steps).alias("x")).groupBy("setting", "x.percent").agg(
        F.sum(F.when(F.col("passed") > F.col("x.i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("passed") > F.col("x.i"), F.col("n")).otherwise(0)).alias("said"), F.sum("pos").alias("all")
    )
    names = F.array(*(F.struct(F.lit(t).alias("trees"), F.lit(n).alias("sample"), F.lit(float(q)).alias("share")) for t, n, q in settings))
    p, r = F.coalesce(E.ratio("tp", "said"), F.lit(0.0)), F.coalesce(E.ratio("tp", "all"), F.lit(0.0))
    own = every.select(names[F.col("setting")].alias("s"), "percent", p.alias("precision"), r.alias("recall"))
    f2 = F.coalesce(E.ratio(5 * F.col("precision") * F.col("recall"), 4 * F.col("precision") + F.col("recall")), F.lit(0.0))
    return own.select("s.*", "percent", "precision", "recall", f2.alias("f2"))


def refit_on_top(df: DataFrame, columns: list[str], label: str, importance: DataFrame, ks: list[int], trees: int = 50, part: str = "part") -> DataFrame:
    """k, name of each feature kept, and auc by part of forests refitted on the k most important features."""
    from marlstone.operators.metrics import roc_auc

    ranked = [r.name for r in importance.orderBy(F.desc("mean"), "name").collect()]  # one row for each feature
    train = df.where((F.col(part) == "train") & (F.col(label) == 0))
    out = None
    for k in ks:
        kept = ranked[:k]
        scored = forest_scores(df, kept, isolation_forest(train, kept, trees)).select(label, part, "anomaly")
        one = roc_auc(scored, label, "anomaly", part).select(F.lit(k).alias("k"), F.lit(",".join(kept)).alias("features"), part, "auc")
        out = one if out is None else out.unionByName(one)
    return out


def mahalanobis(df: DataFrame, columns: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the mean of a frame (its own by default).

    Mean and covariance are one aggregation, one row; the inverse of its Cholesky factor whitens every row by plain
    column arithmetic. NULL where a column is NULL, or where the covariance is not positive definite.
    """
    fit = (df if fitted_on is None else fitted_on).na.drop(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = fit.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.array([[one[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))])
    try:
        lower = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        lower = np.zeros_like(cov)
    if (np.diag(lower) ** 2 <= 1e-12 * np.diag(cov)).any():
        return df.withColumn("d2", F.lit(None).cast("double"))
    white = np.linalg.inv(lower)
    gaps = [F.col(c) - F.lit(float(one[f"m{i}"])) for i, c in enumerate(columns)]
    whitened = [E.total(gaps[j] * F.lit(float(white[i, j])) for j in range(i + 1)) for i in range(len(columns))]
    return df.withColumn("d2", E.total(F.pow(z, 2) for z in whitened))
