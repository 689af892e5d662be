"""Distribution statistics, association, outliers and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import expr as E


def long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """keep, name, value: one row per value of the columns."""
    parts = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keep, F.explode(parts).alias("x")).select(*keep, "x.name", "x.value")


#: Rows of a range of values that is ordered as one, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 50_000, 1000


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, q: exact, linearly interpolated quantiles of each group as an array; groups are few (columns, say).

    By selection: values are counted in ranges of about equal counts, and only the ranges that hold a wanted rank are
    ordered, by their distinct values with counts. So no task holds a column, and a value that fills a third of the rows is
    one row. The rows are read three times. NULL counts for nothing; a group without values is missing.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    ranges = max(1, min(MOST_RANGES, -(-own.count() // RANGE_ROWS)))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = F.array_distinct(F.percentile_approx("v", steps, 100 * ranges)) if steps else F.array().cast("array<double>")
    held = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts"))
    dealt = own.join(F.broadcast(held.select(*by, "cuts")), by).select(*by, "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("range"))

    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(shares))))
    ranks = held.select(*by, wanted.alias("w")).select(*by, "w.i", "w.at", F.explode(F.array(F.floor("w.at"), F.ceil("w.at"))).alias("rank")).distinct()
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("in")).withColumn("base", F.coalesce(F.sum("in").over(before), F.lit(0)))  # MOST_RANGES rows a group
    asked = ranks.join(counts, by).where((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("in")))
    asked = asked.select(*by, "range", "base", "i", "at", "rank")

    inside = dealt.join(F.broadcast(asked.select(*by, "range").distinct()), [*by, "range"])  # two ranges a share
    each = inside.groupBy(*by, "range", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy(*by, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("upto", F.sum("m").over(upto)).join(F.broadcast(asked), [*by, "range"])
    found = placed.where((F.col("rank") >= F.col("base") + F.col("upto") - F.col("m")) & (F.col("rank") < F.col("base") + F.col("upto")))
    low, high = (F.max(F.when(F.col("rank") == f("at"), F.col("v"))) for f in (F.floor, F.ceil))
    one = found.groupBy(*by, "i").agg(low.alias("low"), high.alias("high"), F.first("at").alias("at"))
    q = F.col("low") + (F.col("at") - F.floor("at")) * (F.col("high") - F.col("low"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("q"))  # a few shares


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, spread, extremes, exact quartiles, shape."""
    v, rows = F.col("value"), long(df, columns)
    own = rows.groupBy("name").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        E.skew(v).alias("skew"),
        E.kurt(v).alias("kurt"),
        F.when(F.var_pop(v) > 0, F.skewness(v)).alias("skew_pop"),
        E.jarque_bera(v).alias("jb"),
    )
    own = own.join(F.broadcast(quantiles(rows, ["name"], "value", [0.25, 0.5, 0.75])), "name", "left")  # a row per column
    own = own.withColumns({f"q{p}": F.get("q", F.lit(i)) for i, p in enumerate((25, 50, 75))}).drop("q")
    return own.withColumns({"iqr": F.col("q75") - F.col("q25"), "cv": E.ratio("std", "mean"), "jb_p": F.exp(-F.col("jb") / 2)})


def tukey_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """name, low, high, n_outliers: values beyond k interquartile ranges from the quartiles."""
    rows = long(df, columns)
    q = quantiles(rows, ["name"], "value", [0.25, 0.75])
    q = q.select("name", (F.col("q")[0] - k * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    joined = rows.join(F.broadcast(q), "name")  # one row per column
    return joined.groupBy("name", "low", "high").agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("n_outliers"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, n_null, share: one pass over the frame."""
    columns = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    parts = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n_null")) for c in columns))
    return one.select("n", F.explode(parts).alias("x")).select("x.name", "x.n_null", E.ratio("x.n_null", "n").alias("share"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: all pairs of columns, a before b, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(E.safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    parts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(columns.index(a)).alias("i"), F.lit(columns.index(b)).alias("j"), F.col(f"c{n}").alias("r")) for n, (a, b) in enumerate(pairs)))
    return one.select(F.explode(parts).alias("x")).select("x.*")


def strong_pairs(df: DataFrame, columns: list[str], least: float, inclusive: bool = False) -> DataFrame:
    """Pairs whose absolute correlation passes a bound, with the sign as a word."""
    size = F.abs("r")
    own = correlations(df, columns).where(size >= least if inclusive else size > least)
    return own.withColumn("sign", F.when(F.col("r") > 0, "positive").otherwise("negative"))


def correlations_with(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """name, r: each column's correlation with a target."""
    one = df.agg(*(E.safe_corr(c, target).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("r")) for c in columns))).alias("x")).select("x.*")


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, cov: sample covariances of all pairs, a not after b."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def shares(df: DataFrame, column: str) -> DataFrame:
    """column, n, share: frequencies."""
    own = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per value


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """a, n_<value> and pct_<value> (of the row) for each value of b."""
    counts = df.groupBy(a).agg(*(F.count_if(F.col(b) == v).alias(f"n_{v}") for v in values))
    row = E.total(F.col(f"n_{v}") for v in values)
    return counts.withColumns({f"pct_{v}": E.ratio(F.col(f"n_{v}") * 100.0, row) for v in values})


def chi_square(df: DataFrame, a: str, b: str, yates: bool | None = None) -> DataFrame:
    """statistic, dof and p of independence; two by two tables are corrected unless told otherwise."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    full = rows.crossJoin(F.broadcast(cols)).join(cells, [a, b], "left").withColumn("o", F.coalesce("o", F.lit(0)))  # one row per cell
    every = full.withColumn("e", F.col("ra") * F.col("cb") / F.sum("o").over(Window.partitionBy()))
    gap = F.abs(F.col("o") - F.col("e"))
    kept = every.agg(
        F.sum(F.pow(gap, 2) / F.col("e")).alias("plain"),
        F.sum(F.pow(gap - F.least(F.lit(0.5), gap), 2) / F.col("e")).alias("corrected"),
        F.count_distinct(a).alias("na"),
        F.count_distinct(b).alias("nb"),
    ).withColumn("dof", (F.col("na") - 1) * (F.col("nb") - 1))
    corrected = (F.col("na") == 2) & (F.col("nb") == 2) if yates is None else F.lit(yates)
    return kept.select(F.when(corrected, F.col("corrected")).otherwise(F.col("plain")).alias("statistic"), "dof").withColumn("p", chi_square_tail("statistic", "dof"))


def chi_square_tail(x: str, dof: str) -> Column:
    """Upper tail of the chi-square distribution for any whole number of degrees of freedom.

    A finite sum: of powers of x / 2 over factorials for even ones, of odd powers of its root over double factorials
    for odd ones, each term from the one before it.
    """
    half, n = F.col(x) / 2, F.col(dof)

    def series(first: Column, count: Column, ratio) -> Column:
        zero = F.struct(first.alias("term"), first.alias("sum"))

        def step(acc, i):
            term = acc["term"] * ratio(i)
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        more = F.when(count > 1, F.sequence(F.lit(1), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.when(count >= 1, F.aggregate(more, zero, step, lambda acc: acc["sum"])).otherwise(0.0)

    even = series(F.exp(-half), n / 2, lambda i: half / i)
    odd = erfc(F.sqrt(half)) + series(2 * F.exp(-half) * F.sqrt(half / math.pi), (n - 1) / 2, lambda i: 2 * half / (2 * i + 1))
    return F.when(n < 1, None).when(n % 2 == 0, even).otherwise(odd)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: its power series below 3, a continued fraction beyond."""
    near = 1 - 2 / math.sqrt(math.pi) * E.total(F.pow(x, 2 * n + 1) * ((-1) ** n / (math.factorial(n) * (2 * n + 1))) for n in range(60))
    far = x
    for n in range(40, 0, -1):
        far = x + F.lit(n / 2.0) / far
    return F.when(x < 3, near).otherwise(F.exp(-x * x) / (far * math.sqrt(math.pi)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), low, n: equal bins from least to most, the last one closed."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    own = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor(E.ratio(F.col(column) - F.col("a"), width)), F.lit(bins - 1))
    return own.groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.first(F.col("a")).alias("a"), F.first(width).alias("w"), F.count(F.lit(1)).alias("n")).select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), "n")


#: Values of a block for which all powers are worked out at once.
POWER_BLOCK = 2000


def power_search(df: DataFrame, column: str, steps: int = 200, least: float = 0.01, most: float = 1.0) -> DataFrame:
    """step, power, skew for powers of a column that is not negative: one pass for the whole curve.

    A task works out central moments of all powers block by block and hands on one row for each power. The values are
    dealt over all tasks first: they are few bytes each and much work.
    """
    powers = least + (most - least) * np.arange(steps) / (steps - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, m2, m3 = 0, np.zeros(steps), np.zeros(steps), np.zeros(steps)
        for batch in batches:
            values = batch["v"].to_numpy(float)
            for at in range(0, len(values), POWER_BLOCK):
                x = np.power(values[at : at + POWER_BLOCK], powers[:, None])
                k, own = x.shape[1], x.mean(axis=1)
                x -= own[:, None]
                square = x * x
                own2, own3 = square.sum(axis=1), (square * x).sum(axis=1)
                d, both = own - mean, n + k
                m3 = m3 + own3 + d**3 * n * k * (n - k) / both**2 + 3 * d * (n * own2 - k * m2) / both
                m2, mean, n = m2 + own2 + d**2 * n * k / both, mean + d * k / both, both
        if n:
            yield pd.DataFrame({"step": np.arange(steps), "n": float(n), "mean": mean, "m2": m2, "m3": m3})

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = df.where(F.col(column) >= 0).select(F.col(column).cast("double").alias("v")).repartition(tasks)
    parts = dealt.mapInPandas(run, "step int, n double, mean double, m2 double, m3 double")
    whole = parts.groupBy("step").agg(F.collect_list(F.struct("n", "mean", "m2", "m3")).alias("parts"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))  # a row a task
    about = F.transform("parts", lambda p: F.struct(p["n"].alias("n"), (p["mean"] - F.col("mean")).alias("d"), p["m2"].alias("m2"), p["m3"].alias("m3")))
    made = whole.select("step", "n", about.alias("parts"))

    def added(value) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + value(p))

    m2 = added(lambda p: p["m2"] + p["n"] * p["d"] * p["d"])
    m3 = added(lambda p: p["m3"] + 3 * p["d"] * p["m2"] + p["n"] * p["d"] * p["d"] * p["d"])
    own = made.select("step", "n", m2.alias("m2"), m3.alias("m3"))
    power = F.lit(least) + F.lit(most - least) * F.col("step") / (steps - 1)
    return own.select("step", power.alias("power"), F.when(F.col("m2") > 0, F.sqrt("n") * F.col("m3") / F.sqrt(F.col("m2") * F.col("m2") * F.col("m2"))).alias("skew"))


def qq_points(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Sorted values with their plotting positions; the normal quantile is left to the reader of the frame."""
    along = Window.partitionBy(*by).orderBy(column)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.where(F.col(column).isNotNull()).select(*by, F.row_number().over(along).alias("rank"), F.col(column).alias("value"), ((F.row_number().over(along) - 0.5) / n).alias("p"))


def near_zero_variance(df: DataFrame, columns: list[str], most_ratio: float = 20.0, most_unique: float = 0.1) -> DataFrame:
    """name, top_ratio, unique_share, zero, near_zero: how far a column is from constant."""
    counts = long_text(df, columns).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value")))
    own = ranked.groupBy("name").agg(F.max(F.when(F.col("k") == 1, F.col("n"))).alias("top"), F.max(F.when(F.col("k") == 2, F.col("n"))).alias("second"), F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"))
    own = own.withColumns({"top_ratio": E.ratio("top", "second"), "unique_share": F.col("u") / F.col("n"), "zero": F.col("u") <= 1})
    near = ~F.col("zero") & (F.col("top_ratio") >= most_ratio) & (F.col("unique_share") <= most_unique)
    return own.select("name", "top_ratio", "unique_share", "zero", near.alias("near_zero"))


def long_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value as text of values that are not NULL."""
    parts = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(parts).alias("x")).select("x.name", "x.value").where("value IS NOT NULL")


def kept_features(df: DataFrame, columns: list[str], most_corr: float = 0.95, least_var: float = 1e-5) -> DataFrame:
    """name, variance, kept: columns with variance above a bound that follow no earlier one too closely.

    A later column goes if any earlier one that varies correlates with it beyond the bound, even one that itself goes.
    """
    one = df.agg(*(F.var_pop(c).alias(c) for c in columns))
    variances = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(i).alias("i"), F.col(c).alias("variance")) for i, c in enumerate(columns)))).alias("x")).select("x.*")
    alive = variances.where(F.col("variance") > least_var).select("name")
    close = correlations(df, columns).where(F.abs("r") > most_corr)
    dropped = close.join(alive.withColumnRenamed("name", "a"), "a", "left_semi").select(F.col("b").alias("name")).distinct().withColumn("follows", F.lit(True))
    return variances.join(dropped, "name", "left").select("name", "variance", ((F.col("variance") > least_var) & F.col("follows").isNull()).alias("kept"))
