"""Queries on distributions, association and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import expr as E
from marlstone.operators import stats
from marlstone.plans import frames
from marlstone.plans.registry import query

NUMBERS = ["age", "income", "wealth", "risk"]
_R = E.rounded


def _union(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


_DESCRIBE = """SELECT '{c}' AS name, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS least, round(quantile_cont({c}, 0.25), 4) AS q25,
 round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS most, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(stddev_samp({c}) / avg({c}), 4) AS cv,
 round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurt FROM clients"""


@query(f"WITH {frames.CLIENTS} {_union(_DESCRIBE, NUMBERS)}")
def stats_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact description with bias-adjusted shape."""
    own = stats.describe(frames.clients(spark, sf_dir), NUMBERS)
    return own.select("name", "n", *(_R(c, 4).alias(c) for c in ("mean", "std", "least", "q25", "q50", "q75", "most", "iqr", "cv", "skew", "kurt")))


_JB = """SELECT '{c}' AS name, round(count({c}) / 6.0 * (power(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1)), 2) + power(kurtosis_pop({c}), 2) / 4), 3) AS jb FROM clients"""


@query(f"WITH {frames.CLIENTS} SELECT name, jb, exp(-jb / 2) > 0.05 AS normal FROM ({_union(_JB, NUMBERS)})")
def stats_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jarque-Bera statistic and verdict at 5 %."""
    own = stats.describe(frames.clients(spark, sf_dir), NUMBERS)
    return own.select("name", _R("jb", 3).alias("jb"), (F.col("jb_p") > 0.05).alias("normal"))


_TUKEY = """SELECT '{c}' AS name, round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high, CAST((SELECT count(*) FROM clients WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS BIGINT) AS n_outliers
 FROM (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM clients)"""


@query(f"WITH {frames.CLIENTS} {_union(_TUKEY, NUMBERS)}")
def stats_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tukey fences and outlier counts."""
    return stats.tukey_outliers(frames.clients(spark, sf_dir), NUMBERS).select("name", _R("low", 4).alias("low"), _R("high", 4).alias("high"), "n_outliers")


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(f"WITH {frames.CLIENTS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM clients" for a, b in _PAIRS))
def stats_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlations of all pairs."""
    return stats.correlations(frames.clients(spark, sf_dir), NUMBERS).select("a", "b", _R("r").alias("r"))


@query(f"WITH {frames.CLIENTS}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM clients" for a, b in _PAIRS) + ") SELECT a, b, round(r, 6) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM c WHERE abs(r) >= 0.01")
def stats_strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least a given absolute correlation."""
    return stats.strong_pairs(frames.clients(spark, sf_dir), NUMBERS, 0.01, inclusive=True).select("a", "b", _R("r").alias("r"), "sign")


@query(f"WITH {frames.REPLICATION} " + " UNION ALL ".join(f"SELECT '{n}' AS name, round(corr({n}, y), 6) AS r FROM rep" for n in frames.NAMES))
def stats_target_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each instrument's correlation with the target."""
    return stats.correlations_with(frames.replication(spark, sf_dir), frames.NAMES, "y").select("name", _R("r").alias("r"))


@query(f"WITH {frames.REPLICATION} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS cov FROM rep" for i, a in enumerate(frames.NAMES) for b in frames.NAMES[i:]))
def stats_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample covariance matrix of the instruments."""
    return stats.covariances(frames.replication(spark, sf_dir), frames.NAMES).select("a", "b", _R("cov").alias("cov"))


@query(f"WITH {frames.CLIENTS} SELECT segment, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM clients GROUP BY segment")
def stats_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies and shares of a category."""
    return stats.shares(frames.clients(spark, sf_dir), "segment").select("segment", "n", _R("share").alias("share"))


@query(f"""WITH {frames.CLIENTS} SELECT segment, CAST(count(*) FILTER (WHERE gender = 0) AS BIGINT) AS n_0, CAST(count(*) FILTER (WHERE gender = 1) AS BIGINT) AS n_1,
 round(100.0 * count(*) FILTER (WHERE gender = 0) / count(*), 4) AS pct_0, round(100.0 * count(*) FILTER (WHERE gender = 1) / count(*), 4) AS pct_1 FROM clients GROUP BY segment""")
def stats_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and row percentages of one category by another."""
    return stats.crosstab(frames.clients(spark, sf_dir), "segment", "gender", [0, 1]).select("segment", "n_0", "n_1", _R("pct_0", 4).alias("pct_0"), _R("pct_1", 4).alias("pct_1"))


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS o FROM labels GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c), ra AS (SELECT a, sum(o) AS s FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS s FROM c GROUP BY b),
 f AS (SELECT coalesce(o, 0) AS o, ra.s * cb.s / n.n AS e FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c ON c.a = ra.a AND c.b = cb.b)
 SELECT round(sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e), 6) AS statistic, CAST((SELECT (count(DISTINCT a) - 1) FROM ra) * (SELECT (count(DISTINCT b) - 1) FROM cb) AS BIGINT) AS dof FROM f""")
def stats_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected test of independence of two flags."""
    return stats.chi_square(frames.table(spark, sf_dir, "labels"), "quality", "toxic").select(_R("statistic").alias("statistic"), "dof")


@query(f"""WITH {frames.CLIENTS}, e AS (SELECT min(wealth) AS a, (max(wealth) - min(wealth)) / 30 AS w FROM clients), b AS (SELECT CAST(least(floor((wealth - a) / w), 29) AS INTEGER) AS bin, a, w FROM clients, e)
 SELECT bin, round(any_value(a) + bin * any_value(w), 4) AS low, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin""")
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty equal bins."""
    return stats.histogram(frames.clients(spark, sf_dir), "wealth", 30).select("bin", _R("low", 4).alias("low"), "n")


@query(f"""WITH {frames.CLIENTS}, p AS (SELECT i AS step, 0.01 + 0.99 * i / 199.0 AS power FROM range(200) t(i)),
 s AS (SELECT step, skewness(power(wealth, power::DOUBLE)) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) AS skew FROM clients CROSS JOIN p GROUP BY step) SELECT CAST(step AS INTEGER) AS step, round(skew, 4) AS skew FROM s""")
def stats_power_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness of 200 powers of a column, in one pass."""
    return stats.power_search(frames.clients(spark, sf_dir), "wealth").select("step", _R("skew", 4).alias("skew"))


_NZ = """SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM clients GROUP BY 2"""


@query(f"""WITH {frames.CLIENTS}, c AS ({_union(_NZ, ["gender", "family", "segment", "region"])}), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, v) AS k FROM c),
 a AS (SELECT name, max(n) FILTER (WHERE k = 1) AS t, max(n) FILTER (WHERE k = 2) AS s, count(*) AS u, sum(n) AS n FROM r GROUP BY name)
 SELECT name, round(t / s, 6) AS top_ratio, round(u / n, 6) AS unique_share, u <= 1 AS zero, u > 1 AND t / s >= 20 AND u / n <= 0.1 AS near_zero FROM a""")
def stats_near_zero_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far categories are from constant."""
    own = stats.near_zero_variance(frames.clients(spark, sf_dir), ["gender", "family", "segment", "region"])
    return own.select("name", _R("top_ratio").alias("top_ratio"), _R("unique_share").alias("unique_share"), "zero", "near_zero")


@query(f"""WITH {frames.RETURNS} SELECT 'price' AS name, CAST(count(*) FILTER (WHERE price IS NULL) AS BIGINT) AS n_null, round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM returns
 UNION ALL SELECT 'r', CAST(count(*) FILTER (WHERE r IS NULL) AS BIGINT), round(avg(CASE WHEN r IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM returns""")
def stats_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls by column."""
    return stats.null_profile(frames.returns(spark, sf_dir), ["price", "r"]).select("name", "n_null", _R("share").alias("share"))


@query(f"""WITH {frames.RETURNS} SELECT asset, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(stddev_samp(r) * sqrt(52), 6) AS annual, round(min(r), 6) AS least, round(max(r), 6) AS most, round(skewness(r), 4) AS skew, round(kurtosis(r), 4) AS kurt FROM returns GROUP BY asset""")
def stats_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-quality table of the returns by instrument."""
    own = frames.returns(spark, sf_dir).groupBy("asset").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), (F.stddev_samp("r") * F.sqrt(F.lit(52.0))).alias("annual"), F.min("r").alias("least"), F.max("r").alias("most"), E.skew("r").alias("skew"), E.kurt("r").alias("kurt"))
    return own.select("asset", *(_R(c).alias(c) for c in ("mean", "std", "annual", "least", "most")), *(_R(c, 4).alias(c) for c in ("skew", "kurt")))


@query(f"""WITH {frames.REPLICATION}, v AS ({_union("SELECT '{c}' AS name, var_pop({c}) AS variance FROM rep", frames.NAMES)}),
 c AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rep" for i, a in enumerate(frames.NAMES) for b in frames.NAMES[i + 1:])}),
 d AS (SELECT DISTINCT b FROM c JOIN v ON c.a = v.name WHERE abs(r) > 0.02 AND variance > 0.07)
 SELECT name, round(variance, 6) AS variance, variance > 0.07 AND name NOT IN (SELECT b FROM d) AS kept FROM v""")
def stats_feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance and correlation filter of features."""
    own = stats.kept_features(frames.replication(spark, sf_dir), frames.NAMES, most_corr=0.02, least_var=0.07)
    return own.select("name", _R("variance").alias("variance"), "kept")
