"""Column expressions shared by the operators. Undefined results are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

#: Strings that stand for a missing value: fixed values.
NULL_TOKENS = ("", " ", "NA", "N/A", "na", "n/a", "null", "None", "none", "-", "--")


def col(c: str | Column) -> Column:
    """A column by name or as it is."""
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def finite(c: str | Column) -> Column:
    """The number, NULL where it is infinite or not a number."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(c: str | Column) -> Column:
    """Text as a double, NULL where it is none."""
    return col(c).try_cast("double")


def blank_to_null(c: str | Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Text, NULL where it is one of the tokens for a missing value."""
    x = col(c)
    return F.when(~x.isin(*tokens), x)


def mapped(c: str | Column, values: Mapping) -> Column:
    """The value's label; a value without one stays as it is, as text."""
    x = col(c)
    table = F.create_map(*(F.lit(v) for pair in values.items() for v in pair))
    return F.coalesce(F.try_element_at(table, x), x.cast("string"))


def in_domain(c: str | Column, allowed: Iterable) -> Column:
    """The code, NULL where it is not allowed."""
    x = col(c)
    return F.when(x.isin(*allowed), x)


def guarded(value: Column, c: str | Column, frame: WindowSpec, k: int) -> Column:
    """A window value, NULL until its frame holds k values."""
    return F.when(F.count(col(c)).over(frame) == k, value)


def skew(c: str | Column) -> Column:
    """Bias-adjusted sample skewness; NULL below three values or without spread."""
    x = col(c)
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(c: str | Column) -> Column:
    """Bias-adjusted sample excess kurtosis; NULL below four values or without spread."""
    x = col(c)
    n = F.count(x).cast("double")
    return F.when((n > 3) & (F.var_pop(x) > 0), ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def jarque_bera(c: str | Column) -> Column:
    """n/6 (S^2 + K^2/4) with population skewness and excess kurtosis."""
    x = col(c)
    return F.when(F.var_pop(x) > 0, F.count(x) / 6.0 * (F.pow(F.skewness(x), 2) + F.pow(F.kurtosis(x), 2) / 4))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation, NULL where a side has no spread (there the built-in raises)."""
    x, y = col(a), col(b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def safe_beta(a: str | Column, b: str | Column) -> Column:
    """Slope of a on b, NULL where b has no spread."""
    x, y = col(a), col(b)
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_samp(F.when(both, x), F.when(both, y)), F.var_samp(F.when(both, y)))


def normal_quantile(p: float) -> float:
    """Standard normal quantile."""
    return NormalDist().inv_cdf(p)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm1(a: Column) -> Column:
    """Sum of absolute values of an array of doubles."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def scaled(a: Column, factor: Column) -> Column:
    """Array times a number."""
    return F.transform(a, lambda x: x * factor)


def total(columns: Iterable[Column]) -> Column:
    """Sum of columns."""
    return reduce(lambda a, b: a + b, columns)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded double; sums in another order then compare equal."""
    return F.round(col(c).cast(T.DoubleType()), digits)
