"""Panels of time series: returns, rolling and cumulative windows, alignment.

A panel is long: a key (asset, scenario), a date, values. Every window is partitioned by the key and ordered by the
date, so that panels spread over tasks; frames of one key and order share a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marlstone.functions import expr as E


class Roll:
    """Windows of a panel: `by` is the key, `order` the date."""

    def __init__(self, by: str | list[str], order: str = "date"):
        self.base = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)

    def last(self, k: int) -> WindowSpec:
        """The row and the k - 1 before it."""
        return self.base.rowsBetween(-(k - 1), 0)

    def before(self, k: int) -> WindowSpec:
        """The k rows before the row, without it: what may be known at its time."""
        return self.base.rowsBetween(-k, -1)

    def ahead(self, k: int) -> WindowSpec:
        """The row and the k - 1 after it."""
        return self.base.rowsBetween(0, k - 1)

    @property
    def sofar(self) -> WindowSpec:
        return self.base.rowsBetween(Window.unboundedPreceding, 0)

    def simple_return(self, c: str) -> Column:
        return E.ratio(c, F.lag(c).over(self.base)) - 1

    def log_return(self, c: str) -> Column:
        return F.when((F.col(c) > 0) & (F.lag(c).over(self.base) > 0), F.ln(F.col(c) / F.lag(c).over(self.base)))

    def difference(self, c: str, k: int = 1) -> Column:
        return F.col(c) - F.lag(c, k).over(self.base)

    def std(self, c: str, k: int) -> Column:
        return E.guarded(F.stddev_samp(c).over(self.last(k)), c, self.last(k), k)

    def sum(self, c: str, k: int) -> Column:
        return E.guarded(F.sum(c).over(self.last(k)), c, self.last(k), k)

    def mean(self, c: str, k: int) -> Column:
        return E.guarded(F.avg(c).over(self.last(k)), c, self.last(k), k)

    def drawdown(self, c: str, k: int) -> Column:
        return E.guarded(E.ratio(c, F.max(c).over(self.last(k))) - 1, c, self.last(k), k)

    def compound(self, c: str, k: int) -> Column:
        """Compounded return of the last k rows."""
        return E.guarded(F.product(1 + F.col(c)).over(self.last(k)) - 1, c, self.last(k), k)

    def corr(self, a: str, b: str, k: int) -> Column:
        frame = self.last(k)
        x, y = F.col(a), F.col(b)
        value = F.try_divide(F.covar_pop(x, y).over(frame), F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame))
        return F.when(F.count(F.when(y.isNotNull(), x)).over(frame) == k, value)

    def quantile(self, c: str, k: int, q: float) -> Column:
        """Linearly interpolated quantile of the k rows before."""
        return F.when(F.count(c).over(self.before(k)) == k, F.percentile(c, q).over(self.before(k)))

    def wealth(self, c: str) -> Column:
        return F.product(1 + F.col(c)).over(self.sofar)

    def running_max(self, c: str) -> Column:
        return F.max(c).over(self.sofar)

    def running_sum(self, c: str) -> Column:
        return F.sum(c).over(self.sofar)

    def filled(self, c: str) -> Column:
        """The last value that is not NULL."""
        return F.last(c, ignorenulls=True).over(self.sofar)

    def position(self) -> Column:
        """Place of the row, from 0."""
        return F.row_number().over(self.base) - 1


def log_panel(prices: DataFrame, by: str = "asset", value: str = "price") -> DataFrame:
    """Adds log returns as `r`."""
    return prices.withColumn("r", Roll(by).log_return(value))


def return_panel(prices: DataFrame, by: str = "asset", value: str = "price") -> DataFrame:
    """Adds simple returns as `r`, gaps not filled."""
    return prices.withColumn("r", Roll(by).simple_return(value))


def wide(long: DataFrame, key: str, values: list, value: str, prefix: str, by: str = "date") -> DataFrame:
    """One row per date, one column per key value; the values are given, so no pass looks for them."""
    picked = [F.max(F.when(F.col(key) == v, F.col(value))).alias(f"{prefix}{v}") for v in values]
    return long.groupBy(by).agg(*picked)


def as_of(calendar: DataFrame, sparse: DataFrame, by: list[str], values: list[str], order: str = "date") -> DataFrame:
    """Every calendar row with the values of the last sparse row at or before it: a union and one window."""
    n = [F.lit(None).cast(sparse.schema[v].dataType).alias(v) for v in values]
    rows = calendar.select(*by, order, *n, F.lit(1).alias("asked")).unionByName(sparse.select(*by, order, *values, F.lit(0).alias("asked")))
    held = Window.partitionBy(*by).orderBy(order, "asked").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*by, order, "asked", *(F.last(v, ignorenulls=True).over(held).alias(v) for v in values)).where("asked = 1").drop("asked")


def chronological(df: DataFrame, by: list[str], order: str, shares: list[tuple[str, float]]) -> DataFrame:
    """Adds `part`: rows in order are dealt by cumulative shares, rounded down."""
    along = Window.partitionBy(*by).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = F.row_number().over(along) - 1
    part, upto = F.lit(shares[-1][0]), 0.0
    bounds = []
    for name, share in shares[:-1]:
        upto += share
        bounds.append((name, upto))
    for name, b in reversed(bounds):
        part = F.when(at < F.floor(n * F.lit(b)), name).otherwise(part)
    return df.withColumn("part", part)


def keep_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in an order (give a descending order for the last)."""
    return df.withColumn("keep", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("keep = 1").drop("keep")


def change_days(weights: DataFrame, by: str, values: list[str], order: str = "date") -> DataFrame:
    """Rows in which the weights differ from the row before; the first always does."""
    along = Window.partitionBy(by).orderBy(order)
    moved = E.total(F.abs(F.col(v) - F.lag(v).over(along)) for v in values)
    return weights.withColumn("changed", F.coalesce(moved > 1e-12, F.lit(True)))


def forward_rows(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """Adds `ahead`, the values of the row and the k - 1 after it; rows without that many are dropped."""
    roll = Roll(by)
    return df.withColumn("ahead", F.collect_list(value).over(roll.ahead(k))).where(F.size("ahead") == k)


#: Ranges over which a global order is laid.
RANGES = 64


def value_range(df: DataFrame, c: str, ranges: int = RANGES) -> Column:
    """Range of a column's value, from 0, by cuts at about equal counts; equal values are in one range.

    Ranges take a global order apart: each is ordered by itself, and the counts of those before it are added.
    """
    cuts = df.agg(F.percentile_approx(c, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("cuts")).first().cuts or []
    held = F.array(*(F.lit(x) for x in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(held, lambda x: x < F.col(c)))


def product_name(a: str, b: str) -> str:
    """Column of the windowed sum of a * b."""
    return f"sum_{a}_{b}"


def windowed_moments(df: DataFrame, columns: list[str], k: int, by: str | list[str], order: str = "date") -> DataFrame:
    """Adds sum_<a> of every column and sum_<a>_<b> of every pair, a not after b, over the k rows before the row.

    Each is the difference of two running sums, so a window costs one addition a row whatever its width. NULL until
    there are k rows, and where one of them lacks a value.
    """
    roll = Roll(by, order)
    whole = E.total(F.col(c).isNotNull().cast("int") for c in columns) == len(columns)
    parts = {"rows": F.when(whole, 1).otherwise(0)} | {f"sum_{c}": F.col(c) for c in columns}
    parts |= {product_name(a, b): F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]}
    own = df.withColumns({f"run_{n}": F.sum(F.coalesce(e, F.lit(0))).over(roll.sofar) for n, e in parts.items()})

    def windowed(n: str) -> Column:
        return F.lag(f"run_{n}").over(roll.base) - F.coalesce(F.lag(f"run_{n}", k + 1).over(roll.base), F.lit(0))

    own = own.withColumns({n: windowed(n) for n in parts}).drop(*(f"run_{n}" for n in parts))
    full = F.col("rows") == k
    return own.withColumns({n: F.when(full, F.col(n)) for n in parts if n != "rows"}).drop("rows")


#: Rows of a range over which running totals are laid, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 50_000, 1000


def running_totals(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Adds run_<v>, the sum of v over the group's rows up to the row's place, and all_<v>, the group's whole sum.

    Rows differ in (by, order). The order of a group is cut into ranges of about equal counts; each is a partition of
    its own, and the sums of the ranges before it are added. Groups are few (settings, features), so that cuts and range sums
    are small tables; the rows are read twice, so give a written frame.
    """
    ranges = max(1, min(MOST_RANGES, -(-df.count() // RANGE_ROWS)))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = F.array_distinct(F.percentile_approx(order, steps, 100 * ranges)) if steps else F.array().cast("array<double>")
    held = df.groupBy(*by).agg(cuts.alias("cuts"))
    cut = df.join(F.broadcast(held), by) if by else df.crossJoin(F.broadcast(held))
    dealt = cut.withColumn("range", F.size(F.filter("cuts", lambda x: x < F.col(order)))).drop("cuts")
    part = dealt.groupBy(*by, "range").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    base = part.select(*by, "range", *(F.coalesce(F.sum(v).over(earlier), F.lit(0.0)).alias(f"base_{v}") for v in values), *(F.sum(v).over(whole).alias(f"all_{v}") for v in values))
    inside = Window.partitionBy(*by, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.join(F.broadcast(base), [*by, "range"])  # groups x MOST_RANGES rows
    return own.withColumns({f"run_{v}": F.col(f"base_{v}") + F.sum(v).over(inside) for v in values}).drop("range", *(f"base_{v}" for v in values))
