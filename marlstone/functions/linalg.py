"""Vectors and matrices as array columns: expressions that run in the JVM, row by row.

A vector is array<double>, a matrix array<array<double>> by rows. Give matrices as columns (attributes) where they are
read many times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import expr as E


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; inside lambdas nothing else shares common parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first(a: Column, n: Column) -> Column:
    """The first n elements; none for n = 0."""
    return F.slice(a, 1, n)


def at(a: Column, *places) -> Column:
    """Element of a vector, or of a matrix by row and column; places from 0."""
    for p in places:
        a = F.get(a, p if isinstance(p, Column) else F.lit(p))
    return a


def plus(a: Column, b: Column) -> Column:
    """Sum of two vectors."""
    return F.zip_with(a, b, lambda x, y: x + y)


def blend(a: Column, b: Column, share) -> Column:
    """(1 - share) * a + share * b."""
    return F.zip_with(a, b, lambda x, y: (1 - share) * x + share * y)


def times(m: Column, v: Column) -> Column:
    """Matrix times vector."""
    return F.transform(m, lambda row: E.dot(row, v))


def quadratic(m: Column, v: Column) -> Column:
    """v' m v."""
    return E.dot(times(m, v), v)


def with_diagonal(m: Column, add) -> Column:
    """The matrix with a number added to its diagonal."""
    return F.transform(m, lambda row, i: F.transform(row, lambda x, j: F.when(i == j, x + add).otherwise(x)))


def diagonal(n: int, value) -> Column:
    """n x n matrix with the value on the diagonal."""
    places = F.array(*(F.lit(i) for i in range(n)))
    return F.transform(places, lambda i: F.transform(places, lambda j: F.when(i == j, value).otherwise(F.lit(0.0)).cast("double")))


def symmetric(entry: Callable[[int, int], Column], n: int) -> Column:
    """n x n matrix of entry(i, j) for i <= j."""
    return F.array(*(F.array(*(entry(min(i, j), max(i, j)) for j in range(n))) for i in range(n)))


_ROWS, _VECTOR = "array<array<double>>", "array<double>"


def cholesky(m: Column, n: int) -> Column:
    """Lower triangle L with L L' = m, row i with i + 1 elements; NULL or NaN entries where m is not positive definite."""
    places = F.array(*(F.lit(i) for i in range(n)))

    def row(rows: Column, i: Column) -> Column:
        def entry(own: Column, j: Column) -> Column:
            above = at(rows, j)
            return F.concat(own, F.array((at(m, i, j) - E.dot(own, first(above, j))) / at(above, j)))

        left = F.aggregate(first(places, i), F.array().cast(_VECTOR), entry)
        return let(left, lambda own: F.concat(own, F.array(F.sqrt(at(m, i, i) - E.dot(own, own)))))

    return F.aggregate(places, F.array().cast(_ROWS), lambda rows, i: F.concat(rows, F.array(row(rows, i))))


def forward(lower: Column, b: Column, n: int) -> Column:
    """x with lower x = b: for the lower triangle of a covariance it whitens b."""
    places = F.array(*(F.lit(i) for i in range(n)))

    def step(x: Column, i: Column) -> Column:
        row = at(lower, i)
        return F.concat(x, F.array((at(b, i) - E.dot(x, first(row, i))) / at(row, i)))

    return F.aggregate(places, F.array().cast(_VECTOR), step)


def backward(lower: Column, b: Column, n: int) -> Column:
    """x with lower' x = b."""
    places = F.array(*(F.lit(i) for i in range(n - 1, -1, -1)))

    def step(x: Column, i: Column) -> Column:
        column = F.transform(F.slice(lower, i + 2, n - 1 - i), lambda row: at(row, i))
        return F.concat(F.array((at(b, i) - E.dot(column, x)) / at(lower, i, i)), x)

    return F.aggregate(places, F.array().cast(_VECTOR), step)


def solved(m: Column, b: Column, n: int) -> Column:
    """x with m x = b for a positive definite matrix."""
    return let(cholesky(m, n), lambda lower: let(forward(lower, b, n), lambda y: backward(lower, y, n)))
