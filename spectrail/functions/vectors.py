"""Functions of array<double> columns that hold a spectrum, a composition or a feature vector in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def literal(values) -> Column:
    """An array literal of doubles; of arrays for a matrix."""
    return F.array(*(literal(v) if hasattr(v, "__len__") else F.lit(float(v)) for v in values))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is found once for a row. A column that a lambda merely names is put into it whole, with all that it is
    made of, and found anew for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(ZERO), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def matvec(matrix: Column, v: Column) -> Column:
    """Product of a matrix, an array of rows, and a vector."""
    return once(v, lambda own: F.transform(matrix, lambda row: dot(row, own)))


def scale(a: Column, by: Column | float) -> Column:
    if not isinstance(by, Column):
        return F.transform(a, lambda x: x * F.lit(float(by)))
    return once(by, lambda own: F.transform(a, lambda x: x * own))


def share(a: Column, whole: float = 100.0) -> Column:
    """Values as parts of their sum; nulls where the sum is 0."""
    return once(a, lambda own: once(total(own), lambda s: F.transform(own, lambda x: F.try_divide(x * F.lit(whole), s))))


def quotient(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def clip_below(a: Column, least: float) -> Column:
    """NaN and null count as too small."""
    return F.transform(a, lambda x: F.greatest(F.nanvl(F.coalesce(x, F.lit(least)), F.lit(least)), F.lit(least)))


def fill_nan(a: Column, value: float = 1e-14) -> Column:
    return F.transform(a, lambda x: F.nanvl(F.coalesce(x, F.lit(value)), F.lit(value)))


def mask(fixed: Column, free: Column) -> Column:
    """fixed where it isn't null, else free."""
    return F.zip_with(fixed, free, lambda x, y: F.coalesce(x, y))


def argmax(a: Column) -> Column:
    """Index from 0 of the largest value, the first of equals."""
    return F.array_position(a, F.array_max(a)) - 1


def argmin(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


def nearest(keys: Column, value: Column) -> Column:
    """Index from 0 of the key closest to value, the first of equals."""
    return argmin(once(value, lambda own: F.transform(keys, lambda k: F.abs(k - own))))


def below(keys: Column, value: Column) -> Column:
    """How many keys of a sorted array are below value, by halves."""
    n = F.size(keys)
    first = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        up = F.get(keys, mid) < value
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & up, mid + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~up, mid).otherwise(acc["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int")), first, half, lambda acc: acc["low"])


def filled(entries: Column, at: str, value: str, size: int, first: int = 0) -> Column:
    """An array of size values from an array of structs, by their places from `first` on; gaps are 0. Places outside are left
    away, and a place that occurs twice is an error. One walk over the entries, however many gaps there are."""
    last = first + size - 1
    own = F.array_sort(F.transform(F.filter(entries, lambda e: e[at].between(first, last)), lambda e: F.struct(e[at].cast("int").alias("at"), e[value].cast("double").alias("value"))))
    zeros = lambda n: F.array_repeat(F.lit(ZERO), n)
    twice = F.raise_error(F.lit("a place occurs twice")).cast("array<double>")

    def laid(found: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(found, i - 1)["at"]).otherwise(F.lit(first - 1))
        parts = F.transform(found, lambda e, i: F.when(e["at"] == before(i), twice).otherwise(F.concat(zeros(e["at"] - before(i) - 1), F.array(F.coalesce(e["value"], F.lit(ZERO))))))
        return F.concat(F.flatten(parts), zeros(F.lit(last) - before(F.size(found))))

    return F.get(F.transform(F.array(own), laid), 0)


def nearest_sorted(keys: Column, value: Column) -> Column:
    """Index from 0 of the key closest to value in a sorted array, the first of equals; null without keys or value."""
    i = below(keys, value)
    left, right = F.get(keys, i - 1), F.get(keys, i)
    down = F.coalesce(value - left <= right - value, left.isNotNull())
    return F.when(value.isNotNull() & (F.size(keys) > 0), F.when(down, below(keys, left)).otherwise(i))


# -- distances ---------------------------------------------------------------------------------------------------


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: int) -> Column:
    if not 1 <= p <= 10:
        raise ValueError("p must be from 1 to 10")
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def cosine(a: Column, b: Column) -> Column:
    """1 less the cosine; null where a vector is 0."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def hamming(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.when(x != y, F.lit(1.0)).otherwise(F.lit(ZERO))))


def jaccard(a: Column, b: Column) -> Column:
    """1 less the sum of minima over the sum of maxima; null where the latter is 0."""
    return F.lit(1.0) - F.try_divide(total(F.zip_with(a, b, lambda x, y: F.least(x, y))), total(F.zip_with(a, b, lambda x, y: F.greatest(x, y))))


def mahalanobis(a: Column, b: Column, inverse: Column) -> Column:
    """With the inverse of a covariance, an array of rows."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(dot(d, matvec(inverse, d)))


METRICS = {"euclidean": euclidean, "manhattan": manhattan, "minkowski": minkowski, "cosine": cosine, "chebyshev": chebyshev, "hamming": hamming, "jaccard": jaccard, "mahalanobis": mahalanobis}


def distance(metric: str, a: Column, b: Column, p: int = 3, inverse: Column | None = None) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric == "minkowski":
        return minkowski(a, b, p)
    if metric == "mahalanobis":
        if inverse is None:
            raise ValueError("mahalanobis needs the inverse of a covariance")
        return mahalanobis(a, b, inverse)
    return METRICS[metric](a, b)


# -- integration -------------------------------------------------------------------------------------------------


def _panels(y: Column, last: Column, area) -> Column:
    """Sum of area(i) over even i < last."""
    steps = F.when(last > 0, F.sequence(F.lit(0), last - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(ZERO), lambda acc, i: acc + area(i))


def simpson(y: Column, dx: float = 1.0) -> Column:
    """Composite Simpson rule at equal steps; 2 points by the trapezoid; an even number gets a three-point end."""
    n, at = F.size(y), lambda i: F.get(y, i)
    odd = _panels(y, n - 2, lambda i: at(i) + 4.0 * at(i + 1) + at(i + 2)) * (dx / 3.0)
    even = _panels(y, n - 3, lambda i: at(i) + 4.0 * at(i + 1) + at(i + 2)) * (dx / 3.0)
    even = even + (at(n - 1) * (5.0 / 12.0) + at(n - 2) * (2.0 / 3.0) - at(n - 3) * (1.0 / 12.0)) * dx
    few = F.raise_error(F.lit("an integral needs two points")).cast("double")
    return F.when(n < 2, few).when(n == 2, (at(n - 1) + at(n - 2)) * (0.5 * dx)).when(n % 2 == 1, odd).otherwise(even)


def simpson_at(y: Column, x: Column) -> Column:
    """Composite Simpson rule at the points x, which may be unevenly spaced."""
    n = F.size(y)
    at, step = lambda i: F.get(y, i), lambda i: F.get(x, i + 1) - F.get(x, i)

    def area(i: Column) -> Column:
        h0, h1 = step(i), step(i + 1)
        both = h0 + h1
        return both / 6.0 * (at(i) * (2.0 - h1 / h0) + at(i + 1) * (both * both / (h0 * h1)) + at(i + 2) * (2.0 - h0 / h1))

    h0, h1 = step(n - 3), step(n - 2)
    end = at(n - 1) * (2.0 * h1 * h1 + 3.0 * h0 * h1) / (6.0 * (h0 + h1)) + at(n - 2) * (h1 * h1 + 3.0 * h0 * h1) / (6.0 * h0) - at(n - 3) * h1 * h1 * h1 / (6.0 * h0 * (h0 + h1))
    few = F.raise_error(F.lit("an integral needs two points")).cast("double")
    return F.when(n < 2, few).when(n == 2, (at(n - 1) + at(n - 2)) * 0.5 * step(n - 2)).when(n % 2 == 1, _panels(y, n - 2, area)).otherwise(_panels(y, n - 3, area) + end)
