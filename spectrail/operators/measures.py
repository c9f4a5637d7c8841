"""Losses, penalties, norms and residuals. Each is a sum of what each pixel gives, so only sums cross the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lookups import small

Matrix = Sequence[Sequence[float]]


def model(d: Matrix, h: Column) -> Column:
    """D h of a pixel; D as rows of channels."""
    return V.matvec(V.literal(d), h)


def _sum(pixels: DataFrame, value: Column, name: str, average: bool, size: Column | None = None) -> DataFrame:
    if not average:
        return pixels.agg(F.sum(value).alias(name))
    return pixels.agg(F.try_divide(F.sum(value), F.sum(size)).alias(name))


def frobenius_loss(pixels: DataFrame, d: Matrix, average: bool = False, x: str = "spectrum", h: str = "h") -> DataFrame:
    diff = F.zip_with(model(d, F.col(h)), F.col(x), lambda a, b: (a - b) * (a - b))
    return _sum(pixels, V.total(diff), "loss", average, F.size(x))


def kl_loss(pixels: DataFrame, d: Matrix, floor: float = 1e-14, average: bool = False, constant: bool = False, x: str = "spectrum", h: str = "h") -> DataFrame:
    """Sum of D h - x ln(D h), all floored; with the constant x ln(x) - x if asked for."""
    up = lambda a: F.greatest(a, F.lit(floor))
    fit = V.matvec(V.literal([[max(v, floor) for v in row] for row in d]), F.transform(h, up))
    xs = F.transform(x, up)
    value = V.total(F.zip_with(fit, xs, lambda f, v: f - v * F.ln(f)))
    if constant:
        value = value + V.total(F.transform(xs, lambda v: v * F.ln(v) - v))
    return _sum(pixels, value, "loss", average, F.size(x))


def ridge(pixels: DataFrame, weight: float = 1.0, average: bool = False, h: str = "h") -> DataFrame:
    """Sum or mean of squares of h, times weight."""
    return _sum(pixels, V.total(F.transform(h, lambda v: v * v)) * weight, "penalty", average, F.size(h))


def log_penalty(pixels: DataFrame, mu: float, eps: float, average: bool = False, h: str = "h") -> DataFrame:
    """mu times the sum or mean of ln(h + eps)."""
    return _sum(pixels, V.total(F.transform(h, lambda v: F.ln(v + eps))) * mu, "penalty", average, F.size(h))


def total_loss(pixels: DataFrame, d: Matrix, ridge_weight: float, mu: float, eps: float, floor: float = 1e-14, l2: bool = False, x: str = "spectrum", h: str = "h") -> DataFrame:
    """The objective of a fit: half the squares or the generalised KL divergence, and both penalties."""
    data = frobenius_loss(pixels, d, x=x, h=h).select(F.col("loss") * 0.5) if l2 else kl_loss(pixels, d, floor, constant=True, x=x, h=h)
    parts = [data.toDF("a"), log_penalty(pixels, mu, eps, h=h).toDF("b"), ridge(pixels, ridge_weight / 2, h=h).toDF("c")]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2])).select((F.col("a") + F.col("b") + F.col("c")).alias("loss"))


def normalisation_factor(pixels: DataFrame, f: float, x: str = "spectrum") -> DataFrame:
    """f over the mean value times the channels."""
    return pixels.agg(F.try_divide(F.lit(float(f)), F.try_divide(F.sum(V.total(F.col(x))), F.sum(F.size(x))) * F.max(F.size(x))).alias("factor"))


def poisson_normalised(pixels: DataFrame, x: str = "spectrum", by: str | None = None) -> DataFrame:
    """Values over the square root of their pixel's sum times their channel's sum, over all pixels or those of each group
    `by`, as of blocks; 0 where a sum is 0."""
    from .reshape import dense_sum

    sums = dense_sum(pixels, x, *([by] if by else [])).withColumnRenamed("total", "_c")
    scale = lambda row: F.zip_with(x, F.col("_c"), lambda v, c: F.coalesce(F.try_divide(v, row * F.sqrt(c)), F.lit(0.0)))
    scaled = V.once(F.sqrt(V.total(F.col(x))), scale)
    joined = pixels.join(small(sums), by) if by else pixels.join(F.broadcast(sums))
    return joined.withColumn(x, scaled).select(*pixels.columns)


def residuals(pixels: DataFrame, d: Matrix, count: int | None = None, by: str | None = None, floor: float = 1e-14, x: str = "spectrum", h: str = "h") -> DataFrame:
    """Spectra over their norm less the first components' model over its own; not positive becomes floor.

    Norms are of all pixels, or of each group `by`, as of blocks.
    """
    rows = [r[:count] for r in d] if count else d
    hs = F.slice(h, 1, count) if count else F.col(h)
    fitted = pixels.withColumn("_m", model(rows, hs))
    sq = lambda c: F.sum(V.dot(F.col(c), F.col(c)))
    keys = [by] if by else []
    norms = fitted.groupBy(*keys).agg(F.sqrt(sq(x)).alias("_nx"), F.sqrt(sq("_m")).alias("_nm"))
    joined = fitted.join(small(norms), keys) if by else fitted.join(F.broadcast(norms))
    diff = F.zip_with(x, "_m", lambda a, b: F.coalesce(F.try_divide(a, F.col("_nx")), F.lit(0.0)) - F.coalesce(F.try_divide(b, F.col("_nm")), F.lit(0.0)))
    return joined.withColumn("residual", F.transform(diff, lambda v: F.when(v <= 0, F.lit(floor)).otherwise(v))).drop("_m", "_nx", "_nm")


def min_max_scaled(cells: DataFrame, group: str = "channel", value: str = "value") -> DataFrame:
    """Values between the least and the largest of their group as 0 to 1, with both bounds; null where they are equal.

    The bounds are found by an aggregation, which is joined back.
    """
    bounds = cells.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    joined = cells.join(small(bounds), group)
    return joined.withColumn(value, F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low")))


def min_max_restored(scaled: DataFrame, value: str = "value") -> DataFrame:
    return scaled.withColumn(value, F.col(value) * (F.col("high") - F.col("low")) + F.col("low"))


def row_maxima(pixels: DataFrame, h: str = "h") -> DataFrame:
    """(comp, top): the largest value of each component over all pixels."""
    return pixels.select(F.posexplode(h).alias("comp", "_v")).groupBy("comp").agg(F.max("_v").alias("top"))


def block_average(values: DataFrame, by: str = "channel", value: str = "value") -> DataFrame:
    """Mean over blocks of a background column."""
    return values.groupBy(by).agg(F.avg(value).alias(value))


def quadratic_surrogate(new: Column, old: Column, grad: Column, gamma: float) -> tuple[Column, Column]:
    """What a pixel adds to <new - old, grad> and to gamma |new - old|^2."""
    d = F.zip_with(new, old, lambda a, b: a - b)
    return V.dot(d, grad), V.dot(d, d) * gamma


def l2_surrogate(pixels: DataFrame, sigma: float, weight: float, old: str = "h_old", new: str = "h") -> DataFrame:
    parts = pixels.agg(F.sum(V.dot(F.col(old), F.col(old))).alias("oo"), F.sum(V.dot(F.col(old), F.col(new))).alias("on"), F.sum(V.dot(F.col(new), F.col(new))).alias("nn"))
    gap = F.col("oo") - F.col("on") * 2.0 + F.col("nn")
    return parts.select(((F.col("on") * 2.0 - F.col("oo") + gap * sigma) * (weight / 2)).alias("surrogate"))


def kl_surrogate(pixels: DataFrame, sigma: float, weight: float, old: str = "h_old", new: str = "h") -> DataFrame:
    """The majoriser with the divergence of old from new, weighted by each component's largest new value."""
    long = pixels.select(F.posexplode(F.arrays_zip(F.col(old).alias("o"), F.col(new).alias("n"))).alias("comp", "v")).select("comp", "v.o", "v.n")
    by = long.groupBy("comp").agg(F.sum(F.col("o") * F.col("n")).alias("on"), F.sum(F.col("o") * F.col("o")).alias("oo"), F.max("n").alias("top"), F.sum(F.ln(F.try_divide(F.col("o"), F.col("n"))) * F.col("o") - F.col("o") + F.col("n")).alias("kl"))
    return by.agg(((F.sum("on") * 2.0 - F.sum("oo") + F.sum(F.col("top") * F.col("kl")) * sigma) * (weight / 2)).alias("surrogate"))


def surrogate_gap(surrogate: DataFrame, pixels: DataFrame, weight: float, h: str = "h") -> DataFrame:
    """The surrogate less the penalty that it majorises."""
    return surrogate.join(F.broadcast(ridge(pixels, weight / 2, h=h))).select((F.col("surrogate") - F.col("penalty")).alias("gap"))
