"""Image operators on grids (y, x, ...): the dark-field model, and total variation by neighbours.

Neighbours come from windows along one axis, each partitioned by the other, so an image of any size is spread.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from .tiles import denoise_steps


def weights(numbers: Sequence[float]) -> list[float]:
    """Atomic numbers over their mean."""
    mean = sum(numbers) / len(numbers)
    return [z / mean for z in numbers]


def dark_field(q: Column, numbers: Sequence[float], gamma: float) -> Column:
    """Image intensity of a pixel from its composition."""
    return V.total(F.zip_with(q, V.literal(weights(numbers)), lambda v, z: z * F.pow(v, F.lit(float(gamma)))))


def residual_gradient(residual: Column, numbers: Sequence[float]) -> Column:
    """What each element gets of a pixel's residual."""
    return V.once(residual, lambda r: F.transform(V.literal(weights(numbers)), lambda z: z * r))


def dark_field_cost(pixels: DataFrame, q: str, image: str, numbers: Sequence[float], gamma: float) -> DataFrame:
    r = dark_field(F.col(q), numbers, gamma) - F.col(image)
    return pixels.agg((F.sum(r * r) * 0.5).alias("cost"))


def poisson_cost(pixels: DataFrame, first: str, now: str, eps: float = 1e-8) -> DataFrame:
    return pixels.agg(F.sum(V.total(F.zip_with(first, now, lambda a, b: a * F.ln(b + eps) - b))).alias("cost"))


def _along(axis: str, over: Iterable[str]) -> Window:
    other = "x" if axis == "y" else "y"
    return Window.partitionBy(*over, other).orderBy(axis)


def tv_objective(grid: DataFrame, lam: float, value: str = "value", px: str = "px", py: str = "py", over: Sequence[str] = ()) -> DataFrame:
    """Add out = value - lam * divergence of (px, py); px runs along y, py along x, and both are 0 before the first."""
    before = lambda c, axis: F.lag(c, 1, 0.0).over(_along(axis, over))
    flow = F.col(px) + F.col(py) - before(px, "y") - before(py, "x")
    return grid.withColumn("out", F.col(value) - flow * lam)


def tv_gradient(grid: DataFrame, factor: float, value: str = "value", over: Sequence[str] = ()) -> DataFrame:
    """Add to px and py the factor times the fall to the next pixel along y and x; 0 at the last."""
    fall = lambda axis: F.coalesce(F.col(value) - F.lead(value).over(_along(axis, over)), F.lit(0.0))
    return grid.withColumns({"px": F.col("px") + fall("y") * factor, "py": F.col("py") + fall("x") * factor})


def tv_projected(grid: DataFrame) -> DataFrame:
    """(px, py) no longer than 1."""
    length = F.greatest(F.lit(1.0), F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")))
    return grid.withColumns({"px": F.col("px") / length, "py": F.col("py") / length})


def tv_denoise(grid: DataFrame, lam: float, rounds: int, value: str = "value", over: Sequence[str] = ()) -> DataFrame:
    """Fast gradient projection in `rounds` steps, as windows; negative results become 0. For few rounds."""
    g = grid.withColumns({"px": F.lit(0.0), "py": F.lit(0.0)})
    for _ in range(rounds):
        g = tv_projected(tv_gradient(tv_objective(g, lam, value, over=over), 1 / (8 * lam), "out", over=over))
    return g.withColumn("out", F.greatest(F.col("out"), F.lit(0.0))).drop("px", "py")


def tv_cost(grid: DataFrame, height: int, width: int, value: str = "value", eps: float = 1e-8, over: Sequence[str] = ()) -> DataFrame:
    """Sum of sqrt(eps + squares of differences to the next pixels); after the last pixel comes the first."""

    def step(axis: str, size: int) -> Column:
        w = _along(axis, over)
        following = F.when(F.col(axis) == size - 1, F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).otherwise(F.lead(value).over(w))
        d = F.col(value) - following
        return d * d

    terms = grid.select(*over, F.sqrt(step("y", height) + step("x", width) + eps).alias("_t"))
    return terms.groupBy(*over).agg(F.sum("_t").alias("cost")) if over else terms.agg(F.sum("_t").alias("cost"))


# -- the same on a dense image, for loops --------------------------------------------------------------------------


def denoise_image(image: np.ndarray, lam: float, rounds: int) -> np.ndarray:
    return np.maximum(denoise_steps(image, np.zeros_like(image), np.zeros_like(image), lam, rounds), 0.0)


def image_cost(image: np.ndarray, eps: float = 1e-8) -> float:
    d0, d1 = image - np.roll(image, -1, 0), image - np.roll(image, -1, 1)
    return float(np.sqrt(eps + d0 * d0 + d1 * d1).sum())
