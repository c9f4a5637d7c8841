"""Guards, floors, masks and thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lookups import small


def non_negative(pixels: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """The query fails on a negative value."""
    a = F.col(spectrum)
    return pixels.withColumn(spectrum, F.when(F.exists(a, lambda x: x < 0), F.raise_error(F.lit("negative values")).cast("array<double>")).otherwise(a))


def above_floor(value: Column, floor: float) -> Column:
    """The query fails on a value below half of -floor."""
    return F.when(value < -floor / 2, F.raise_error(F.lit("a value is below the floor")).cast("double")).otherwise(value)


def without_zero_lines(cells: DataFrame, eps: float) -> DataFrame:
    """(pixel_id, channel, value): channels and pixels that are 0 throughout become eps; fails on negative values."""
    v = F.when(F.col("value") < 0, F.raise_error(F.lit("negative values")).cast("double")).otherwise(F.col("value"))
    sums = lambda key: cells.groupBy(key).agg(F.sum("value").alias(f"_{key}"))
    joined = cells.withColumn("value", v).join(small(sums("channel")), "channel").join(sums("pixel_id"), "pixel_id")
    empty = (F.col("_channel") == 0) | (F.col("_pixel_id") == 0)
    return joined.select("pixel_id", "channel", F.when(empty, F.lit(eps)).otherwise(F.col("value")).alias("value"))


def floored(value: Column, floor: float) -> Column:
    return F.greatest(value, F.lit(floor))


def masked(fixed: Column, value: Column) -> Column:
    """Fixed values where there are any; null stands for free."""
    return F.coalesce(fixed, value)


def snapped(value: Column, low: float = 1e-3, high: float = 0.98) -> Column:
    """Small values become 0, large ones 1."""
    return F.when(value <= low, F.lit(0.0)).when(value >= high, F.lit(1.0)).otherwise(value)


def snapped_share(w: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Snap values, then divide by the sum of their group where it isn't 0."""
    s = w.withColumn(value, snapped(F.col(value)))
    whole = F.sum(value).over(Window.partitionBy(*group))
    return s.withColumn(value, F.coalesce(F.try_divide(F.col(value), whole), F.col(value)))


def _shared(m: np.ndarray) -> np.ndarray:
    s = m.sum(axis=0)
    return np.divide(m, s, out=m.copy(), where=s != 0)


def separate(w: np.ndarray, order: int) -> np.ndarray:
    """Post-process a composition matrix (rows: elements without background). Order 1: an element that makes up a
    component is taken from the others, and the others from it. Order 2: so are two elements that make up one together."""
    m = np.array(w, float)
    m[m <= 1e-3] = 0.0
    m[m >= 0.98] = 1.0
    if order >= 1:
        for j in range(m.shape[1]):
            pure = np.flatnonzero(m[:, j] == 1.0)
            if len(pure):
                i = pure[-1]
                m[np.arange(len(m)) != i, j] = 0.0
                m[i, np.arange(m.shape[1]) != j] = 0.0
        m = _shared(m)
    if order == 2:
        for j in range(m.shape[1]):
            part = m[:, j] <= 0.95
            sums = m[:, j][:, None] + m[:, j][None, :]
            i, k = np.nonzero(np.triu((sums >= 0.95) & (sums <= 1.05) & part[:, None] & part[None, :], 1))
            if len(i):
                pair = [i[-1], k[-1]]
                m[~np.isin(np.arange(len(m)), pair), j] = 0.0
                others = np.arange(m.shape[1]) != j
                for r in pair:
                    m[r, others] = 0.0
    return _shared(m)


def separate_blocks(points: DataFrame, order: int) -> DataFrame:
    """(block_id, comp, features) with each block's components post-processed together."""

    def block(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("comp")
        m = separate(np.array(rows["features"].tolist()).T, order)
        return rows.assign(features=list(m.T))

    return points.groupBy("block_id").applyInPandas(block, points.schema)
