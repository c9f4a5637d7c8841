"""How many components a block has, and how large blocks should be."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .measures import poisson_normalised


def explained_variance(pixels: DataFrame, components: int = 30, normalise: bool = False, x: str = "spectrum") -> DataFrame:
    """(block_id, comp, variance, ratio): squares of singular values over the block's pixels, and shares among the kept."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.array(rows[x].tolist(), float)
        if normalise:
            by = np.sqrt(m.sum(axis=1))[:, None] * np.sqrt(m.sum(axis=0))
            m = np.divide(m, by, out=np.zeros_like(m), where=by != 0)
        s = np.linalg.svd(m, compute_uv=False)[:components] ** 2 / len(m)
        return pd.DataFrame({"block_id": int(key[0]), "comp": range(len(s)), "variance": s})

    blocks = pixels.select("block_id", x).groupBy("block_id").applyInPandas(run, "block_id int, comp int, variance double")
    whole = F.sum("variance").over(Window.partitionBy("block_id"))
    return blocks.withColumn("ratio", F.try_divide(F.col("variance"), whole))


def elbow(ratios: DataFrame, group: str = "block_id", order: str = "comp", value: str = "ratio", log: bool = True, most: int = 20) -> DataFrame:
    """(group, n_relevant): the point farthest from the chord between the first value and that at `most`, the first of
    equals; on logarithms unless log is False."""
    w = Window.partitionBy(group)
    rows = ratios.withColumn("_n", F.least(F.lit(most), F.count(F.lit(1)).over(w) - 1))
    clipped = F.greatest(F.col(value), F.lit(1e-30))
    rows = rows.withColumn("_y", F.ln(clipped) if log else clipped)
    at = lambda k: F.max(F.when(F.col(order) == k, F.col("_y"))).over(w)
    rows = rows.withColumns({"_y1": at(F.lit(0)), "_y2": at(F.col("_n"))})
    n = F.col("_n")
    far = F.abs(n * (F.col("_y1") - F.col("_y")) + F.col(order) * (F.col("_y2") - F.col("_y1")))
    distance = F.coalesce(F.try_divide(far, F.sqrt(n * n + F.pow(F.col("_y2") - F.col("_y1"), F.lit(2.0)))), F.lit(0.0))
    return rows.where(F.col(order) < n).groupBy(group).agg(F.max(F.struct(distance.alias("d"), (-F.col(order)).alias("o"))).alias("m")).select(group, (-F.col("m.o")).cast("int").alias("n_relevant"))


def best_block(spark: SparkSession, height: int, width: int, channels: int, target_bytes: float, tol: float = 0.2, item: int = 8) -> DataFrame:
    """(block_height, block_width): of the blocks within tol of the target size, that closest in shape to the image, the
    tallest of equals. A candidate pair of sides is a row; no row comes out if none fits."""
    tall = spark.range(int(height**0.5) + 1, height + 1).toDF("block_height")
    both = tall.withColumn("block_width", F.explode(F.sequence(F.lit(int(width**0.5) + 1), F.lit(width))))
    size = F.col("block_height") * F.col("block_width") * float(channels * item)
    shape = F.abs(F.col("block_height") / F.col("block_width") - height / width)
    fitting = both.where(size.between((1 - tol) * target_bytes, (1 + tol) * target_bytes))
    best = fitting.agg(F.min(F.struct(shape.alias("d"), (-F.col("block_height")).alias("h"), (-F.col("block_width")).alias("w"))).alias("m"))
    return best.where("m is not null").select((-F.col("m.h")).cast("int").alias("block_height"), (-F.col("m.w")).cast("int").alias("block_width"))


class PartitionedDataset:
    """A table of pixels in blocks of a size, with the statistics of each block. A new size starts them anew."""

    def __init__(self, pixels: DataFrame, image_width: int, components: int = 30, block: tuple[int, int] = (64, 64)) -> None:
        self.pixels, self.image_width, self.components = pixels, image_width, components
        self.partition(block)

    def partition(self, block: tuple[int, int]) -> None:
        from ..sources.blocks import with_blocks

        self.block = block
        self.data = with_blocks(self.pixels, *block, self.image_width)
        self.variances: DataFrame | None = None
        self.relevant: DataFrame | None = None

    def block_svd(self, normalise: bool = False) -> None:
        self.variances = explained_variance(self.data, self.components, normalise)
        self.relevant = elbow(self.variances)

    def max_components(self) -> int:
        return self.relevant.agg(F.max("n_relevant")).first()[0]

    def signal_table(self) -> DataFrame:
        """(block_id, comp, ratio, is_signal)"""
        return self.variances.join(self.relevant, "block_id").select("block_id", "comp", "ratio", (F.col("comp") < F.col("n_relevant")).alias("is_signal"))

    def intensities(self) -> DataFrame:
        """(block_id, pixel_id, y, x, intensity)"""
        return self.data.select("block_id", "pixel_id", "y", "x", F.aggregate("spectrum", F.lit(0.0), lambda a, v: a + v).alias("intensity"))

    def spectra(self, block_id: int) -> DataFrame:
        return self.data.where(F.col("block_id") == block_id)

    def normalised(self) -> DataFrame:
        return poisson_normalised(self.data)
