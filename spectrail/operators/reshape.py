"""Between long cells (pixel_id, channel, value) and rows of pixels, and sums of spectra."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import filled


def to_pixels(cells: DataFrame, channels: int, first: int = 0, spectrum: str = "spectrum") -> DataFrame:
    """A row for each pixel with the values of channels first .. first + channels - 1; gaps are 0."""
    packed = cells.groupBy("pixel_id").agg(F.collect_list(F.struct(F.col("channel").cast("int").alias("channel"), F.col("value").cast("double").alias("value"))).alias("_m"))
    return packed.select("pixel_id", filled(F.col("_m"), "channel", "value", channels, first).alias(spectrum))


def to_cells(pixels: DataFrame, spectrum: str = "spectrum", first: int = 0, *keys: str) -> DataFrame:
    return pixels.select("pixel_id", *keys, F.posexplode(spectrum).alias("channel", "value")).withColumn("channel", (F.col("channel") + first).cast("int"))


def summed_spectrum(pixels: DataFrame, spectrum: str = "spectrum", *keys: str) -> DataFrame:
    """(keys, channel, total). Sums are made before the shuffle, so a row for each task and channel crosses it."""
    cells = pixels.select(*keys, F.posexplode(spectrum).alias("channel", "_v"))
    return cells.groupBy(*keys, "channel").agg(F.sum("_v").alias("total"))


def dense_sum(pixels: DataFrame, spectrum: str = "spectrum", *keys: str) -> DataFrame:
    """One row, or one for each group, with the sum of all spectra, by vector sums in each task; the spectra stay in their
    rows."""
    v = array_to_vector(F.col(spectrum))
    return pixels.select(*keys, v.alias("_v")).groupBy(*keys).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("total"))


def in_rectangle(pixels: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Pixels with y0 <= y < y1 and x0 <= x < x1."""
    return pixels.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def pooled(elements: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """Pooled components with both parts in one feature vector."""
    return elements.join(backgrounds, ["block_id", "comp"]).withColumn("full", F.concat("features", "background"))


def distinct_rounded(points: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """Points whose vectors differ in significant digits; of equals that with the smallest id stays."""
    text = F.concat_ws(",", F.transform(column, lambda x: F.format_string(f"%.{digits - 1}e", x)))
    first = points.groupBy(text.alias("_t")).agg(F.min("point_id").alias("point_id"))
    return points.join(first.select("point_id"), "point_id", "left_semi")
