"""Cubes as tables of pixels, in folders by block. Blocks are a partition column, so that reads of a block are pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def block_of(y: Column, x: Column, height: int, width: int, image_width: int) -> Column:
    """Block ids row by row; blocks at the edges may be smaller."""
    across = -(-image_width // width)
    return (F.floor(y / height) * across + F.floor(x / width)).cast("int")


def with_blocks(pixels: DataFrame, height: int, width: int, image_width: int) -> DataFrame:
    """pixel_id gets its y, x and block_id."""
    y, x = F.floor(F.col("pixel_id") / image_width).cast("int"), (F.col("pixel_id") % image_width).cast("int")
    return pixels.withColumn("y", y).withColumn("x", x).withColumn("block_id", block_of(F.col("y"), F.col("x"), height, width, image_width))


def write_blocks(pixels: DataFrame, path: str) -> None:
    pixels.repartition("block_id").write.partitionBy("block_id").parquet(path)


def read_blocks(spark: SparkSession, path: str, *fill: str) -> DataFrame:
    """All blocks as one table keyed by pixel; NaN and null in the array columns `fill` become 1e-14."""
    rows = spark.read.parquet(path)
    return rows.withColumns({c: V.fill_nan(F.col(c)) for c in fill})


def checked(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """The pixels of a whole image. ValueError unless each of its places is there just once."""
    seen = pixels.agg(F.count("pixel_id").alias("n"), F.count_distinct("pixel_id").alias("places"), F.min("pixel_id").alias("low"), F.max("pixel_id").alias("high")).first()
    if (seen["n"], seen["places"], seen["low"], seen["high"]) != (height * width, height * width, 0, height * width - 1):
        raise ValueError(f"{seen['n']} pixels at {seen['places']} places, where the image has {height * width}")
    return pixels


def corrected(pixels: DataFrame, factors: DataFrame, spectrum: str = "spectrum", factor: str = "a") -> DataFrame:
    """Spectra divided by their pixel's absorption factors."""
    joined = pixels.join(factors.select("pixel_id", F.col(factor).alias("_a")), "pixel_id")
    return joined.withColumn(spectrum, V.quotient(F.col(spectrum), F.col("_a"))).drop("_a")
