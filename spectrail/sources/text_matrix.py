"""Matrices and vectors as text: a line of sizes, then a line of numbers for each row (a vector is one column).

Reading is spread over the splits of files, and values keep full precision, as doubles are written in their shortest exact form.
A matrix larger than two dimensions is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import filled


def write_matrix(cells: DataFrame, path: str, rows: int, cols: int | None = None) -> None:
    """Write (i, j, value) as a matrix of rows x cols, or (i, value) as a vector if cols is None. Gaps are 0."""
    width = cols or 1
    j = F.col("j") if cols else F.lit(0)
    packed = cells.select(F.col("i").cast("long").alias("i"), F.struct(j.cast("int").alias("j"), F.col("value").cast("double").alias("value")).alias("c"))
    full = cells.sparkSession.range(rows).withColumnRenamed("id", "i").join(packed.groupBy("i").agg(F.collect_list("c").alias("m")), "i", "left")
    line = F.array_join(filled(F.coalesce("m", F.array().cast("array<struct<j:int,value:double>>")), "j", "value", width), " ")
    head = cells.sparkSession.range(1).select(F.lit(-1).cast("long").alias("i"), F.lit(f"{rows} {cols}" if cols else f"{rows}").alias("value"))
    full.select("i", line.alias("value")).union(head).orderBy("i").select("value").write.text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, value) of a text matrix or vector, in as many tasks as its files have splits. Fails if the file is missing or a row's length differs from the head's."""
    text = spark.read.text(path)
    files = sorted(text.inputFiles(), key=lambda f: f.rpartition("/")[2])
    first = next((r for r in (spark.read.text(f).first() for f in files) if r is not None), None)
    if first is None:
        raise ValueError(f"{path} is empty")
    sizes = [int(x) for x in first["value"].split()]
    if len(sizes) not in (1, 2):
        raise ValueError("only vectors and matrices can be read")
    width = sizes[1] if len(sizes) == 2 else 1
    # a line's rank is its place in its split, plus the lines of the splits before it: one row for each split
    split = ["file_name", "file_block_start"]
    lines = text.select("value", *(f"_metadata.{c}" for c in split), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy(*split).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"_{c}") for c in split), (before - F.col("_first")).alias("_start"))
    same = [F.col(c) == F.col(f"_{c}") for c in split]
    ranked = lines.join(starts, same[0] & same[1])
    rows = ranked.select("value", (F.col("at") + F.col("_start") - 1).alias("i")).where("i >= 0")
    values = F.split(F.trim("value"), r"\s+")
    checked = F.when(F.size(values) == width, values).otherwise(F.raise_error(F.lit("a row's length differs from the head's")))
    return rows.select("i", F.posexplode(checked).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("value"))


def pixel_vector(spark: SparkSession, path: str, name: str = "thickness") -> DataFrame:
    """A text vector as one value for each pixel_id."""
    return read_matrix(spark, path).select(F.col("i").alias("pixel_id"), F.col("value").alias(name))
