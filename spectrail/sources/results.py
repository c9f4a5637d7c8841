"""Results of a fit in a folder: G, W, H and Q, and absorption factors, each a Parquet table that any engine can read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Results:
    g: np.ndarray
    names: list[str]
    w: np.ndarray
    h: DataFrame
    q: DataFrame | None = None
    a: DataFrame | None = None


def _long(spark: SparkSession, m: np.ndarray, first: str, second: str) -> DataFrame:
    rows = [(i, j, float(v)) for i, row in enumerate(np.asarray(m)) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, f"{first} int, {second} int, value double")


def _dense(rows: DataFrame, first: str, second: str) -> np.ndarray:
    """A matrix of the dictionary's size."""
    t = rows.toPandas()
    m = np.zeros((t[first].max() + 1, t[second].max() + 1))
    m[t[first].to_numpy(), t[second].to_numpy()] = t["value"]
    return m


def write_results(path: str, g: np.ndarray, names: Sequence[str], w: np.ndarray, h: DataFrame, q: DataFrame | None = None, a: DataFrame | None = None) -> None:
    """The folders G, names, W, H, and Q and A if they are given. Fails where the folder has results already."""
    spark = h.sparkSession
    tables = {"G": _long(spark, g, "channel", "column"), "W": _long(spark, w, "column", "comp"), "H": h, "Q": q, "A": a}
    tables["names"] = spark.createDataFrame(list(enumerate(names)), "column int, name string")
    for name, table in tables.items():
        if table is not None:
            table.write.parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str) -> Results:
    """What write_results() wrote."""
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {f.getPath().getName() for f in files.listStatus(folder)}
    names = [r["name"] for r in table("names").orderBy("column").collect()]
    more = [table(x) if x in there else None for x in ("Q", "A")]
    return Results(_dense(table("G"), "channel", "column"), names, _dense(table("W"), "column", "comp"), table("H"), *more)


def read_h(spark: SparkSession, path: str, value: float = 1e-14) -> DataFrame:
    """(pixel_id, h) of results, where NaN and null become a small value."""
    rows = spark.read.parquet(f"{path}/H")
    return rows.withColumn("h", F.transform("h", lambda v: F.nanvl(F.coalesce(v, F.lit(value)), F.lit(value))))
