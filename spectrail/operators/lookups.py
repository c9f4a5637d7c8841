"""Joins with small lookup tables, and products of long matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..sources.shared import written

#: Rows and bytes that a lookup table may have to be sent whole to each task; larger ones are joined.
LOOKUP_ROWS, LOOKUP_BYTES = 100_000, 32 << 20


def _bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        width = 8 if isinstance(kind.elementType, T.NumericType) else 32
        return F.coalesce(F.size(c).cast("long"), F.lit(0)) * width + 16
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) + 16
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))).cast("long"), F.lit(0)) + 16
    return F.lit(8).cast("long")


def fits(table: DataFrame) -> bool:
    """Whether a table may be sent whole to each task, by one sum over its rows; nothing is written."""
    size = sum((_bytes(f.name, f.dataType) for f in table.schema), F.lit(0).cast("long"))
    rows, bytes_ = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= LOOKUP_ROWS and bytes_ <= LOOKUP_BYTES


def small(table: DataFrame) -> DataFrame:
    """The table, to be sent whole to each task where its size shows that it may be: for joins whose other side has few keys
    with many rows each."""
    return F.broadcast(table) if fits(table) else table


def lookup(rows: DataFrame, table: DataFrame, key: str = "element") -> DataFrame:
    """Inner join with a dimension; the query fails on a key that the dimension lacks."""
    joined = rows.join(table.withColumn("_found", F.lit(True)), key, "left")
    known = F.coalesce(F.col("_found"), F.raise_error(F.concat(F.lit("not in the table: "), F.col(key))).cast("boolean"))
    return joined.where(known).drop("_found")


def nearest(rows: DataFrame, key: Column, table: DataFrame, table_key: str, value: str, out: str) -> DataFrame:
    """Add the value of the table's row whose key is closest; of equals the first in order of the key.

    A small table goes to each task as a row of two sorted arrays, searched by halves. A larger one is joined by ranges of
    keys, see _by_ranges().
    """
    own = table.select(F.col(table_key).alias("k"), F.col(value).alias("v")).where("k is not null")
    if not fits(own):
        return _by_ranges(rows, key, own, out)
    sorted_ = own.agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("_p")).select(F.col("_p.k").alias("_keys"), F.col("_p.v").alias("_values"))
    return rows.join(F.broadcast(sorted_)).withColumn(out, F.get("_values", V.nearest_sorted(F.col("_keys"), key))).drop("_keys", "_values")


def _by_ranges(rows: DataFrame, key: Column, table: DataFrame, out: str) -> DataFrame:
    """nearest() without a broadcast that grows: the distinct keys of both sides are dealt into sorted ranges; within a range
    the entries before and after a key are running values, and what ranges hand on over their borders, an entry on either
    side of each, is added. Equal keys of rows are found once and joined back."""
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = table.groupBy("k").agg(F.min("v").alias("v")).select(F.col("k").alias("_k"), F.struct("k", "v").alias("_e"))
    kind = entries.schema["_k"].dataType
    asked = rows.select(key.cast(kind).alias("_k")).where("_k is not null").distinct().select("_k", F.lit(None).cast(entries.schema["_e"].dataType).alias("_e"))
    dealt = written(entries.union(asked).repartitionByRange(n, "_k").withColumn("_range", F.spark_partition_id()), "ranges")
    up = Window.partitionBy("_range").orderBy("_k", F.col("_e").isNull())
    down = Window.partitionBy("_range").orderBy(F.col("_k").desc(), F.col("_e").isNull())
    found = dealt.withColumns({"_below": F.last("_e", True).over(up), "_above": F.last("_e", True).over(down)}).where("_e is null")
    ends = {r["_range"]: r for r in dealt.where("_e is not null").groupBy("_range").agg(F.min("_e").alias("low"), F.max("_e").alias("high")).collect()}  # two entries for each range
    last, carried = None, []
    for i in range(n):
        carried.append([i, last, None])
        last = ends[i]["high"] if i in ends else last
    last = None
    for i in reversed(range(n)):
        carried[i][2] = last
        last = ends[i]["low"] if i in ends else last
    entry = entries.schema["_e"].dataType
    borders = spark.createDataFrame([tuple(c) for c in carried], T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_before", entry), T.StructField("_after", entry)]))
    near = found.join(F.broadcast(borders), "_range")
    gap = lambda c: F.when(c.isNotNull(), F.struct(F.abs(c["k"] - F.col("_k")).alias("d"), c["k"].alias("k"), c["v"].alias("v")))
    best = F.least(gap(F.coalesce("_below", "_before")), gap(F.coalesce("_above", "_after")))
    return rows.withColumn("_key", key.cast(kind)).join(near.select("_k", best["v"].alias(out)), F.col("_key") == F.col("_k"), "left").drop("_key", "_k")


def matrix_product(a: DataFrame, b: DataFrame, inner: str, left: str, right: str) -> DataFrame:
    """(left, right, value): sum over the inner index of products of two long matrices with columns `value`. The inner
    index has few values, so a side that is small goes to each task; give it as a."""
    joined = b.select(inner, right, F.col("value").alias("_b")).join(small(a.select(left, inner, F.col("value").alias("_a"))), inner)
    return joined.groupBy(left, right).agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def renamed_lines(lines: DataFrame, names: DataFrame, elements: DataFrame) -> DataFrame:
    """Lines keyed by atomic number and a line's name, as (element, line, energy, cs): names that stand for one line only
    are replaced, others stay."""
    single = names.where(F.size("aliases") == 1).select(F.element_at("aliases", 1).alias("line"), F.col("name").alias("_name"))
    symbols = elements.select("number", "element")
    joined = lookup(lines, symbols, "number").join(small(single), "line", "left")
    return joined.select("element", F.coalesce("_name", "line").alias("line"), "energy", "cs")
