"""Shards by jump consistent hashing, and gapless slots inside each shard.

Jump consistent hashing (Lamping and Veach, 2014) needs no ring table: the shard of a key follows from the key and the
number of shards alone, and one more shard takes 1/(n+1) of the keys, all into the new shard.

Defined cases: a null key is key 0 and still gets a shard; a null text counts as empty (size 8, checksum 0); repeated
rows share a shard and get different slots; an empty table gives an empty result; other columns are not read or
returned, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, materialize, text_bytes

#: Multiplier of the published generator.
STEP = np.uint64(2862933555777941757)
#: Ranges of keys for each shuffle partition, at most.
RANGES = 4


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = jump[live]
        state[live] = state[live] * STEP + np.uint64(1)
        spread = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((at[live] + 1) * (float(1 << 31) / spread)).astype(np.int64)
        live = live[jump[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Column of shards. A key that isn't a whole number should be hashed first, with F.xxhash64()."""

    @F.pandas_udf(T.IntegerType())
    def shard(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.to_numpy(np.int64), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def with_slots(rows: DataFrame, shard: str, order: list[str], group_rows: int = 20_000, copies: int = 10_000) -> DataFrame:
    """Add `slot`, gapless from 0 within each shard in the order of the columns `order` (nulls first), which must tell
    rows apart that aren't equal throughout.

    No task sorts a whole shard: equal rows are counted first, so that no key is hot; the rest is dealt into ranges of
    about group_rows rows, or larger ones where these would be more than some for each shuffle partition; each range
    numbers its rows of a shard and adds the count of the ranges before. Rows with more than `copies` copies are written
    out by several tasks.
    """
    names = rows.columns
    counted = materialize(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "counted")
    most = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(8, counted.count() // group_rows), max(8, most))
    dealt = materialize(counted.repartitionByRange(ranges, *order).withColumn("_g", F.spark_partition_id()), "ranges")
    discard(counted)
    sizes = dealt.groupBy(shard, "_g").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_s"), F.col("_g").alias("_h"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(starts, (F.col(shard) == F.col("_s")) & (F.col("_g") == F.col("_h")))
        .withColumn("_at", F.col("_at") + F.col("_start"))
        .select(*names, "_at", "_n")
    )
    few = placed.where(F.col("_n") <= copies).withColumn("_i", F.explode(F.expr("sequence(0L, _n - 1)")))
    many = (
        placed.where(F.col("_n") > copies)
        .withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n - 1) div {copies})")))
        .repartition(F.col("_part"), F.col("_at"))
        .withColumn("_i", F.explode(F.expr(f"sequence(_part * {copies}, least(_n, (_part + 1) * {copies}) - 1)")))
        .drop("_part")
    )
    return few.unionByName(many).select(*names, (F.col("_at") + F.col("_i")).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, size (bytes + 8), text_crc32, shard, grown_shard (one shard more) and slot, which
    follows the key, the size and the checksum."""
    data = text_bytes(text)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(data) + F.lit(8)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    return with_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
