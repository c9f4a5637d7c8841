"""Importance resampling towards a target: documents drawn by how much likelier the target makes their word n-grams.

Distinct words of documents and target get numbers (the dictionary, a table); an n-gram is a tuple of numbers. Each
distinct tuple is spelt out and hashed once, into one of `buckets`; its counts in documents and in the target are joined
to it, and what its bucket gains is joined back to the chunks that hold it (word_tables.py). The weight of a document is
the floored mean gain of its n-grams; documents of at least `least_words` words are drawn by the highest weight plus
Gumbel noise from a hash of their id, which samples without replacement in proportion to e^weight.

Only the gains of the buckets, a number each, are sent to all tasks; dictionary and tuples grow with the data and are
joined. Ranks come from ranges of the sorted rows, each of which numbers its own.

Defined cases: a null or empty text has no n-grams and weight 0 and isn't drawn; a null id is drawn by the hash of the
seed alone and comes last among equals; repeated rows are counted each, share weight and score, and get ranks of their
own; a text of any length is taken whole; an empty target or table of documents counts 0 everywhere and is no error;
other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NORMAL, discard, materialize
from .word_tables import by_text, chunks, word_rows


def dictionary(chunked: DataFrame) -> DataFrame:
    """(word, word_id): the distinct words of chunks, numbered. To be written before use, as numbers are of its tasks."""
    return chunked.select(F.explode("words").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("word_id"))


def tuples(chunked: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """(chunk, at, gram, n0, n1): the distinct n-grams of each chunk, as tuples of numbers of the dictionary."""
    numbered = word_rows(chunked) if n == 1 else chunked.select("chunk", F.posexplode("words").alias("at", "word"))
    numbered = numbered.join(words, "word")
    if n == 1:
        return numbered.select("chunk", "at", F.array("word_id").alias("gram"), "n0", "n1")
    ids = numbered.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "word_id"))).alias("_w"))  # as many as a chunk has
    rows = chunked.select("chunk", "grams", "n0", "n1").join(ids.select("chunk", F.col("_w.word_id").alias("_ids")), "chunk")
    spelt = F.transform("grams", lambda g: F.transform(g, lambda i: F.get(F.col("_ids"), i)))
    return rows.select("chunk", F.posexplode(F.arrays_zip(spelt.alias("gram"), "n0", "n1")).alias("at", "_g")).select("chunk", "at", "_g.gram", "_g.n0", "_g.n1")


def buckets_of(counted: DataFrame, words: DataFrame, n: int, buckets: int) -> DataFrame:
    """(gram, n0, n1, bucket) of distinct tuples: each spelt from the dictionary and hashed once."""
    if n == 1:
        spelt = counted.withColumn("word_id", F.get("gram", 0)).join(words, "word_id").withColumnRenamed("word", "_text")
    else:
        each = counted.select("gram", F.posexplode("gram").alias("_i", "word_id")).join(words, "word_id")
        text = F.array_join(F.sort_array(F.collect_list(F.struct("_i", "word")))["word"], " ")  # n at most
        spelt = counted.join(each.groupBy("gram").agg(text.alias("_text")), "gram")
    return spelt.select("gram", "n0", "n1", (F.crc32(F.col("_text").cast("binary")) % buckets).cast("int").alias("bucket"))


def gains(hashed: DataFrame, buckets: int) -> np.ndarray:
    """What each bucket gains, in thousandths of a natural logarithm: as many numbers as there are buckets."""
    found = hashed.groupBy("bucket").agg(F.sum("n0").alias("s"), F.sum("n1").alias("t")).collect()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in found:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * (all_s + buckets) / (float(a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)])


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add `place`, 1, 2, 3 ... in an order of the whole table: rows are dealt into sorted ranges, whose sizes, a number
    each, say where a range begins."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a number of monotonically_increasing_id() is the task's and, in the last 33 bits, the row's in the task
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    numbered = materialize(dealt.withColumn("_m", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_m", 33)
    sizes = {r["p"]: r["n"] for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])])
    start = F.get(F.array(*(F.lit(int(s)).cast("long") for s in starts)), part.cast("int"))
    return numbered.withColumn("place", start + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_m")


def resample(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of each document."""
    rows = documents.select(F.col(key).cast("long").alias("id"), F.lit(0).alias("kind"), F.col(text).alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("id"), F.lit(1).alias("kind"), F.col(target_text).alias("text"))
    chunked = materialize(chunks(rows, NORMAL, n).withColumn("kind", F.lit(0)).union(chunks(wanted, NORMAL, n).withColumn("kind", F.lit(1)).withColumn("chunk", -1 - F.col("chunk"))), "chunks")
    words = materialize(dictionary(chunked), "dictionary")
    grams = materialize(tuples(chunked, words, n), "tuples")
    hashed = materialize(buckets_of(grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), words, n, buckets), "hashed")
    discard(words)
    gained = documents.sparkSession.createDataFrame(list(enumerate(gains(hashed, buckets).tolist())), "bucket int, gain long")
    gain = hashed.join(F.broadcast(gained), "bucket").select("gram", "gain")  # a row for each bucket
    values = grams.where("chunk >= 0").select("chunk", "at", "gram").join(gain, "gram").select("chunk", "at", "gain")

    def weigh(sizes: np.ndarray, at: np.ndarray, arrays: list[np.ndarray]) -> list:
        each, sizes = arrays[0].astype(np.int64)[at] if len(at) else np.zeros(0, np.int64), sizes.astype(np.int64)
        features, total, done = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
        for own in (np.maximum(sizes - i, 0) for i in range(n)):
            stop = done + np.cumsum(own)
            summed = np.concatenate([[0], np.cumsum(each)])
            total, features = total + summed[stop] - summed[stop - own], features + own
            done += int(own.sum())
        return [sizes, features, np.where(features > 0, total // np.maximum(features, 1), 0)]

    found = by_text(chunked.where("kind = 0"), values, "doc_id long, n_words long, n_features long, weight long", weigh)
    scored = found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_may", F.col("n_words") >= least_words)
    placed = ranked(scored, [F.col("_may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")])
    for table in (hashed, grams, chunked):
        discard(table)
    most = placed.where("_may").count() * percent // 100
    rank = F.when(F.col("_may") & (F.col("place") <= most), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
