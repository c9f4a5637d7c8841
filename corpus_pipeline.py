"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets and encoding, in this order.

Each stage works on all rows that its predecessor kept. Toxic documents go; of near-duplicates one document stays;
documents that leak a benchmark item go; secrets are replaced in the text, and n_chars follows; the last stage encodes
what is left. All stages but the last return the columns of documents. How each treats nulls, empty texts, repeated
rows and empty tables is said where its operator is defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import decontaminate, near_dup, piece_codec, secret_scan, toxicity
from spectrail.llm.common import discard, materialize
from spectrail.llm.queries import vocabulary

#: The toxicity stage is a trained model, which SQL can't express.
ORACLE_SQL = None

#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.first_of_groups(docs, size=SHINGLE_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_samples(spark)))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # fewer kept segments than in a job of its own, as the workers also hold what earlier stages left
    rows = piece_codec.encode(docs, vocabulary("piece_bpe_32k.model"), cached=100_000)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written to the shared folder and read again, then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
