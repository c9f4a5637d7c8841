"""The registered queries of this subpackage: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, importance, lattice_lm, license_scan, media, near_dup, oracles, piece_codec, secret_scan, sharding, token_count, toxicity, warc
from .common import delete, fresh_path, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.fingerprint_media(media.store_texts(_table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.size("fp_code").cast("string"), F.lower(F.hex(F.xxhash64("fp_time", "fp_code"))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "fp_time", "fp_code")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(_table(spark, sf_dir, "documents"))
    base, near = F.col("phrases.label"), F.col("notices.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first_word").alias("first_word"),
        F.array_max("phrases.first_word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, near)).alias("labels"),
        "score",
        F.size("notices").cast("long").alias("n_notices"),
    )


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = materialize(warc.read_pages(spark, path), "pages")
    delete(spark, path)
    return found


def vocabulary(name: str) -> str:
    """Where the public tokenizer package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_codec.encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
        "begins",
        "ends",
    )


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = secret_scan.train(secret_scan.labelled_samples(spark))
    rows = secret_scan.find_secrets(_table(spark, sf_dir, "documents"), table)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(secret_scan.KINDS[:3])),
        F.sha2(secret_scan.span_text("base").cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text("spans").alias("spans"),
    )


def op7_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    covered = F.col("covered_words") / F.col("item_words")
    return rows.select("doc_id", "item_id", "item_words", "covered_words", covered.alias("coverage"), F.size("tiles").cast("long").alias("n_tiles"))


def op11_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media_fingerprints, op2_license_scan, op3_warc_chunks, op4_piece_offsets, op5_jump_shards, op6_markov_secrets, op7_ftrl_toxicity, op8_minhash_components, op9_heap_token_counts, op10_string_tiling, op11_lattice_likelihood, op12_importance_resampling, op13_annulus_clusters)}


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES
