"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, the pairs of neighbours and the pairs with one word between, hashed to 2^bits coordinates; a
document has a feature or not, however often. Training is FTRL-proximal (McMahan et al., 2013): per-coordinate learning
rates, and an L1 term that leaves most weights at zero, so the model is a short list that is broadcast for scoring.

Training takes at most max_rows labelled ids, the first by a hash of their id, and of these as many as have max_bytes of
coordinates together; that is the only bounded sample here. It runs runs in one executor task over those rows. Scoring reads each whole text.

Defined cases: a null or empty text has the score of the bias alone; a null id is never held out nor used for training;
a null label is skipped; repeated rows are scored alike; repeated labels of an id count once, contrary ones once each; of
several texts of an id the smallest by hash is learnt from; with no labelled row, or labels of one class only, every score
is that class's share (0 if there is none); other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, released, small_batches

#: Everything in ASCII but letters and digits parts words.
SPLIT = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Settings:
    bits: int = 22
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 3
    max_rows: int = 20_000
    max_bytes: int = 256 << 20
    threshold: float = 0.3


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(SPLIT).split()


def features(text: str, hashes: WordHashes, bits: int) -> np.ndarray:
    """Coordinates, with repeats, of a text's words, bigrams and skip-grams; 0 is kept for the bias."""
    w = words(text)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    both = np.concatenate([h, h[:-1] * MIX[0] + h[1:] * MIX[1], h[:-2] * MIX[2] + h[2:] * MIX[3]])
    both ^= both >> np.uint64(29)
    return np.maximum((both * MIX[0]) >> np.uint64(64 - bits), np.uint64(1)).astype(np.uint32)


def train(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that aren't zero, the bias at 0, from rows of (distinct coordinates, label)."""
    share = float(np.mean([y for _, y in rows])) if rows else 0.0
    if share in (0.0, 1.0):
        return np.zeros(1, np.int64), np.array([np.inf if share else -np.inf])
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    w = lambda i: np.where(np.abs(z[i]) <= s.l1, 0.0, -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))
    bias, bias_n = float(np.log(share / (1 - share))), 1.0
    for _ in range(s.epochs):
        for idx, y in rows:
            own = w(idx)
            p = 1 / (1 + np.exp(-np.clip(own.sum() + bias, -35, 35)))
            g = p - y
            rate = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / s.alpha
            z[idx] += g - rate * own
            n[idx] += g * g
            bias_n += g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
    kept = np.flatnonzero(np.abs(z) > s.l1)
    return np.concatenate([[0], kept]), np.concatenate([[bias], w(kept)])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Train on labelled rows that aren't held out. Gives the coordinates and weights, which L1 keeps few."""
    s = settings
    rank = F.xxhash64("_id")
    sample = labels.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    sample = sample.orderBy(rank, "_id", "_y").limit(s.max_rows)  # the bound of what is broadcast next
    texts = documents.select(F.col(key).cast("long").alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(sample.select("_id").distinct()), F.col("_doc") == F.col("_id"), "left_semi")
    texts = texts.groupBy("_doc").agg(F.min(F.struct(F.xxhash64("_text").alias("_h"), "_text")).alias("_t"))
    rows = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_id", "_y", "_t._text")

    @released
    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            own = [np.unique(features(x.as_py(), hashes, s.bits)).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.binary())], ["_id", "_y", "idx"])

    @released
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for y, i in zip(b.column(1), b.column(2), strict=True):
                if held <= s.max_bytes:
                    rows.append((np.frombuffer(i.as_py(), np.uint32), y.as_py()))
                    held += rows[-1][0].nbytes
        at, w = train(rows, s)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    one = rows.mapInArrow(coordinates, "_id long, _y int, idx binary").repartition(1).sortWithinPartitions(rank, "_id", "_y", "idx")
    with small_batches(documents.sparkSession):
        model = one.mapInArrow(fitted, "at long, w double").toPandas()
    return model["at"].to_numpy(np.int64), model["w"].to_numpy(np.float64)


class Model:
    """Scores texts in a Python worker, from coordinates and weights."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray], settings: Settings) -> None:
        at, w = model
        self.bits, self.hashes, self.weights = settings.bits, WordHashes(), np.zeros(1 << settings.bits)
        self.weights[at] = w
        self.bias, self.weights[0] = (self.weights[0] if len(at) else -np.inf), 0.0

    def score(self, text: str | None) -> float:
        idx = features(text or "", self.hashes, self.bits)
        idx = np.unique(idx[self.weights[idx] != 0.0])
        with np.errstate(over="ignore"):
            return float(1 / (1 + np.exp(-(self.bias + self.weights[idx].sum()))))


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (0 or 1) of each document."""
    s, shared = settings, documents.sparkSession.sparkContext.broadcast(model)

    @released
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, s)
        for b in batches:
            p = np.array([own.score(x.as_py()) for x in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= s.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by a model of the labels."""
    rows = score(documents, fit(documents, labels, settings), settings)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    s, at = settings, documents.columns.index(text)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @released
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, s)
        for b in batches:
            yield b.filter(pa.array([own.score(x.as_py()) < s.threshold for x in b.column(at)], pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)
