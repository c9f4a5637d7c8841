"""Texts as chunks with their own lists of words, so that what is known of a word is joined once for each chunk.

A chunk is a row: the texts of a task up to some megabytes (a longer text has a chunk of its own), its distinct words with
their counts, and each text as places in that list. Joins by word then move a row for each chunk and distinct word, not
for each occurrence, and a frequent word has as many rows as there are chunks, which a join can split. What comes back is
gathered by chunk, whose size is bounded, and joined with the chunk's one row.

Words are what is left between white space in ASCII after the bytes of a text have been translated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_bytes

#: Lower case for A-Z; white space in ASCII parts words.
LOWER = bytes(range(256)).lower()
#: Bytes of text after which a chunk ends.
CHUNK = 16 << 20
SCHEMA = "chunk long, ids array<long>, sizes binary, at binary, words array<string>, grams array<array<int>>, n0 array<long>, n1 array<long>"
NAMES = ["chunk", "ids", "sizes", "at", "words", "grams", "n0", "n1"]


class Places(dict):
    """Word to its place in the order of first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def grams_of(at: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of n words inside texts, as rows, and the text of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(at) < n:
        return np.zeros((0, n), np.int32), owner[:0]
    runs, inside = np.lib.stride_tricks.sliding_window_view(at, n), owner[n - 1 :] == owner[: len(at) - n + 1]
    return runs[inside], owner[: len(at) - n + 1][inside]


def _row(chunk: int, places: Places, ids: list, kinds: list, sizes: list, parts: list, n: int) -> pa.RecordBatch:
    sizes, kinds = np.array(sizes, np.int32), np.array(kinds, np.int8)
    at = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if n == 1:
        counts = [np.bincount(at[np.repeat(kinds == k, sizes)], minlength=len(places)) for k in (0, 1)]
        grams, features = None, at
    else:
        grams, features, counts, known = [], [], [[], []], 0
        for size in range(1, n + 1):
            runs, owner = grams_of(at, sizes, size)
            own, back = np.unique(runs, axis=0, return_inverse=True)
            for k in (0, 1):
                counts[k].append(np.bincount(back.ravel()[kinds[owner] == k], minlength=len(own)))
            grams += own.tolist()
            features.append(back.ravel().astype(np.int32) + np.int32(known))
            known += len(own)
        counts, features = [np.concatenate(c) for c in counts], np.concatenate(features)
    columns = [[chunk], [ids], [sizes.tobytes()], [zstandard.ZstdCompressor(level=1).compress(features.tobytes())], [[w.decode() for w in places]], [grams], *([c.tolist()] for c in counts)]
    kinds_of = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], NAMES)


def chunks(rows: DataFrame, table: bytes, n: int = 1, size: int = CHUNK) -> DataFrame:
    """Chunks of rows (id, kind, text), kind 0 or 1: ids, words of each text (int32), places of all runs of 1 to n words,
    shorter ones first and each in the order of the texts (int32, packed with Zstandard), the distinct words, the distinct runs as places of
    words (null for n = 1, where they are the words), and how often texts of either kind hold each run."""

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, places, held, own = (TaskContext.get().partitionId() << 32), Places(), 0, ([], [], [], [])
        for b in batches:
            for i, kind, data in zip(*(b.column(c).to_pylist() for c in (0, 1)), b.column(2), strict=True):
                data = data.as_py()
                words = data.translate(table).split()
                for values, value in zip(own, (i, kind, len(words), np.fromiter(map(places.__getitem__, words), np.int32, len(words))), strict=True):
                    values.append(value)
                held += len(data)
                if held >= size:
                    yield _row(chunk, places, *own, n)
                    chunk, places, held, own = chunk + 1, Places(), 0, ([], [], [], [])
        if own[0]:
            yield _row(chunk, places, *own, n)

    return rows.select(F.col("id").cast("long"), F.col("kind").cast("int"), text_bytes("text")).mapInArrow(cut, SCHEMA)


def word_rows(chunked: DataFrame) -> DataFrame:
    """(chunk, at, word, n0, n1): the distinct words of each chunk of single words."""
    return chunked.select("chunk", F.posexplode(F.arrays_zip("words", "n0", "n1")).alias("at", "w")).select("chunk", "at", F.col("w.words").alias("word"), F.col("w.n0").alias("n0"), F.col("w.n1").alias("n1"))


def by_text(chunked: DataFrame, values: DataFrame, schema: str, f: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], list]) -> DataFrame:
    """Rows (id, and the columns of f) of each text. values: chunk, at, and a column for each array that f gets, in the
    order of the chunk's runs: f(sizes, at, arrays) gives a column for each of schema but the id."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = [c for c in values.columns if c not in ("chunk", "at")]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        (ids,), (sizes,), (at,) = (left.column(c).to_pylist() for c in ("ids", "sizes", "at"))
        order = np.argsort(right.column("at").to_numpy())
        arrays = [right.column(c).to_numpy()[order] for c in kinds]
        found = f(np.frombuffer(sizes, np.int32), np.frombuffer(zstandard.ZstdDecompressor().decompress(at), np.int32), arrays)
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, found)], names)

    plain = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    empty = pa.table({x.strip().split(" ")[0]: pa.array([], plain[x.strip().split(" ")[1]]) for x in schema.split(",")})
    left = chunked.select(F.col("chunk").alias("_chunk"), "ids", "sizes", "at").groupBy("_chunk")
    return left.cogroup(values.groupBy("chunk")).applyInArrow(join, schema)
