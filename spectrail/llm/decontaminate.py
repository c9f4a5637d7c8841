"""Benchmark decontamination by greedy string tiling of documents and test items.

Words of a document and of an item are compared in normal form. Karp-Rabin hashes of min_match words (of all words of an
item that has fewer) are the seeds; a document is tried against the items that share seeds which cover enough of them.
Tiling then takes, again and again, the longest match of unmarked words and marks it (Wise, 1993), so that passages in
another order are found as well. An item is leaked by a document if tiles cover at least `coverage` of its words.

Matches are kept as runs on diagonals, never as pairs of places, so the memory for a document and an item grows with the
sum of their lengths and their runs, also where both repeat few words.

The items are broadcast in blocks of at most block_bytes of text (or one item), by a count of their bytes; a larger
benchmark takes more passes over the documents, one block after another, and the driver holds one block at a time.

Defined cases: items or documents without words match nothing; repeated items count once; of matches of equal length the
first in the document, then in the item, is marked first; texts of any length are compared whole; repeated or null
document ids each get their rows; a null item text has no words, a null item id is reported as null; empty tables give
an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NORMAL, WordHashes, discard, materialize, released

BASE = np.uint64(0x9E3779B97F4A7C15)
TILES = "array<struct<doc_word:int,item_word:int,words:int>>"


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of each run of `width` words."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, width):
        out = out * BASE + words[k : k + count]
    return out


def runs(at: np.ndarray, seeds: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Rows (document place, item place, seeds) of the longest runs of equal seeds. at: places of the document in rising
    order, with seeds there; item: the seed at each place of the item. Holds the runs and one item place's matches."""
    order = np.argsort(seeds, kind="stable")
    values, begins = np.unique(seeds[order], return_index=True)
    begins, places = np.append(begins, len(seeds)), at[order]
    none = np.zeros(0, np.int64)
    found, open_at, open_from = [], none, none  # where open runs would go on, and the item place where they began
    for j in range(len(item) + 1):
        x = np.searchsorted(values, item[j]) if j < len(item) else len(values)
        here = places[begins[x] : begins[x + 1]] if x < len(values) and values[x] == item[j] else none
        on = np.isin(open_at, here, assume_unique=True)
        if not on.all():
            since = open_from[~on]
            found.append(np.column_stack([open_at[~on] - (j - since), since, j - since]))
        since = np.full(len(here), j)
        since[np.searchsorted(here, open_at[on])] = open_from[on]
        open_at, open_from = here + 1, since
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def tile(doc: np.ndarray, item: np.ndarray, found: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles (document word, item word, words) from the runs of seeds of `width` words."""
    found, tiles = found + [0, 0, width - 1], []
    while len(found):
        longest = found[found[:, 2] == found[:, 2].max()]
        i, j, n = longest[np.lexsort((longest[:, 1], longest[:, 0]))[0]].tolist()
        same = doc[i : i + n] == item[j : j + n]
        if not same.all():  # hashes of seeds met by chance: what is equal stays
            cuts = np.flatnonzero(~np.concatenate([[False], same, [False]]))
            parts = np.column_stack([i + cuts[:-1], j + cuts[:-1], np.diff(cuts) - 1])
            found = np.concatenate([found[(found != [i, j, n]).any(axis=1)], parts[parts[:, 2] >= width]])
            continue
        tiles.append((i, j, n))
        # what the marked words leave of each run: before, between and after the two places where they cut it
        size = found[:, 2]
        first, second = np.sort(np.stack([i - found[:, 0], j - found[:, 1]]), axis=0)
        pieces = [(np.zeros_like(size), first), (first + n, second), (second + n, size)]
        left = [(np.clip(a, 0, size), np.clip(b, 0, size)) for a, b in pieces]
        left = [np.column_stack([found[:, 0] + a, found[:, 1] + a, b - a]) for a, b in left]
        found = np.concatenate([x[x[:, 2] >= width] for x in left])
    return tiles


class Index:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int, coverage: float) -> None:
        hashes = WordHashes()
        self.coverage, self.hashes = coverage, hashes
        self.ids = [i for i, _ in items]
        self.items = [word_hashes(t, hashes) for _, t in items]
        self.need = [max(1, math.ceil(coverage * len(w) - 1e-9)) for w in self.items]
        self.by_width: dict[int, tuple[np.ndarray, ...]] = {}
        for width in {min(min_match, len(w)) for w in self.items} - {0}:
            own = [k for k, w in enumerate(self.items) if min(min_match, len(w)) == width]
            seeds = [rolling(self.items[k], width) for k in own]
            of = np.repeat(own, [len(s) for s in seeds])
            place = np.concatenate([np.arange(len(s)) for s in seeds])
            seeds = np.concatenate(seeds)
            order = np.argsort(seeds, kind="stable")
            values, starts = np.unique(seeds[order], return_index=True)
            self.by_width[width] = values, np.append(starts, len(seeds)), of[order], place[order]

    def leaks(self, text: str | None) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """(item's number, covered words, tiles) of the items that the text leaks."""
        doc, found = word_hashes(text, self.hashes), []
        for width, (values, starts, of, place) in self.by_width.items():
            windows = rolling(doc, width)
            u = np.minimum(np.searchsorted(values, windows), len(values) - 1)
            at = np.flatnonzero(values[u] == windows)
            if not len(at):
                continue
            hit = np.unique(u[at])
            rows = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in hit])
            for k in np.unique(of[rows]).tolist():
                item, mine = self.items[k], rows[of[rows] == k]
                covered = np.zeros(len(item) + 1, np.int64)
                np.add.at(covered, place[mine], 1)
                np.add.at(covered, place[mine] + width, -1)
                if (np.cumsum(covered[:-1]) > 0).sum() < self.need[k]:
                    continue
                own = at[np.isin(u[at], np.searchsorted(starts, mine, side="right") - 1)]
                tiles = tile(doc, item, runs(own, windows[own], rolling(item, width)), width)
                words = sum(t[2] for t in tiles)
                if words >= self.need[k]:
                    found.append((k, words, tiles))
        return found


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = 32 << 20) -> Iterator[tuple[bool, list[tuple[int | None, str | None]]]]:
    """Whether it is the only one, and the items, of each block that is small enough to broadcast."""
    items = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).distinct()
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 64
    total = items.agg(F.sum(size)).first()[0] or 0
    if total <= block_bytes:
        if total:
            yield True, [(r["id"], r["text"]) for r in items.orderBy("id", "text").collect()]
        return
    # many small parts by hash, packed into blocks by their sizes
    count = 64 * -(-total // block_bytes)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    sizes = items.groupBy(part.alias("part")).agg(F.sum(size).alias("size")).orderBy("part").collect()
    packed, room = [], 0
    for r in sizes:
        if r["size"] > room:
            packed.append([])
            room = block_bytes
        packed[-1].append(r["part"])
        room -= r["size"]
    for own in packed:
        yield False, [(r["id"], r["text"]) for r in items.where(part.isin(own)).orderBy("id", "text").collect()]


@functools.lru_cache(1)
def _index(shared: Broadcast, min_match: int, coverage: float) -> Index:
    """One for each Python worker and block."""
    return Index(shared.value, min_match, coverage)


def find_leaks(documents: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8, key: str = "doc_id", text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, item_words, covered_words and tiles."""
    schema = f"doc_id long, item_id long, item_words long, covered_words long, tiles {TILES}"
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("doc_word", "item_word", "words")]))
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def finder(shared: Broadcast):
        @released
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared, min_match, coverage)
            for b in batches:
                out = [(d.as_py(), index.ids[k], len(index.items[k]), n, [dict(zip(("doc_word", "item_word", "words"), t, strict=True)) for t in tiles]) for d, x in zip(b.column(0), b.column(1), strict=True) for k, n, tiles in index.leaks(x.as_py())]
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], kind)], ["doc_id", "item_id", "item_words", "covered_words", "tiles"])

        return found

    result = documents.sparkSession.createDataFrame([], schema)
    for only, items in blocks(benchmark, text=text, block_bytes=block_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(items)
        part = rows.mapInArrow(finder(shared), schema)
        if not only:
            part = materialize(part, "leaks")
            shared.destroy()
        result = result.union(part)
    return result


def without_leaks(documents: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8, text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """The documents, with all their columns, that leak no item. A null text leaks nothing."""

    def keeper(shared: Broadcast, at: int):
        @released
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared, min_match, coverage)
            for b in batches:
                yield b.filter(pa.array([not index.leaks(x.as_py()) for x in b.column(at)], pa.bool_()))

        return kept

    schema, at, before = documents.schema, documents.columns.index(text), None
    for only, items in blocks(benchmark, text=text, block_bytes=block_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(items)
        documents = documents.mapInArrow(keeper(shared, at), schema)
        if not only:
            documents = materialize(documents, "clean")
            shared.destroy()
            if before is not None:
                discard(before)
            before = documents
    return documents
