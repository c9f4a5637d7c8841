"""Token counts of byte-level BPE vocabularies, without making identifiers.

A piece of pre-split text starts as one symbol for each byte, in a doubly linked list; a heap holds the ranks of the
neighbours that may merge. The lowest-ranked pair, the leftmost of equals, is popped and merged until none is left: the
count is the number of initial symbols minus the number of merges. Counts of pieces are kept in a table in each Python
worker, as most pieces recur; it is bounded in entries and in bytes, and long pieces aren't kept.

The vocabulary is a tokenizers .json file with a byte-level pre-tokenizer. Added tokens inside a text count as one token
each, as the library does by default; no begin or end tokens are added, and nothing is cut or padded.

Defined cases: null and empty texts have no bytes and no tokens; a text of any length is counted whole, in time
n log n of its longest piece; repeated rows are counted alike; a null id stays null; an empty table gives an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pre-splitting pattern of byte-level BPE; \s is spelled out as the White_Space property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


#: Characters of the longest piece that is kept, and bytes that each entry allowed stands for.
LONG, ENTRY = 64, 150


class Counter(dict):
    """Piece to number of tokens; emptied when full."""

    def __init__(self, path: str, most: int = 1_500_000) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("unk_token"):
            raise ValueError("only byte-level BPE without a prefix space or normalizer is supported")
        if not pre.get("use_regex", True) or any(model.get(x) for x in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("other ways to split, merge or mark pieces aren't supported")
        added = spec["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
            raise ValueError("added tokens that strip or need whole words aren't supported")
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.split = regex.compile(PATTERN)
        self.symbols, self.most, self.held = byte_symbols(), most, 0
        merges = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}

    def __missing__(self, piece: str) -> int:
        count = self.merged(piece)
        if len(piece) <= LONG:
            size = 110 + 2 * len(piece) * (1 + (not piece.isascii()))  # about what the piece and its entry take
            if len(self) >= self.most or self.held + size > ENTRY * self.most:
                self.clear()
                self.held = 0
            self.held += size
            self[piece] = count
        return count

    def merged(self, piece: str) -> int:
        symbol, rank = self.symbols, self.ranks.get
        own = [symbol[b] for b in piece.encode("utf-8", "surrogatepass")]
        count = len(own)
        if count < 2:
            return count
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(r, i, own[i], own[i + 1]) for i in range(count - 1) if (r := rank((own[i], own[i + 1]))) is not None]
        heapq.heapify(heap)
        end = count
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if own[i] != a or j >= end or own[j] != b:
                continue  # one of the two has merged since
            own[i], own[j] = a + b, ""
            count -= 1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank((own[i], own[k]))) is not None:
                    heapq.heappush(heap, (r, i, own[i], own[k]))
            if (h := before[i]) >= 0 and (r := rank((own[h], own[i]))) is not None:
                heapq.heappush(heap, (r, h, own[h], own[i]))
        return count

    def count(self, text: str) -> int:
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            return len(parts) - 1 + sum(self._plain(x) for x in parts)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split.findall(text)))


@functools.lru_cache(1)
def counter(path: str) -> Counter:
    """One for each Python worker, so that what it has learnt serves the worker's later tasks."""
    return Counter(path)


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([own.count(x.as_py()) for x in b.column(2)], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    data = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), data.alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
