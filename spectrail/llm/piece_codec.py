"""Offset-preserving encoding and decoding with SentencePiece BPE models.

Normalisation replaces, at each position, the longest prefix that the model's compiled character map holds (a
double-array trie over UTF-8 bytes and a block of replacement strings), and records for each normalised character which
source bytes it came from. The normalised text is merged into pieces by score, and each piece is projected through that
alignment to a span of bytes of the original text. Characters without a piece fall back to byte pieces, which share the
span of their character.

The text is merged in segments, cut only where no piece of the vocabulary reaches across: before a run of the space
mark, and around characters that no longer piece contains. What a segment gives is kept in a table in each Python worker,
bounded in entries and in bytes; long segments aren't kept.

Defined cases: null and empty texts give no pieces and decode to the empty text; a text of any length is encoded whole,
segment by segment; repeated rows are encoded alike; a null id stays null; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_list, released

SPACE = "▁"
SHORT = 48
#: Characters of the longest segment that is kept, and bytes that each entry allowed stands for.
LONG, ENTRY = 64, 250
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The compiled character map: longest-prefix lookups over UTF-8 bytes."""

    def __init__(self, blob: bytes) -> None:
        self.units, self.strings = (), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """How many bytes the longest known prefix at `at` has (0: none) and what replaces it."""
        units = self.units
        if not units:
            return 0, b""
        node, found, length = self._offset(units[0]), -1, 0
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if (unit & ((1 << 31) | 0xFF)) != data[i]:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                found, length = units[node] & ((1 << 31) - 1), i + 1 - at
        if found < 0:
            return 0, b""
        return length, self.strings[found : self.strings.index(b"\0", found)]


class Codec(dict):
    """Segment to the id and the characters of each of its pieces, as int32 bytes; and what encodes and decodes with it."""

    def __init__(self, path: str, most: int = 900_000) -> None:
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.map, self.most, self.held = CharacterMap(spec.precompiled_charsmap), most, 0
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, t in enumerate(self.types) if t == UNKNOWN)
        self.unknown_surface = model.trainer_spec.unk_surface.encode()
        longer = [p for p in self.ids if len(p) > 1]
        inside = {a for p in longer for a in p}
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            self.cut = re.compile("(?s).+")
        else:
            alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
            self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    # -- normalisation -------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the source byte where it begins."""
        data = text.encode()
        out, at, i = [], [], 0
        while i < len(data):
            n, new = self.map.longest(data, i)
            if not n:
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                new = data[i : i + n]
            for c in new.decode():
                out.append(SPACE if c == " " else c)
                at.append(i)
            i += n
        if self.squeeze:
            kept = [k for k, c in enumerate(out) if c != SPACE or (k and out[k - 1] != SPACE)]
            while kept and out[kept[-1]] == SPACE:
                kept.pop()
            out, at = [out[k] for k in kept], [at[k] for k in kept]
        if not out:
            return "", np.array([len(data)])
        if self.dummy:
            out.insert(0, SPACE)
            at.insert(0, at[0])
        return "".join(out), np.array([*at, len(data)])

    # -- merging -------------------------------------------------------------------------------------------------

    def merge(self, segment: str) -> list[str]:
        """The pieces of a segment: the adjacent pair with the best score merges first, the leftmost of equals."""
        scores = self.scores.get
        own = list(segment)
        end = len(own)
        if end <= SHORT:  # a scan of a few scores beats a heap
            none = -math.inf
            best = [scores(own[i] + own[i + 1], none) for i in range(end - 1)]
            while best and (top := max(best)) > none:
                i = best.index(top)
                own[i] += own.pop(i + 1)
                del best[i]
                if i < len(best):
                    best[i] = scores(own[i] + own[i + 1], none)
                if i:
                    best[i - 1] = scores(own[i - 1] + own[i], none)
            return own
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(-s, i, x) for i in range(end - 1) if (s := scores(x := own[i] + own[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x = heapq.heappop(heap)
            if not own[i] or (j := after[i]) >= end or len(own[i]) + len(own[j]) != len(x):
                continue  # one of the two has merged since
            own[i], own[j] = x, ""
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (s := scores(y := x + own[k])) is not None:
                    heapq.heappush(heap, (-s, i, y))
            if (h := before[i]) >= 0 and (s := scores(y := own[h] + x)) is not None:
                heapq.heappush(heap, (-s, h, y))
        return [x for x in own if x]

    def __missing__(self, segment: str) -> bytes:
        """Byte pieces before the last of their character count as 0 characters."""
        found = array("i")
        for piece in self.merge(segment):
            if (i := self.ids.get(piece)) is not None:
                found.extend((i, len(piece)))
            elif self.bytes:
                for k in piece.encode():
                    found.extend((self.bytes[k], 0))
                found[-1] = 1
            else:
                found.extend((self.unknown, 1))
        value = found.tobytes()
        if len(segment) <= LONG:
            size = 150 + 4 * len(segment) + len(value)  # about what the two objects and their entry take
            if len(self) >= self.most or self.held + size > ENTRY * self.most:
                self.clear()
                self.held = 0
            self.held += size
            self[segment] = value
        return value

    # -- whole texts ---------------------------------------------------------------------------------------------

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first and the end byte in the source of each piece."""
        if not text:
            return (np.zeros(0, np.int32),) * 3
        if self.map.units or self.squeeze:
            normal, at = self.normalise(text)
        else:  # every character is its own longest prefix
            normal, at = SPACE * self.dummy + text.replace(" ", SPACE), None
        found = np.frombuffer(b"".join(map(self.__getitem__, self.cut.findall(normal))), np.int32).reshape(-1, 2)
        ids, size = found[:, 0], found[:, 1]
        if at is None:
            at = self._plain_starts(text)
        ends = np.cumsum(size)
        early = size == 0  # byte pieces before the last of their character, whose span they share
        return ids, at[ends - size].astype(np.int32), at[ends + early].astype(np.int32)

    def _plain_starts(self, text: str) -> np.ndarray:
        """The alignment of the identity map: a character begins where its UTF-8 bytes do; the prefix has no bytes."""
        if text.isascii():
            starts = np.arange(len(text) + 1)
        else:
            data = np.frombuffer(text.encode(), np.uint8)
            starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        return np.concatenate([[0], starts]) if self.dummy else starts

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, the space mark as a space, runs of byte pieces as UTF-8, without the prefix space."""
        table = self._surfaces
        raw = b"".join([table[i] for i in ids.tolist()])
        text = raw.decode("utf-8") if self._whole(raw) else self._repaired(ids)
        if (self.dummy or self.squeeze) and text.startswith(" ") and len(ids) and self.types[ids[0]] == NORMAL:
            text = text.lstrip(" ") if self.squeeze else text[1:]
        return text

    @functools.cached_property
    def _surfaces(self) -> list[bytes]:
        one = lambda p, t: b"" if t == CONTROL else self.unknown_surface if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode()
        return [one(p, t) for p, t in zip(self.pieces, self.types, strict=True)]

    @staticmethod
    def _whole(raw: bytes) -> bool:
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    def _repaired(self, ids: np.ndarray) -> str:
        """For ids that no text gives: each byte of a byte run that isn't part of valid UTF-8 becomes U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            rest = bytes(run)
            while rest:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(rest[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                rest = rest[n:]
            run.clear()

        for i in ids.tolist():
            if self.types[i] == BYTE:
                run.extend(self._surfaces[i])
            else:
                flush()
                out.append(self._surfaces[i].decode())
        flush()
        return "".join(out)


@functools.lru_cache(1)
def codec(path: str, most: int = 900_000) -> Codec:
    """One for each Python worker, so that what it has learnt serves the worker's later tasks."""
    return Codec(path, most)


def encode(documents: DataFrame, model: str, key: str = "doc_id", text: str = "text", batch_pieces: int = 2_000_000, cached: int = 900_000) -> DataFrame:
    """doc_id, ids, begins and ends (byte spans in the source) and decoded, the text that the ids decode to.

    cached: segments that each Python worker keeps, at most; all of them hold ENTRY times as many bytes at most.
    """
    names = ["doc_id", "ids", "begins", "ends", "decoded"]

    @released
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, cached)

        def batch(keys: list, rows: list) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
            lists = [flat_list(np.concatenate([r[k] for r in rows]), offsets, pa.int32()) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *lists, pa.array([own.decode(r[0]) for r in rows])], names)

        for b in batches:
            keys, rows, size = [], [], 0
            for k, x in zip(b.column(0), b.column(1), strict=True):
                keys.append(k.as_py())
                rows.append(own.encode(x.as_py()))
                size += len(rows[-1][0])
                if size > batch_pieces:
                    yield batch(keys, rows)
                    keys, rows, size = [], [], 0
            if rows:
                yield batch(keys, rows)

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")
