"""Media columns: lossless 8-bit WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints.

A text's UTF-8 bytes, zero-padded to a positive multiple of 64, become the samples of a mono 8-bit WAV. Reading goes
through the wave module. Each frame keeps its strongest local maxima along frequency; each peak is paired with the
strongest peak of some later frames, at fixed distances over a target zone, and a pair is coded as (frequency, frequency,
time difference) with its start time, as in landmark fingerprints (Wang, 2003).

Defined cases: null and empty texts give 64 zero bytes, which have no peak and so empty arrays; equal texts give equal
rows; frames are transformed in blocks, so memory for a long text stays near its own size; a null id stays null;
an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_list, text_bytes

PAD, FRAME, HOP, PEAKS, BLOCK = 64, 256, 128, 3, 4096
#: Frames from a peak to its partners, and the sample value that is silence in unsigned 8-bit WAV.
REACH, SILENCE = (1, 3, 9, 27), 128
#: Rows that a worker turns into media or features at once.
ROWS = 500


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % PAD or PAD * (not data))


def write_wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The samples; ValueError where they aren't mono 8-bit."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return w.readframes(w.getnframes())


def spectra(samples: bytes) -> Iterator[np.ndarray]:
    """Squared magnitudes of Hann-windowed frames, in blocks of frames. The last frame is filled up with silence."""
    x = np.frombuffer(samples, np.uint8)
    count = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME)
    for first in range(0, count, BLOCK):
        n = min(BLOCK, count - first)
        part = x[first * HOP : first * HOP + (n - 1) * HOP + FRAME].astype(np.float64)
        part = np.concatenate([part, np.full((n - 1) * HOP + FRAME - len(part), float(SILENCE))])
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        spec = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window, axis=1)
        yield spec.real**2 + spec.imag**2


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start times (in hops) and codes of the peak pairs, in order of time, frequency and distance."""
    times, bins, best, first = [], [], [], 0
    for power in spectra(samples):
        inner = power[:, 1:-1]
        peak = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-6), inner, 0.0)
        strongest = np.argsort(-peak, axis=1, kind="stable")[:, :PEAKS]
        top = np.sort(strongest, axis=1)
        keep = np.take_along_axis(peak, top, axis=1) > 0
        t = np.broadcast_to(np.arange(first, first + len(power))[:, None], top.shape)
        times.append(t[keep])
        bins.append(top[keep] + 1)
        best.append(np.where(peak.max(axis=1) > 0, strongest[:, 0] + 1, 0))
        first += len(power)
    t, f, best = np.concatenate(times), np.concatenate(bins), np.concatenate(best)
    gap = np.array(REACH)
    later = t[:, None] + gap
    partner = np.where(later < len(best), best[np.minimum(later, len(best) - 1)], 0)
    ok = partner > 0
    code = (f[:, None] << 16) | (partner << 8) | gap
    return np.broadcast_to(t[:, None], ok.shape)[ok].astype(np.int32), code[ok].astype(np.int32)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ROWS rows at most."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        data = [x.as_py() for x in batch.column(1)]
        media = pa.array([write_wav(pad(x)) for x in data], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), media], ["doc_id", "n_bytes", "media"])


def store_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and media, the WAV file of each text."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("data"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fp_time", "fp_code"]
    for batch in _parts(batches):
        rows, times, codes, ends = [], [], [], [0]
        for media in batch.column(2):
            media = media.as_py()
            payload = read_wav(media)
            t, c = fingerprint(payload)
            times.append(t)
            codes.append(c)
            ends.append(ends[-1] + len(t))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest()))
        if rows:
            n, sha, crc, size, media_sha = zip(*rows, strict=True)
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(media_sha)]
            arrays += [flat_list(np.concatenate(x), ends, pa.int32()) for x in (times, codes)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def fingerprint_media(media: DataFrame) -> DataFrame:
    """What is read back from each stored WAV: sizes, digests, and the time-coded pair arrays fp_time and fp_code."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fp_time array<int>, fp_code array<int>"
    return media.mapInArrow(_features, schema)
