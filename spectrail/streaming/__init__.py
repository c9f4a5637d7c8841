"""Streams: the surface has no windows, watermarks or state. Per-pixel operators are narrow and run on streams as well.

accumulate() keeps a summed spectrum over the micro-batches of a stream of pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.reshape import summed_spectrum


def accumulate(pixels: DataFrame, spectrum: str = "spectrum") -> DataStreamWriter:
    """The sum of all spectra of a stream so far, by channel, as a complete-mode writer."""
    return summed_spectrum(pixels, spectrum).writeStream.outputMode("complete")
