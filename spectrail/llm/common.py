"""What the text operators share: the durable folder, written tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text in lower case, with a space for everything in ASCII but letters and digits.
NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


class WordHashes(dict):
    """64-bit hashes of words; long words aren't kept, and the table is emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


@functools.cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spectrail-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir. One of our own only where it is unset and all runs on one
    machine; ValueError on a cluster, where a local folder would lose rows."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = _own_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> Iterator[None]:
    """While actions run here, at most `rows` rows of `size` bytes go to a Python worker at once: texts and sets are wide."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor costs no recomputation beyond it."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(f: Callable) -> Callable:
    """A function for mapInArrow that, when a task ends, gives the memory it used back to the machine: workers are used
    again, and the next task may be another stage's."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        yield from f(batches, *args, **kwargs)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def text_bytes(col: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit("")).cast("binary")


def flat_list(values, offsets, kind: pa.DataType) -> pa.Array:
    """A list array from one flat NumPy array and the offsets of its rows."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
