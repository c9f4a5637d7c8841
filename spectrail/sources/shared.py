"""Tables written to the folder that all machines share, to cut lineage in loops."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spectrail-')}"


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir of the session. A folder of our own only where it is unset and all runs on one machine;
    ValueError on a cluster, where a local folder would lose rows."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = _own_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
