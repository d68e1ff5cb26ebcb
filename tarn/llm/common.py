"""What the operators share: row identity, lasting tables, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.shared import shared_folder

#: Rows that a Python worker turns into Python objects at a time.
SLICE_ROWS = 512
#: Bytes of a batch sent to a Python worker: held once by the JVM and once or twice by the worker.
BATCH_BYTES = 8 * 1024 * 1024
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULTS = ("67108864", "67108864b", "64MB")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; read by Spark alone, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if they see that folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def production(spark: SparkSession) -> SparkSession:
    """The session, with batches to Python workers of ``BATCH_BYTES`` at most unless it sets that itself.

    The queries and the pipeline call it; operators leave a session's settings as they are.
    """
    if spark.conf.get(_BATCH_CONF) in _BATCH_DEFAULTS:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return spark


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        fs.deleteOnExit(hadoop)
    else:
        fs.delete(hadoop, True)
        fs.cancelDeleteOnExit(hadoop)


def lasting(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read back.

    It cuts the lineage and survives a lost executor; the plan runs once, where
    ``checkpoint()`` would run its last stage twice. The files go when the session's JVM ends, or
    when ``forget`` is told that nothing needs them any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lasting-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, at_exit=True)
    found = spark.read.schema(df.schema).parquet(path)
    found._lasting_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete the files of lasting tables, from which all that was needed has been written to others."""
    for df in tables:
        if path := getattr(df, "_lasting_path", None):
            _delete(df.sparkSession, path)


def rest_class(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as the text 'null'."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % divisor


def trim() -> None:
    """Give memory that earlier work has freed back to the system: Python workers are used again and again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # the C library has no such call
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most."""
    trim()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    trim()


def series_slices(parts: Iterator[pd.Series], rows: int = SLICE_ROWS) -> Iterator[tuple[pd.Series, list[list]]]:
    """Each series, and its values in lists of so many at most."""
    trim()
    for part in parts:
        yield part, [part.iloc[k : k + rows].tolist() for k in range(0, len(part), rows)]
    trim()
