"""What the training-data operators share: tables, batches, shared storage, word pattern."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to Python at once. Documents may be long, so batches are small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a worker holds few long texts at a time.

    The setting stays on the session: results are lazy, and it is read when they are computed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint directory.

    It is read from ``spark.checkpoint.dir``; only where that is unset (a local test) a
    temporary folder of this machine becomes the checkpoint directory.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(sc, "_gleaner_shared", None)
        if where is None:
            where = "file://" + tempfile.mkdtemp(prefix="spark-gleaner-")
            sc._gleaner_shared = where
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_dir(spark: SparkSession, where: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint directory, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_kept: dict = {}


def keep(owner: str, key, make: Callable):
    """What ``make`` gives, kept in this Python worker for as long as it works for ``owner``.

    Spark reuses its workers, so one that changes to another operator lets go of the first one's tables and memos.
    """
    if _kept.get("owner") != owner:
        _kept.clear()
        _kept["owner"] = owner
        _release()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_of_ids(ids) -> int:
    """Unsigned crc32 of token ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; ``GLEANER_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("GLEANER_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
