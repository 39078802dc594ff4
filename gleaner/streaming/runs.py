"""Structured Streaming runs over the event files: each drains what is there and returns its result.

Sinks and checkpoints live in the session's shared folder (``spark.checkpoint.dir``), so a lost executor or a restarted
driver goes on from the last committed batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import proposals


def _folder(spark: SparkSession) -> str:
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-gleaner-")
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


#: Files that a micro-batch takes at most.
FILES = 64


def drained(spark: SparkSession, sf_dir: str, name: str, work: Callable[[DataFrame], DataFrame], files: int = FILES, where: str | None = None) -> DataFrame:
    """Run ``work`` over a table's files as a stream until they are read; its upserts' last state is returned.

    A later run with the same folder ``where`` goes on from its checkpoint with the files that are new.

    The stream runs in update mode; each batch is written under its number, and a later batch's row replaces an earlier one's of the same key.
    """
    where = where or _folder(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet*")
    out = work(stream)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{where}/out").parquet(f"{where}/out/batch=*").drop("batch")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("r")).select(*keys, "r.*")


def daily_counts(spark: SparkSession, sf_dir: str, files: int = FILES) -> DataFrame:
    """Events a day and type by event-time windows with a watermark."""

    def work(s: DataFrame) -> DataFrame:
        timed = s.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "40 days")
        return timed.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")

    return _last(drained(spark, sf_dir, "events", work, files), ["day", "event_type"])


def first_requests(spark: SparkSession, sf_dir: str, files: int = FILES) -> DataFrame:
    """The first event of each user and type: keyed state that later events do not change."""
    return _last(drained(spark, sf_dir, "events", lambda s: s.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts")), files), ["user_id", "event_type"])


#: Provider of the keyed state that processors with timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def reviewed_proposals(spark: SparkSession, sf_dir: str, files: int = FILES, where: str | None = None, capacity: int = proposals.CAPACITY, pending_days: int = proposals.PENDING_DAYS) -> DataFrame:
    """The outcome of every proposal and review among the events."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:  # the stream is drained when ``drained`` returns
        return drained(spark, sf_dir, "events", lambda s: proposals.reviewed(s, capacity, pending_days), files, where).drop("_batch")
    finally:
        spark.conf.set(setting, before)
