"""Access to the driver's Parquet tables and the session settings every entry point shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark opens the path, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with the settings tests and benchmarks use (UTC, adaptive execution on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def balanced(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores, dealt anew so that costly expressions use them all; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint directory, its lineage cut.

    The directory is ``spark.checkpoint.dir``; only where that is unset (a local test) a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-gleaner-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint directory; only where that is unset (a local test) a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-gleaner-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Of what is run in here, the shuffles' files are removed when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def written(df: DataFrame, where: str) -> DataFrame:
    """``df`` written as Parquet, its lineage cut: a fraction of a checkpoint's size, until ``dropped``."""
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def dropped(spark: SparkSession, *where: str) -> None:
    """Delete tables that were ``written``."""
    for w in where:
        path = spark._jvm.org.apache.hadoop.fs.Path(w)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the session runs (once a context)."""
    sc = spark.sparkContext
    if getattr(sc, "_gleaner_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    where = Path(tempfile.mkdtemp(prefix="spark-gleaner-")) / "gleaner.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted((root / "gleaner").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(where))
    sc._gleaner_shipped = True
