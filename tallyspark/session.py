"""Session settings the operators are designed for, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PARTITION_BYTES = 128 * 1024 * 1024

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    # a Bloom filter of arriving ids, some 16 M of them, may reduce what they are joined with
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "128m",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # spares a stack capture per column expression while plans are put together
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def cluster_settings(shuffled_bytes: int) -> dict[str, str]:
    """Settings for a job whose widest shuffle moves that many bytes.

    AQE merges shuffle partitions up to the advisory size but starts no further ones, so
    there must be enough of them to begin with.
    """
    partitions = max(200, -(-shuffled_bytes // PARTITION_BYTES))
    return {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def local_session(app: str, cores: str | int = "*", **settings: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    for key, value in {**SETTINGS, **defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tallyspark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put_down(rows: DataFrame, label: str) -> DataFrame:
    """Writes rows to a scratch folder and reads them back: what made them runs once."""
    folder = scratch_folder(rows.sparkSession, label)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


@contextmanager
def held(rows: DataFrame, label: str) -> Iterator[DataFrame]:
    """As ``put_down``, for as long as the block runs; then its files are removed."""
    spark = rows.sparkSession
    folder = scratch_folder(spark, label)
    try:
        rows.write.parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
