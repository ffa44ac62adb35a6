"""Orders and settlements as Parquet tables.

A table is a folder of complete versions ``v=0``, ``v=1``, …; replacing rows means writing
the next version, because Spark cannot overwrite what it is reading and plain files know
no MERGE. A version is a folder of ``batch_id=…`` folders, and appending means writing the
next of them. A batch counts once its ``_SUCCESS`` marker exists, a version once its first
batch does: a job that dies half way changes nothing, and its leftovers are overwritten by
the next attempt. Writing one batch again replaces it, so a retried append never doubles
rows. One writer per table is assumed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch_id"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def remove(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.delete(path, True)


def _numbers(spark: SparkSession, root: str, label: str) -> list[int]:
    """Numbers of the ``label=…`` folders, highest first."""
    path, files = _path(spark, root)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    found = [name.split("=", 1)[1] for name in names if name.startswith(f"{label}=")]
    return sorted(map(int, found), reverse=True)


def finished_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished batches, highest first."""
    found = _numbers(spark, folder, BATCH)
    return [batch for batch in found if exists(spark, f"{batch_folder(folder, batch)}/_SUCCESS")]


def version_folder(root: str, version: int) -> str:
    return f"{root}/v={version}"


def batch_folder(folder: str, batch: int) -> str:
    return f"{folder}/{BATCH}={batch}"


def _versions(spark: SparkSession, root: str) -> Iterator[int]:
    """Complete versions, highest first."""
    for version in _numbers(spark, root, "v"):
        if exists(spark, f"{batch_folder(version_folder(root, version), 0)}/_SUCCESS"):
            yield version


def latest_version(spark: SparkSession, root: str) -> int:
    """Highest complete version, -1 for none."""
    return next(_versions(spark, root), -1)


def write_version(rows: DataFrame, root: str, options: dict[str, str] | None = None) -> int:
    """Writes the next version and returns its number.

    Leftovers of a lost attempt at it go first: a batch behind its first one would count.
    """
    spark = rows.sparkSession
    version = latest_version(spark, root) + 1
    remove(spark, version_folder(root, version))
    append_batch(rows, version_folder(root, version), 0, options)
    return version


def append_rows(rows: DataFrame, root: str, options: dict[str, str] | None = None) -> int:
    """Adds rows to the current version as one more batch and returns its number."""
    spark = rows.sparkSession
    version = latest_version(spark, root)
    if version < 0:
        write_version(rows, root, options)
        return 0
    folder = version_folder(root, version)
    batch = next_batch(spark, folder)
    append_batch(rows, folder, batch, options)
    return batch


def read_table(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The current version."""
    version = latest_version(spark, root)
    if version < 0:
        return spark.createDataFrame([], schema)
    return read_batches(spark, version_folder(root, version), schema)


def truncate(spark: SparkSession, root: str, schema: T.StructType) -> int:
    """An empty next version with the same columns."""
    return write_version(spark.createDataFrame([], schema), root)


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Removes all but the ``keep`` latest complete versions; returns those removed.

    Unfinished versions stay for the next attempt. A query that still reads an old version
    loses its files, so keep as many as may be in use.
    """
    if keep < 1:
        raise ValueError("keep at least the current version")
    old = list(_versions(spark, root))[keep:]
    for version in old:
        remove(spark, version_folder(root, version))
    return old


def next_batch(spark: SparkSession, folder: str) -> int:
    """The number behind the last finished batch: an unfinished one there is replaced."""
    return max(finished_batches(spark, folder), default=-1) + 1


def append_batch(
    rows: DataFrame, folder: str, batch: int, options: dict[str, str] | None = None
) -> None:
    """Adds one batch, replacing an earlier attempt at it. ``options`` go to the writer."""
    rows.write.mode("overwrite").options(**options or {}).parquet(batch_folder(folder, batch))


def stage_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """Writes one batch without its marker: nobody sees it before ``publish_batch``."""
    unmarked = rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    unmarked.mode("overwrite").parquet(batch_folder(folder, batch))


def staged_batch(spark: SparkSession, folder: str, batch: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(batch_folder(folder, batch))


def publish_batch(spark: SparkSession, folder: str, batch: int) -> None:
    """Makes a staged batch visible, all of it at once."""
    path, files = _path(spark, f"{batch_folder(folder, batch)}/_SUCCESS")
    files.create(path, True).close()


def drop_batch(spark: SparkSession, folder: str, batch: int) -> None:
    remove(spark, batch_folder(folder, batch))


def current_folder(spark: SparkSession, root: str) -> str | None:
    """The folder of the current version, None without one."""
    version = latest_version(spark, root)
    return version_folder(root, version) if version >= 0 else None


def read_batches(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    since: int = 0,
    before: int | None = None,
) -> DataFrame:
    """Appended batches from number ``since`` on and below ``before``, complete ones only."""
    complete = [
        batch_folder(folder, batch)
        for batch in finished_batches(spark, folder)
        if batch >= since and (before is None or batch < before)
    ]
    if not complete:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*complete)


def highest_id(spark: SparkSession, folder: str, before: int | None = None) -> int:
    """Highest id of the batches below ``before``, 0 without rows.

    Each batch is numbered on from those before it, so the latest one that holds rows decides
    and the others are not read.
    """
    for batch in finished_batches(spark, folder):
        if before is None or batch < before:
            rows = spark.read.schema("id bigint").parquet(batch_folder(folder, batch))
            highest = rows.agg(F.max("id")).first()[0]
            if highest is not None:
                return highest
    return 0


def cluster_by_id(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows ranged and sorted by id.

    Written in this order, files and row groups hold narrow id ranges and id filters skip
    the rest. One shuffle, worth it once per table; generated orders already come so.
    """
    return rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """A catalog table bucketed and sorted by ``key``.

    Orders bucketed by ``id`` and settlements bucketed by ``order_id`` with one bucket
    count join for updates, upserts and the settled-before check without any shuffle.
    """
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
