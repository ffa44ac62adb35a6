"""Helpers shared by the operators: tables, written intermediate results, held-out folds."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

import tallyspark
from tallyspark.session import scratch_folder

#: Most words whose hashes a Python worker remembers; others are hashed again.
REMEMBERED_WORDS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    context, package = spark.sparkContext, Path(tallyspark.__file__).parent
    if not getattr(context, "_tallyspark_shipped", False):
        base = str(Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark")
        context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
        context._tallyspark_shipped = True


def per_value(function: Callable, kind: str) -> Callable[[Column], Column]:
    """A column function that applies a Python function to each value, in Arrow batches."""
    ship(SparkSession.active())

    @pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([function(value) for value in values], dtype=object)

    return apply


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back, which cuts its lineage.

    A lost executor then costs a reread instead of a recomputation.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, f"llm-{name}")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Removes the files of a stash that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def remainder(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key gives null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(labels: DataFrame, column: str, in_training: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled (doc_id, label), those with the smallest hashes of doc_id.

    A document labelled twice counts once, with the larger label. Rows with a null id or
    label take no part.
    """
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & in_training)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


_claimed: list[dict] = []


def claim(memory: dict) -> None:
    """Empties the memory that another operator has filled in this Python worker before."""
    if not _claimed or _claimed[0] is not memory:
        for other in _claimed:
            other.clear()
        _claimed[:] = [memory]


class Remembered(dict):
    """A bounded memory of a pure function's values: looks like a dict that has every key."""

    def __init__(self, function: Callable, most: int = REMEMBERED_WORDS):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        claim(self)
        value = self.function(key)
        if len(self) < self.most:
            self[key] = value
        return value


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


_STEPS = np.arange(1 << 16)


def spread(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places low .. low + size - 1 of every range, one range after the other."""
    places = np.repeat(lows - np.cumsum(sizes) + sizes, sizes)
    places += _STEPS[: len(places)] if len(places) <= len(_STEPS) else np.arange(len(places))
    return places
