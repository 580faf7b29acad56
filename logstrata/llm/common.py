"""Helpers that the operators share."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.sources import files

_SHIPPED: set[str] = set()


#: Rows and bytes that reach Python at a time: small, as they lie beside the heap.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def ship(spark: SparkSession) -> None:
    """Make an application ready for these operators.

    Sends this package to its executors, which may lack it, and sets the size of
    the batches that Python gets.
    """
    for name, value in _BATCHES.items():
        spark.conf.set(name, value)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = pathlib.Path(__file__).resolve().parent.parent
        base = f"{tempfile.mkdtemp(prefix='ship-')}/{package.name}-package"
        context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Held while a table is written: its shuffle files go when it is there, as they have served.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def staged(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read again.

    Cuts the lineage at a table that every executor can read, so that a lost
    executor costs no more than the stage after it, and random or positional
    values are fixed once.
    """
    spark = df.sparkSession
    path = files.scratch(spark) + "/part"
    before = {name: spark.conf.get(name, None) for name in _WRITING}
    for name, value in _WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_in = path
    return out


def forget(df: DataFrame) -> None:
    """Remove a staged table that nothing will read any more."""
    files.delete(df.sparkSession, df.staged_in)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


#: Most keys that are broadcast to find their documents (about 40 bytes each).
BROADCAST_KEYS = 500_000


def text_hashes() -> tuple[Column, Column]:
    """128 bits that stand for the text of a row."""
    return F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")


def sized(keys: DataFrame) -> DataFrame:
    """A staged table of keys, broadcast if it is small enough."""
    keys = staged(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def without(docs: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``docs`` whose values of ``names`` are no row of ``keys``; null equals null."""
    other = sized(keys.select([F.col(n).alias(f"_{n}") for n in names]).distinct())
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return docs.join(other, same, "left_anti")
