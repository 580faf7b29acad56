"""Raw lines from text files, message streams and datagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.text import trim_line


def text_lines(
    spark: SparkSession, path: str, stream: bool = False, **options: str
) -> DataFrame:
    """Lines of text files, one per row in the column ``line``.

    Only a line feed ends a line; Spark would by default also split at a lone
    carriage return. On a stream, ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` bounds a batch.
    """
    reader = spark.readStream if stream else spark.read
    text = reader.options(**options).text(path, lineSep="\n")
    return text.select(F.col("value").alias("line"))


def message_lines(messages: DataFrame, column: str = "value") -> DataFrame:
    """One line per message of a queue, line breaks inside it kept.

    ``messages`` is any DataFrame with a text or binary column, such as a
    Kafka source.
    """
    rest = [c for c in messages.columns if c != column]
    return messages.select(*rest, F.col(column).cast("string").alias("line"))


def datagram_lines(datagrams: DataFrame, column: str = "value") -> DataFrame:
    """Lines of datagrams, each of which may hold several messages."""
    rest = [c for c in datagrams.columns if c != column]
    text = F.replace(F.col(column).cast("string"), F.lit("\r\n"), F.lit("\n"))
    return datagrams.select(*rest, F.explode(F.split(text, "\n")).alias("line"))


def clean(lines: DataFrame) -> DataFrame:
    """Trimmed lines without the blank ones."""
    trimmed: Column = trim_line(F.col("line"))
    return lines.withColumn("line", trimmed).filter(F.col("line") != "")
