"""Labels and structured data for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.functions import structured_data as sd
from logstrata.functions.priority import priority_of
from logstrata.schema import facility_dim, severity_dim


def with_labels(rows: DataFrame) -> DataFrame:
    """Severity and facility names and the priority of each row.

    The dimensions are constants of 8 and 24 rows, so broadcasting them is
    bounded. An unknown code keeps its row, without a name.
    """
    spark = rows.sparkSession
    out = rows
    for field, dim in (
        ("severity", severity_dim(spark)),
        ("facility", facility_dim(spark)),
    ):
        named = dim.select(
            F.col("code").alias(field),
            F.col("name").alias(f"{field}_name"),
            F.col("label").alias(f"{field}_label"),
        )
        out = out.join(F.broadcast(named), field, "left")
    return out.withColumn("priority", priority_of(F.col("facility"), F.col("severity")))


def facet_options(facet: DataFrame, field: str) -> DataFrame:
    """Full option list of a code with its facet total, NULL if it has none.

    ``facet`` has one row per code (value, total).
    """
    dims = {"severity": severity_dim, "facility": facility_dim}
    dim = dims[field](facet.sparkSession).withColumnRenamed("code", "value")
    return dim.join(facet, "value", "left").select("value", "name", "label", "total")


def sd_rows(rows: DataFrame) -> DataFrame:
    """One row per structured-data parameter: (row_id, sd_id, key, value)."""
    ids = rows.filter(~F.col("structured_data").isin("-", "")).select(
        "row_id", F.explode(sd.parse(F.col("structured_data"))).alias("sd_id", "params")
    )
    return ids.select("row_id", "sd_id", F.explode("params").alias("key", "value"))


def sd_text(rows: DataFrame) -> DataFrame:
    """Each row's structured data as one line of text."""
    parsed = sd.parse(F.col("structured_data"))
    return rows.select("row_id", sd.flatten(parsed).alias("structured_text"))
