"""Reading the base tables, and events as an entity log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_log(events: DataFrame) -> DataFrame:
    """Events as versions of entities: users are entities, an error removes one, the rest is the payload."""
    return events.select(
        F.lit(1).cast("long").alias("collection_id"),
        F.col("user_id").alias("entity_id"),
        (F.col("event_id") + 1).alias("sequence"),
        (F.col("event_type") == "error").alias("is_tombstone"),
        "event_type",
        "value",
        "props",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_log(table(spark, sf_dir, "events"))
