"""What a log holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .log import latest


def collections(log: DataFrame, collection: str, size: Column) -> DataFrame:
    """Records, tombstones and bytes per collection: of all records, and how many entities exist. One aggregate by
    entity, then one by collection."""
    entity = log.groupBy(collection, "entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_tombstone").cast("long")).alias("t"),
        F.sum(size.cast("long")).alias("b"), F.max_by("is_tombstone", "sequence").alias("gone"),
    )
    return entity.groupBy(collection).agg(
        F.sum("n").alias("records"), F.sum("t").alias("tombstones"), F.sum("b").alias("bytes"),
        F.count(F.lit(1)).alias("entities"), F.sum((~F.col("gone")).cast("long")).alias("live_entities"),
    )


def verify(records: DataFrame, payload: str, checksum: str) -> DataFrame:
    """Records whose payload doesn't have its CRC-32."""
    return records.filter(~F.crc32(F.col(payload).cast("binary")).eqNullSafe(F.col(checksum)))


def dump(records: DataFrame, size: Column, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Records as an operator reads them, in order: place, type, collection, id in hex, sequence, size."""
    out = records.select(
        "sequence", F.when(F.col("is_tombstone"), "DELETE").otherwise("PUT").alias("type"), "collection_id",
        F.lower(F.hex("entity_id")).alias("entity"), size.cast("long").alias("size"),
    ).orderBy("sequence")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def counts(log: DataFrame) -> DataFrame:
    newest = latest(log.select("collection_id", "entity_id", "sequence", "is_tombstone"))
    return newest.agg(
        F.count(F.lit(1)).alias("chains"), F.sum((~F.col("is_tombstone")).cast("long")).alias("live_entities"),
        F.max("sequence").alias("newest_sequence"),
    )
