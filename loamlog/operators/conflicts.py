"""Optimistic conflict detection by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: str | Column) -> Column:
    """SHA-256 of one text or binary column, or of several as JSON."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if len(cols) == 1:
        return F.sha2(cols[0].cast("binary"), 256)
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).cast("binary"), 256)


def detect(staged: DataFrame, current: DataFrame) -> DataFrame:
    """staged (entity_id, was_read, expected_hash) against current (entity_id, current_hash): outcome of each.

    A write whose entity was read expects what was read: its hash, or absence. Anything else now is a conflict,
    be it changed, gone or come into being. A blind write, of an entity that wasn't read, never is.
    """
    changed = F.when(~F.col("was_read"), F.lit(None)).when(
        F.col("expected_hash").isNotNull() & F.col("current_hash").isNull(), "deleted"
    ).when(F.col("expected_hash").isNull() & F.col("current_hash").isNotNull(), "created").when(
        F.col("expected_hash") != F.col("current_hash"), "changed"
    )
    joined = staged.join(current.select("entity_id", "current_hash"), "entity_id", "left")
    return joined.withColumn("conflict", changed)


def overlay(snapshot: DataFrame, pending: DataFrame, key: str = "entity_id") -> DataFrame:
    """A snapshot as a transaction sees it: its own last write of each entity instead of the snapshot's.

    pending has the snapshot's columns, is_tombstone and ordinal.
    """
    rest = [c for c in pending.columns if c != key]
    last = pending.groupBy(key).agg(F.max_by(F.struct(*rest), "ordinal").alias("_v"))
    own = last.filter("not _v.is_tombstone").select(
        *[F.col(c) if c == key else F.col(f"_v.{c}").alias(c) for c in snapshot.columns]
    )
    return snapshot.join(last.select(key), key, "left_anti").select(*snapshot.columns).unionByName(own)
