"""Operators on a log of versions: (collection_id, entity_id, sequence, is_tombstone, payload columns).

All are DataFrame to DataFrame. The newest version is an aggregate (`max_by`), so versions are combined before they
are shuffled and an entity with very many versions isn't gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import global_lag

KEYS = ("collection_id", "entity_id")


def latest(log: DataFrame, keys: tuple[str, ...] = KEYS, by: str = "sequence") -> DataFrame:
    """The newest version of each entity, removed ones too."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_v"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in log.columns])


def as_of(log: DataFrame, sequence: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The newest version at or before a sequence."""
    return latest(log.filter(F.col("sequence") <= sequence), keys)


def live(versions: DataFrame) -> DataFrame:
    return versions.filter(~F.col("is_tombstone"))


def scan(log: DataFrame, sequence: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Entities that exist, now or at a sequence, with their payload then."""
    return live(latest(log, keys) if sequence is None else as_of(log, sequence, keys))


def get(log: DataFrame, ids: list, sequence: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Entities by id. The ids go to the scan, where Parquet statistics leave out what can't have them."""
    return scan(log.filter(F.col("entity_id").isin(ids)), sequence, keys)


def history(log: DataFrame, entity_id) -> DataFrame:
    """All versions of one entity, numbered from the first."""
    order = Window.partitionBy(*KEYS).orderBy("sequence")
    return log.filter(F.col("entity_id") == entity_id).withColumn("version", F.row_number().over(order).cast("long"))


def chains(log: DataFrame) -> DataFrame:
    """Number of entities that ever were, removed ones too, by collection."""
    return log.groupBy("collection_id").agg(F.countDistinct("entity_id").alias("n_chains"))


def prune(log: DataFrame, least: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Versions from a sequence on, and of each entity at least the newest."""
    newest = log.groupBy(*keys).agg(F.max("sequence").alias("_newest"))
    return log.join(newest, list(keys)).filter(
        (F.col("sequence") >= least) | (F.col("sequence") == F.col("_newest"))
    ).drop("_newest")


def compact(log: DataFrame, keep_tombstones: bool = False, retention: int | None = None, current: int | None = None) -> DataFrame:
    """The newest version of each entity. Tombstones go, or stay all, or as long as they are younger than
    `retention` sequences at `current`."""
    newest = latest(log)
    if not keep_tombstones:
        return live(newest)
    if retention is None:
        return newest
    young = F.lit(current) - F.col("sequence") < retention
    return newest.filter(~F.col("is_tombstone") | young)


def compaction_stats(log: DataFrame, size: Column, keep_tombstones: bool = False) -> DataFrame:
    """What compacting would do: records in and out, old versions and tombstones that go, bytes saved."""
    sized = log.select(*KEYS, "sequence", "is_tombstone", size.cast("long").alias("size"))
    entity = sized.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
        F.max_by(F.struct("is_tombstone", "size"), "sequence").alias("v"),
    )
    gone = F.lit(False) if keep_tombstones else F.col("v.is_tombstone")
    return entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_records"),
        F.coalesce(F.sum(F.when(gone, 0).otherwise(1)), F.lit(0)).cast("long").alias("output_records"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("obsolete_removed"),
        F.coalesce(F.sum(F.when(gone, 1).otherwise(0)), F.lit(0)).cast("long").alias("tombstones_removed"),
        F.coalesce(F.sum(F.col("bytes") - F.when(gone, 0).otherwise(F.col("v.size"))), F.lit(0)).alias("bytes_saved"),
    )


def backup_records(log: DataFrame, sequence: int, tombstones: bool) -> DataFrame:
    """What a backup at a sequence holds."""
    then = as_of(log, sequence)
    return then if tombstones else live(then)


def _kind(before: Column) -> Column:
    return F.when(F.col("is_tombstone"), "delete").when(F.coalesce(before, F.lit(True)), "insert").otherwise("update")


def classify_changes(log: DataFrame, keys: tuple[str, ...] = KEYS, spread: bool = True) -> DataFrame:
    """Each version as insert, update or delete, by whether the entity existed before it.

    Versions are sorted by range over many tasks, so that an entity may have a large share of all; without spread, an
    entity's versions are sorted in one task, with one shuffle less.
    """
    if spread:
        placed = global_lag(log, "is_tombstone", list(keys), "sequence", "_before")
        return placed.withColumn("change_type", _kind(F.col("_before"))).drop("_before")
    before = F.lag("is_tombstone").over(Window.partitionBy(*keys).orderBy("sequence"))
    return log.withColumn("change_type", _kind(before))


def between(log: DataFrame, first: int, last: int) -> DataFrame:
    """All versions of a range of sequences, both ends included: what some commits wrote."""
    return log.filter(F.col("sequence").between(first, last))


def scan_first(log: DataFrame, n: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The first n entities in order of their keys: a limit in each task, then one over those."""
    return scan(log, None, keys).orderBy(*keys).limit(n)


def write_batch(log: DataFrame, staged: DataFrame, sequence: int) -> DataFrame:
    """New versions of one commit, to append to the log. staged: keys, is_tombstone, op_type and payload columns.

    op_type, where it isn't null, is what the writer knows the write to be and isn't looked up; otherwise it is an
    insert or update by whether the entity exists. Of an entity's writes the last by `ordinal` counts.
    """
    rest = [c for c in staged.columns if c not in KEYS]
    last = staged.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "ordinal").alias("_v"))
    last = last.select(*KEYS, *[F.col(f"_v.{c}").alias(c) for c in rest if c != "ordinal"])
    asked = last.filter("op_type is null").select(*KEYS)
    now = scan(log.join(asked, list(KEYS), "left_semi")).select(*KEYS, F.lit(True).alias("_there"))
    kind = F.when(F.col("is_tombstone"), "delete").when(F.col("op_type").isNotNull(), F.col("op_type"))
    kind = kind.when(F.col("_there").isNotNull(), "update").otherwise("insert")
    made = last.join(now, list(KEYS), "left").withColumn("change_type", kind).drop("_there", "op_type")
    return made.withColumn("sequence", F.lit(sequence).cast("long"))


def recover(operations: DataFrame, commits: DataFrame, checkpoint: int = 0) -> DataFrame:
    """Replays a write-ahead log: operations of committed transactions after the checkpoint.

    operations: txid and a record; commits: txid, commit_sequence. Commits are far fewer than operations, and
    Spark broadcasts them only if they are small.
    """
    done = commits.filter(F.col("commit_sequence") > checkpoint).select("txid", "commit_sequence")
    return operations.join(done, "txid")


def restore(log: DataFrame, backup: DataFrame, sequence: int) -> DataFrame:
    """The log with a backup's records as one more commit: entities that the backup doesn't have stay."""
    return log.unionByName(backup.withColumn("sequence", F.lit(sequence).cast("long")))
