"""The change feed, as pages of a table and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import KEYS, classify_changes
from ..operators.ordered import global_lag, global_rank
from ..sources.files import write_table

#: Sequences in one bucket when counting from the end.
_BUCKET = 1 << 16


def poll(changes: DataFrame, cursor: int, limit: int) -> DataFrame:
    """Changes after a cursor, in order, at most limit."""
    return changes.filter(F.col("sequence") > cursor).orderBy("sequence", "entity_id").limit(limit)


def poll_log(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The same page from a log that isn't classified yet: the page is taken first, and only the versions of its
    entities up to its end are looked at for what they were before."""
    page = log.filter(F.col("sequence") > cursor).orderBy("sequence", "entity_id").limit(limit)
    page = write_table(page, "page")  # at most limit rows
    last = page.agg(F.max("sequence")).first()[0]
    ids = F.broadcast(page.select(*KEYS).distinct())
    told = log.filter(F.col("sequence") <= F.lit(last)).join(ids, list(KEYS), "left_semi")
    return poll(classify_changes(told), cursor, limit)


def since(log: DataFrame, least: int) -> DataFrame:
    """Changes from a sequence on, of a log that isn't classified yet: what entities were before it is their newest
    version then, an aggregate."""
    before = log.filter(F.col("sequence") < least).groupBy(*KEYS).agg(
        F.max("sequence").alias("sequence"), F.max_by("is_tombstone", "sequence").alias("is_tombstone"))
    new = log.filter(F.col("sequence") >= least)
    base = before.join(new.select(*KEYS).distinct(), list(KEYS), "left_semi")
    both = new.unionByName(base, allowMissingColumns=True)
    return classify_changes(both, spread=True).filter(F.col("sequence") >= least)


def with_before(log: DataFrame, payload: str) -> DataFrame:
    """Changes with the hash of what the entity was before an update or delete, and what it is after."""
    kept = F.when(~F.col("is_tombstone"), F.sha2(F.col(payload).cast("binary"), 256))
    placed = global_lag(log.withColumn("_hash", kept), "_hash", list(KEYS), "sequence", "before_hash")
    changes = classify_changes(placed.drop("_hash"), spread=True)
    return changes.withColumn("after", F.when(~F.col("is_tombstone"), F.col(payload))).drop(payload)


def number_batches(events: DataFrame, batch: str, last: int = 0) -> DataFrame:
    """Events with one sequence for all of a batch, in order of batches, from the one after the last."""
    ranks = global_rank(events.select(batch).distinct(), [F.col(batch)], "_n")
    ranks = ranks.select(F.col(batch).alias("_batch"), (F.col("_n") + last).cast("long").alias("sequence"))
    return events.drop("sequence").join(ranks, F.col(batch) == F.col("_batch")).drop("_batch")


def latest_sequence(changes: DataFrame) -> DataFrame:
    return changes.agg(F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("latest_sequence"))


def truncate(changes: DataFrame, least: int) -> DataFrame:
    """Changes from a sequence on."""
    return changes.filter(F.col("sequence") >= least)


def oldest_kept(changes: DataFrame, most: int) -> int:
    """The sequence from which on there are the newest `most` changes. It comes from counts of sequence buckets, then
    from one bucket's rows, so the history isn't sorted as a whole."""
    bucket = F.floor(F.col("sequence") / _BUCKET).cast("long")
    left = most
    for row in changes.groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).toLocalIterator():
        if row["count"] >= left:
            rows = changes.filter(bucket == row["b"]).select("sequence").orderBy(F.desc("sequence")).limit(max(left, 1))
            return rows.agg(F.min("sequence")).first()[0] + (left == 0)
        left -= row["count"]
    return 0


def retain(changes: DataFrame, most: int) -> DataFrame:
    """The newest `most` changes."""
    return truncate(changes, oldest_kept(changes, most)) if most else changes.limit(0)


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files at a path, new ones as they come. The path may be one file: as a pattern, which
    is what a stream reads single files by."""
    path = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _classify(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """An entity's versions of a batch, by its two columns that matter: 9 bytes a version are held."""
    parts = [f[["sequence", "is_tombstone"]].to_numpy(dtype="int64") for f in frames]
    rows = np.concatenate(parts)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    gone = rows[:, 1] != 0
    before = np.concatenate(([state.get[0] if state.exists else False], ~gone[:-1]))
    state.update((bool(~gone[-1]),))
    kinds = np.where(gone, "delete", np.where(before, "update", "insert"))
    for at in range(0, len(rows), 100_000):
        piece = slice(at, at + 100_000)
        yield pd.DataFrame({"entity_id": key[0], "sequence": rows[piece, 0], "change_type": kinds[piece]})


def classify_stream(log: DataFrame) -> DataFrame:
    """Each version of a stream as insert, update or delete. The state of an entity is whether it exists."""
    return (
        log.select("entity_id", "sequence", "is_tombstone")
        .groupBy("entity_id")
        .applyInPandasWithState(
            _classify, "entity_id long, sequence long, change_type string", "exists boolean", "append", "NoTimeout"
        )
    )


def counts_by_window(events: DataFrame, width: str, late: str) -> DataFrame:
    """Changes per window of event time and kind, ended when the watermark has passed it."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )


def drain(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and returns what it wrote.

    Each batch is a folder that a repeated batch overwrites, so a restart after a loss neither loses nor repeats rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = (
        df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode(mode)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out").select(*df.columns)
