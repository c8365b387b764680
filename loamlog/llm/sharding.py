"""Contiguous shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, global_prefix, write_table

SHARDS = 16


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one more, for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, order: list[str], size_col: str = "size", shards: int = SHARDS) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (0, 1, 2, ... within a shard).

    In the given order, a document goes to the shard in which the middle of its bytes lies, all shards being
    equal cuts of the total; so shards are contiguous and differ by less than the largest document. Running
    sums start from per-partition totals (`global_prefix`), so nothing passes through one task.

    docs should be slim (key, size, what is to be returned): its rows are shuffled twice. Nulls: in the order
    they come first; a null size counts as 0. Ties, repeated rows: any of their orders gives the same result
    but for which equal row has which slot. An empty table gives an empty result. Input columns called
    `shard` or `slot` are replaced; others pass through.
    """
    docs = docs.drop("shard", "slot")
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    keys = [f"_o{i}" for i in range(len(order))]
    packed = docs.select(
        F.struct(*docs.columns).alias("_in"), size.alias("_size"), *[F.col(c).alias(k) for c, k in zip(order, keys)]
    )
    by = [F.col(k).asc_nulls_first() for k in keys]
    placed = global_prefix(packed, [], by, {"_before": F.col("_size"), "_index": F.lit(1).cast("long")}, "shards")
    placed = write_table(placed, "placed")
    total = placed.agg(F.sum("_size")).first()[0] or 1
    cut = F.expr(f"least({shards - 1}, ((_before * 2 + _size) * {shards}) div {2 * total})").cast("int")
    cut_rows = placed.withColumn("shard", cut)
    firsts = cut_rows.groupBy("shard").agg(F.min("_index").alias("_first"))  # at most `shards` rows
    return cut_rows.join(F.broadcast(firsts), "shard").select(
        "_in.*", "shard", (F.col("_index") - F.col("_first")).alias("slot")
    )


def sharded_documents(
    docs: DataFrame, order: list[str], text_col: str = "text", shards: int = SHARDS
) -> DataFrame:
    """docs with all their columns, `shard` and `slot`, by shard_by_bytes on the sizes of their texts.

    Rows are told apart by a number that they get, not by an id: repeated rows, and those with null ids, stay as many
    as they are. Null texts have the size 1. Very long texts aren't cut: a shard may be larger by one. Ties in the order
    are broken by the row's number. An empty table gives an empty result. Input columns called `shard` or `slot` are
    replaced, others may have any names. Equal texts are placed like others: each by its own place in the order.
    """
    docs = docs.drop("shard", "slot")
    row = free_name(docs, "_row")
    marked = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "shard-documents")
    keys = [f"_k{i}" for i in range(len(order))]
    sized = marked.select(F.col(row).alias("_row"), text_bytes(F.col(text_col)).alias("_bytes"),
                          *[F.col(c).alias(k) for c, k in zip(order, keys)])
    placed = shard_by_bytes(sized, [*keys, "_row"], "_bytes", shards).select(F.col("_row").alias(row), "shard", "slot")
    return marked.join(placed, row).drop(row)


def write_shards(docs: DataFrame, path: str, order: list[str], text_col: str = "text", shards: int = SHARDS) -> None:
    """Writes whole documents as one folder per shard, in slot order; see sharded_documents."""
    placed = sharded_documents(docs, order, text_col, shards)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
