"""Running sums, ranks and previous rows over a whole table or very large groups.

A window over a large group is one task's work. Here rows are dealt by range and written, each partition does its
own part, and what one partition needs of those before it is a row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import write_table


def _dealt(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    dealt = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    return write_table(dealt, name)


def _same(group: list[str]) -> Column:
    cond = F.col("_part") == F.col("_p")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return cond


def global_prefix(
    df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], name: str = "prefix"
) -> DataFrame:
    """df with one more column for each of sums: its total over all rows before this one in the order, within
    the group.

    Each partition's totals are added up, which are as many rows as partitions (and one more for each group), and
    joined back to start each partition's own running sum.
    """
    dealt = _dealt(df, group, order, name)
    totals = dealt.groupBy("_part", *group).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums],
    )
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(starts, _same(group), "left").select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_s_{k}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(k) for k, c in sums.items()],
    )


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place in an order, from 1."""
    placed = global_prefix(df, [], order, {"_before": F.lit(1).cast("long")}, name)
    return placed.select(*df.columns, (F.col("_before") + 1).alias(name))


def global_lag(df: DataFrame, value: str, group: list[str], order: str, into: str) -> DataFrame:
    """df with the value of the row before it in its group; null for the first.

    Only a group that begins before a partition does needs the last row of the one before: at most one for each
    partition.
    """
    dealt = _dealt(df, group, [F.col(order)], "lag")
    lasts = dealt.groupBy("_part", *group).agg(F.max_by(value, order).alias("_last"))
    earlier = Window.partitionBy(*group).orderBy("_part")
    starts = lasts.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.lag("_last").over(earlier).alias("_start"),
        F.row_number().over(earlier).alias("_k"),
    ).filter("_k > 1").drop("_k")
    own = Window.partitionBy("_part", *group).orderBy(order)
    first = F.row_number().over(own) == 1
    return dealt.join(starts, _same(group), "left").select(
        *df.columns, F.when(first, F.col("_start")).otherwise(F.lag(value).over(own)).alias(into)
    )
