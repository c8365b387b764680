"""Access by key: equality, ranges, order, composite keys, uniqueness.

An index is a view here: predicates on a column go down to the Parquet scan, whose row-group statistics (and the
order or buckets that `materialise` writes) do what a separate index would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import global_rank


def equal(df: DataFrame, key: Column | str, value) -> DataFrame:
    """Rows whose key is value; a null value finds explicit nulls."""
    return df.filter((F.col(key) if isinstance(key, str) else key).eqNullSafe(F.lit(value)))


def between(
    df: DataFrame, key: str, least=None, most=None, include_least: bool = True, include_most: bool = True
) -> DataFrame:
    """Rows whose key is in a range; None is an open end. A least above the most gives no row. Nulls are in none."""
    out = df.filter(F.col(key).isNotNull())
    if least is not None:
        out = out.filter(F.col(key) >= F.lit(least) if include_least else F.col(key) > F.lit(least))
    if most is not None:
        out = out.filter(F.col(key) <= F.lit(most) if include_most else F.col(key) < F.lit(most))
    return out


def greater_than(df: DataFrame, key: str, value) -> DataFrame:
    return between(df, key, value, include_least=False)


def greater_than_or_equal(df: DataFrame, key: str, value) -> DataFrame:
    return between(df, key, value)


def less_than(df: DataFrame, key: str, value) -> DataFrame:
    return between(df, key, most=value, include_most=False)


def less_than_or_equal(df: DataFrame, key: str, value) -> DataFrame:
    return between(df, key, most=value)


def ordered(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, id) entries in order of the key; ids break ties."""
    return df.filter(F.col(key).isNotNull()).select(key, id_col).orderBy(key, id_col)


def take(df: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """The first n entries: a limit in each task, then one over those."""
    return ordered(df, key, id_col).limit(n)


def take_last(df: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """The last n entries, ascending."""
    last = df.filter(F.col(key).isNotNull()).select(key, id_col).orderBy(F.desc(key), F.desc(id_col)).limit(n)
    return last.orderBy(key, id_col)


def min_max(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def contains(df: DataFrame, key: str, value) -> bool:
    return bool(equal(df, key, value).limit(1).count())


def has_key(df: DataFrame, key: str, values: list) -> DataFrame:
    """key, found: whether some row has each of the values."""
    asked = df.sparkSession.createDataFrame([(v,) for v in values], df.select(F.col(key).alias("key")).schema)
    held = df.filter(F.col(key).isin(values)).select(F.col(key).alias("_k")).distinct()
    return asked.join(held, F.col("key") == F.col("_k"), "left").select("key", F.col("_k").isNotNull().alias("found"))


def rejected_inserts(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Of new entries (key, entity_id), those that a unique index refuses: another entity holds the key, or one of the
    same batch before it (by id) takes it. Null keys are refused to none."""
    held = entries.filter("key is not null").groupBy("key").agg(F.min("entity_id").alias("_a"), F.max("entity_id").alias("_z"))
    taken = new.filter("key is not null").groupBy("key").agg(F.min("entity_id").alias("_first"))
    met = new.join(held, "key", "left").join(taken, "key")
    mine = F.col("entity_id")
    other = F.col("_a").isNotNull() & ((F.col("_a") != mine) | (F.col("_z") != mine))
    return met.filter(other | (F.col("_first") != mine)).select("key", "entity_id")


def after_composite(df: DataFrame, keys: list[str], values: list, inclusive: bool = False) -> DataFrame:
    """Rows whose composite key, compared column by column, is above values."""
    cond = F.lit(inclusive)
    for k, v in reversed(list(zip(keys, values, strict=True))):
        cond = (F.col(k) > F.lit(v)) | ((F.col(k) == F.lit(v)) & cond)
    return df.filter(cond)


def composite_prefix(df: DataFrame, keys: list[str], values: list) -> DataFrame:
    """Rows that begin with values: as many leading columns as values."""
    for k, v in zip(keys, values):
        df = equal(df, k, v)
    return df


def index_stats(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys and entries."""
    return df.agg(F.countDistinct(key).alias("distinct_keys"), F.count(key).alias("entries"))


def unique_violations(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keys that more than one entity holds, and how many do."""
    return df.groupBy(key).agg(F.countDistinct(id_col).alias("holders")).filter("holders > 1")


def apply_updates(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """Index entries (key, entity_id) after updates (key, entity_id, insert boolean, ordinal): of the updates of an
    entry the last counts."""
    last = updates.groupBy("key", "entity_id").agg(F.max_by("insert", "ordinal").alias("insert"))
    kept = entries.join(last, ["key", "entity_id"], "left_anti")
    return kept.unionByName(last.filter("insert").select("key", "entity_id"))


def integer_order(c: Column) -> list[Column]:
    """Sort keys that order integers as their canonical encodings: from 0 up, then from -1 down."""
    return [c < 0, F.when(c < 0, -1 - c).otherwise(c)]


def text_order(c: Column) -> list[Column]:
    """Sort keys that order texts as their canonical encodings: by bytes in number, then in value."""
    return [F.octet_length(c), c.cast("binary")]


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place in an order, from 1, without sorting all of them in one task."""
    return global_rank(df, order, name)


def materialise(df: DataFrame, key: str, path: str, kind: str = "btree", partitions: int = 0) -> None:
    """Writes df so that lookups by key read little: `btree` in ranges of the key, sorted, so that row groups have
    narrow statistics; `hash` with each key in one file."""
    dealt = (
        (df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key))
        if kind == "btree"
        else (df.repartition(partitions, key) if partitions else df.repartition(key))
    )
    dealt.sortWithinPartitions(key).write.parquet(path)
