"""Filters, joins and reports as an application writes them over its entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Money as whole cents, so that sums don't depend on their order."""
    return F.round(amount * 100).cast("long")


def named(facts: DataFrame, names: DataFrame, key: str, name: str, default: str = "Unknown") -> DataFrame:
    """facts with the name of their key, or the default; Spark broadcasts names if they are small."""
    return facts.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def totals_by(facts: DataFrame, key: str, amount: Column, total: str = "total") -> DataFrame:
    return facts.groupBy(key).agg(F.sum(amount).alias(total))


def report_with_zeros(dimension: DataFrame, facts: DataFrame, key: str, amount: Column) -> DataFrame:
    """Every row of the dimension with its total and count, zero where there are no facts. Facts are summed before
    the join, so only sums are shuffled."""
    sums = facts.groupBy(key).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))
    return dimension.join(sums, key, "left").fillna(0, ["total", "n"])


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def budget_status(spent: Column, limit: Column) -> Column:
    return F.when(spent > limit, "over").when(spent * 10 >= limit * 9, "near").otherwise("within")


def contains_ci(text: Column, part: str) -> Column:
    """Substring, whatever the case."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def _decoded(df: DataFrame, text: str, schema: str, into: str) -> tuple[DataFrame, Column, Column]:
    """df with JSON text decoded, and whether it is none of the schema: malformed, of other types, or null."""
    whole = F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]
    bad = F.col(f"{into}._bad").isNotNull() | F.col(into).isNull()
    return df.withColumn(into, whole), bad, F.struct(*[F.col(f"{into}.{n}").alias(n) for n in names])


def decode_or_skip(df: DataFrame, text: str, schema: str, into: str) -> DataFrame:
    """Rows whose text is JSON of the schema, decoded; others are left out."""
    rows, bad, fields = _decoded(df, text, schema, into)
    return rows.filter(~bad).withColumn(into, fields)


def decode_all(df: DataFrame, text: str, schema: str, into: str) -> DataFrame:
    """All rows, decoded; the first text that isn't JSON of the schema fails the whole."""
    rows, bad, fields = _decoded(df, text, schema, into)
    error = F.raise_error(F.concat(F.lit("not of the schema: "), F.coalesce(F.col(text), F.lit("null"))))
    return rows.withColumn(into, F.when(bad, error).otherwise(fields))
