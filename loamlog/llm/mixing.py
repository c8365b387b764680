"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, free_name, global_prefix, join_rows, write_table

#: Weights of sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this, and so no document.
MOST_COPIES = 3
SEED = 17


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACES.replace("[", "[^", 1))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: a share of the total by weight, at most `most` times the source's size.

    sizes: one row per source (source, source_size). Sources by code point, null last, have the weights in
    turn. What a source can't take is shared again by weight until no target is above its limit. That ends
    where every target is the lesser of its limit and level * weight. With sources in order of limit / weight,
    the level that would hold if just those before a source were at their limit rises as long as sources are
    at their limit and falls afterwards, so the largest of them is the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_n", F.row_number().over(by_name) - 1).withColumn("_w", weight)
    rows = rows.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    ratio = [F.col("_cap") / F.col("_w"), F.col("_n")]
    before = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn(
        "_level",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / F.sum("_w").over(after),
    ).withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return rows.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def offset_of(source: Column, seed: int = SEED) -> Column:
    """A source's random offset: 0 <= offset < 1, in steps of 1/65536, the same in each run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 4), 16, 10).cast("double") / 65536.0


def mix(
    docs: DataFrame,
    order: list[str],
    size_col: str = "size",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """docs with source_size, target and copies: how often the mix takes each document.

    All documents of a source expect target / source_size copies. They stand in order of size, then of the
    columns `order`; a document's copies are the integers that the prefix sum of expected copies, plus the
    source's offset, crosses at it. As sizes rise slowly along the order, the words taken come within about one
    large document of the target. Ranks come from per-partition counts (`global_prefix`), so a source with a
    third of all rows is spread over many tasks.

    docs is slim: source, the size, the columns of the order, and what should be returned; its rows
    are shuffled twice. Nulls: a null source is a source of its own, the last; a null size is 0; null ids come
    first. A source without words has target 0 and no copies. Ties, repeated rows: equal rows may differ in
    copies by one. An empty table gives an empty result. Input columns named source_size, target or copies are
    replaced.
    """
    docs = docs.drop("source_size", "target", "copies")
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    keys = [f"_o{i}" for i in range(len(order))]
    packed = docs.select(
        F.struct(*docs.columns).alias("_in"), F.col(source_col).alias("_source"), size.alias("_size"),
        *[F.col(c).alias(k) for c, k in zip(order, keys)],
    )
    sizes = packed.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "_name")
    targets = write_table(targets, "targets")  # one row per source
    by = [F.col("_size"), *[F.col(k).asc_nulls_first() for k in keys]]
    ranked = global_prefix(packed, ["_source"], by, {"_rank": F.lit(1).cast("long")}, "mix")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((F.col("_rank") + 1) * F.col("_each") + F.col("_offset")) - F.floor(
        F.col("_rank") * F.col("_each") + F.col("_offset")
    )
    return (
        ranked.join(targets, ranked["_source"].eqNullSafe(targets["_name"]), "left")
        .withColumn("_each", each)
        .withColumn("_offset", offset_of(F.col("_source"), seed))
        .select("_in.*", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with all their columns, each row as often as the mix takes it."""
    row, copy = free_name(docs, "_row"), free_name(docs, "_copy")
    marked = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "to-mix")
    slim = marked.select(
        F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    taken = mix(write_table(slim, "words"), ["doc_id", "row"]).filter("copies > 0")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy)))
    taken = write_table(taken.select(F.col("row").alias(row), F.col("copies").alias(copy)), "taken")
    return join_rows(marked, taken, row).withColumn(copy, each).select(*docs.columns)
