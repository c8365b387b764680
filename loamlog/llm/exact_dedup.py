"""Exact de-duplication by a heavy-hitter split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, write_table

#: Counters of a Misra-Gries summary; also the most rows that are ever broadcast.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _summaries(counters: int):
    """Misra-Gries over one partition: at most `counters` digests, each with a lower bound of its count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for frame in frames:
            held = held.add(frame["digest"].value_counts(), fill_value=0).astype("int64")
            if len(held) > counters:
                held = held.sort_values(ascending=False)
                held = held.iloc[:counters] - held.iloc[counters]
                held = held[held > 0]
        if len(held):
            yield pd.DataFrame({"digest": held.index, "n": held.to_numpy()})

    return run


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The digests that hold more than one in counters + 1 of all rows, with their exact size and first row.

    Summaries of partitions are merged by adding their counters and taking off the largest that doesn't fit;
    any digest above that share is still among the `counters` that are left, which then are counted exactly.
    The result has at most `counters` rows, whatever the input.
    """
    merged = (
        digests.select("digest")
        .mapInPandas(_summaries(counters), "digest binary, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "digest")
        .limit(counters + 1)
        .collect()
    )
    off = merged[counters]["n"] if len(merged) > counters else 0
    likely = [(bytes(r["digest"]),) for r in merged[:counters] if r["n"] > off]
    spark = digests.sparkSession
    likely_df = spark.createDataFrame(likely, "digest binary")
    total = digests.count()
    counted = _groups(digests.join(F.broadcast(likely_df), "digest", "left_semi"))
    return counted.filter((F.col("group_size") > 1) & (F.col("group_size") * (counters + 1) > total))


def _groups(digests: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row")))
    return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms have one SHA-256. Frequent digests, found by Misra-Gries and
    verified by an exact count, are answered by a broadcast of at most `counters` rows, so their rows are
    never shuffled; the rest is grouped by an ordinary shuffle, where no digest holds more than one in
    counters + 1 of the rows.

    Nulls: a null text counts as empty; a null doc_id comes after all others and is kept only if no other
    row of the group has one. Empty texts form one group. Very long texts are only hashed. Ties: of rows with
    the same doc_id and text exactly one is kept. An empty table gives an empty result. Other columns of the
    input are neither read nor returned, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _groups_of_rows(rows.withColumn("row", F.monotonically_increasing_id()), counters).drop("row")


def _groups_of_rows(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The same for a table of row, doc_id and text; with row."""
    rows = rows.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), "row")
    digests = write_table(rows, "digests")
    heavy = write_table(heavy_digests(digests, counters), "heavy-digests")
    often = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    rare = rest.join(_groups(rest), "digest")
    return often.unionByName(rare).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, with all their columns."""
    row = free_name(docs, "_row")
    marked = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "exact-documents")
    rows = marked.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dropped = _groups_of_rows(rows).filter("not kept").select(F.col("row").alias(row))
    return marked.join(dropped, row, "left_anti").select(*docs.columns)
