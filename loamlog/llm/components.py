"""Connected components by propagation of the least label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, write_table


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """vertex, component for each end of an edge; component is the least vertex that it is connected with.

    In each round a vertex takes the least label of itself and its neighbours, then that label's own label, which
    shortens long chains; labels are written after each round, and rounds end when none has changed. Labels are
    combined before they are shuffled, so a vertex with very many edges isn't gathered anywhere.
    """
    pairs = write_table(edges.select(F.col(a).alias("u"), F.col(b).alias("v")), "edges")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"))
    labels = write_table(labels, "labels")
    while True:
        sent = both.join(labels.select("u", "label"), "u").select(F.col("v").alias("u"), "label", F.lit(None).alias("was"))
        own = labels.select("u", "label", F.col("label").alias("was"))
        least = own.unionByName(sent).groupBy("u").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        up = labels.select(F.col("u").alias("label"), F.col("label").alias("_up"))
        jumped = least.join(up, "label").select("u", F.least("label", "_up").alias("label"), "was")
        old, labels = labels, write_table(jumped, "labels")
        free(old)
        if not labels.filter("label <> was").limit(1).count():
            free(pairs)
            return labels.select(F.col("u").alias("vertex"), F.col("label").alias("component"))
