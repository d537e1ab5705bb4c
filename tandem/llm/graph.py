"""Connected components by hooking and shortcutting, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge; the label is the smallest node of its component.

    Each round every node takes the smallest label among its neighbours', so
    does the node that it is labelled with, and labels are replaced by the labels
    of their nodes: rounds grow with the logarithm of a component's width.  All
    minima are combined before they are shuffled, and the joins are between
    written tables, so a hub of millions of edges is split or pre-aggregated.
    Edges with a null end are left out.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    both = materialize(pairs.union(pairs.select("v", "u")).distinct())
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        of_v = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        of_u = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        seen = both.join(of_v, "v").groupBy("u").agg(F.min("lv").alias("lv")).join(of_u, "u")
        offers = seen.select(F.col("u").alias("node"), F.least("lv", "lu").alias("label")).union(seen.select(F.col("lu").alias("node"), F.least("lv", "lu").alias("label")))
        hooked = materialize(offers.groupBy("node").agg(F.min("label").alias("label")))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(hooked.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
