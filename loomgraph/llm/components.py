"""Connected components of a graph given by its links, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id that can be reached) for every id in ``links`` (``a, b``, both long, any direction).

    A round takes for every id the smallest label among its neighbours, then the label of that label, so the number of
    rounds follows the logarithm of the longest path rather than its length for the star-shaped links that the
    operators here give.  Minima are taken before the shuffle, joins are ones that Spark splits at a very common id;
    every round's labels are written to the checkpoint folder.  Nothing but one count a round comes to the driver.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = cut(ends.union(ends.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        heard = both.join(labels.select(F.col("id").alias("a"), "component"), "a").select(F.col("b").alias("id"), "component")
        near = heard.union(labels).groupBy("id").agg(F.min("component").alias("component"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("of_component"))
        after = cut(near.join(root, "component", "left").select("id", F.least("component", "of_component").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").limit(1).count()
        labels = after
        if not changed:
            return labels
