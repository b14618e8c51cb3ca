"""Connected components of a graph of any size by joins.

Each round, every node takes the smallest label around it, passes it on to the node that its
label names, and follows its label one step. The number of rounds grows with the logarithm of
the longest path, not with its length. Nothing but one count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.storage import stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``node, component`` for every node of an edge; component is its smallest reachable node.

    Directions, repeats and loops don't matter; edges with a null end are left out. No edges
    give no rows.
    """
    whole = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    whole = whole.unionByName(whole.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    whole = stash(whole, "edges")
    labels = stash(whole.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("f")), "labels")
    while True:
        around = (
            whole.join(labels.select(F.col("u").alias("v"), F.col("f").alias("g")), "v").groupBy("u").agg(F.min("g").alias("g"))
        )
        seen = stash(labels.join(around, "u").select("u", "f", F.least("f", "g").alias("g")), "around")
        hooks = seen.groupBy(F.col("f").alias("u")).agg(F.min("g").alias("h"))
        hooked = stash(
            seen.join(hooks, "u", "left").select("u", F.col("f").alias("old"), F.least("f", "g", "h").alias("f")), "hooked"
        )
        up = hooked.select(F.col("u").alias("f"), F.col("f").alias("up"))
        labels = stash(hooked.join(up, "f", "left").select("u", F.least("f", "up").alias("f"), "old"), "labels")
        if labels.where(F.col("f") != F.col("old")).isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("f").alias("component"))
