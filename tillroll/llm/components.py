"""Connected components of a distributed edge list.

Labels spread to neighbours and are then shortened by one look-up of the
label's own label, until nothing changes.  Every step is a join and a
partially aggregated minimum over written tables, so no node's edges meet in
one task, a lost executor costs one step, and AQE can split the joins at a
node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.tables import drop, written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the written table ``edges(a, b)``;
    a component is named by its smallest node."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("was"))
        own = labels.select("node", "component", F.col("component").alias("was"))
        spread = written(heard.union(own).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was")), "labels")
        of = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        short = written(spread.join(of, "component").select("node", F.col("further").alias("component"), "was"), "labels")
        drop(labels, spread)
        labels = short.select("node", "component")
        labels._tillroll_path = short._tillroll_path
        if short.where("component <> was").isEmpty():
            drop(both)
            return labels
