"""Connected components of links, by rounds of contraction.

In each round every node takes the neighbour that comes first in a hashed order, or itself, as its parent; links
are then drawn between parents. A hashed order makes a round shrink chains too by a constant share. Nothing but the
number of links left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node."""
    both = links.select("a", "b").filter("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct()
    edges, steps = durable(both, "edges"), []
    while not edges.isEmpty():
        first = F.min(F.struct(F.xxhash64("b"), F.col("b")))
        own = F.struct(F.xxhash64("a"), F.col("a").alias("b"))
        parent = edges.groupBy("a").agg(first.alias("f")).select("a", F.when(own < F.struct(F.col("f.col1"), F.col("f.b")), F.col("a")).otherwise(F.col("f.b")).alias("parent"))
        parent = durable(parent, "parents")
        steps.append(parent)
        up = edges.join(parent.hint("merge"), "a").select(F.col("parent").alias("a"), "b").distinct()
        up = up.join(parent.withColumnRenamed("a", "b").hint("merge"), "b").select("a", F.col("parent").alias("b"))
        edges = durable(up.filter("a <> b").distinct(), "edges")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    root = steps[0].select(F.col("a").alias("node"), F.col("parent").alias("root"))
    for parent in steps[1:]:
        met = root.join(parent.select(F.col("a").alias("root"), "parent").hint("merge"), "root", "left")
        root = met.select("node", F.coalesce("parent", "root").alias("root"))
    root = durable(root, "roots")
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(durable(least, "least").hint("merge"), "root").select("node", "component")
