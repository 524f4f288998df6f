"""Connected components of links between integer ids, by contraction.

In each round every node points to the least id among itself and its neighbours, pointers
are followed twice, and the links are rewritten to what their ends point to; links inside
one group vanish.  A node with very many links is summed up before its links are
shuffled, and the rewriting joins are plain ones that AQE can split.  Each round's tables
are written, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> node, component: the least id that can be reached."""
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    edges, found = materialize(both, "links"), None
    while True:
        least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        for _ in range(2):
            on = least.select(F.col("a").alias("via"), F.col("to").alias("far"))
            least = least.join(on, least["to"] == on["via"]).select("a", F.col("far").alias("to"))
        least = materialize(least, "pointers")
        if found is None:
            found = least.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            found = found.join(least, found["component"] == least["a"], "left").select(
                "node", F.coalesce("to", "component").alias("component"))
        a = least.select("a", F.col("to").alias("x"))
        b = least.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = materialize(edges.join(a, "a").join(b, "b").filter("x <> y").select(
            F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return materialize(found, "components")
        found = materialize(found, "components")
