"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for all nodes of links(a, b).

    Nodes stand under xxhash64 of their id, a bijection on longs, so that minima fall on random nodes and
    a chain in order of ids contracts as fast as any. Each round every node goes over to its least
    neighbour; links within one node vanish; partial minima keep a hub of many links harmless. The
    tables are cut from their lineage each round and shrink by a constant share.
    """
    edges = settle(links.filter("a <> b").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct(), "edges")
    ids = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("p", F.xxhash64("node"))
    where = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "to").withColumnRenamed("a", "v")
        where = to.select(F.col("v").alias("p"), F.col("to").alias("top")) if where is None else where.join(to, where.top == to.v, "left").select("p", F.coalesce("to", "top").alias("top"))
        where = settle(where, "where")
        edges = edges.join(to, edges.a == to.v).select(F.col("to").alias("a"), "b")
        edges = edges.join(to, edges.b == to.v).select("a", F.col("to").alias("b")).filter("a <> b").distinct()
        edges = settle(edges, "edges")
        if edges.isEmpty():
            break
    rows = settle(ids.join(where, "p", "left").select("node", F.coalesce("top", "p").alias("top")), "nodes")
    least = settle(rows.groupBy("top").agg(F.min("node").alias("component")), "least")
    return rows.join(least, "top").select("node", "component")
