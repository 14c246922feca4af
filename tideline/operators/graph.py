"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _local(pairs: list, kind: str, edges: DataFrame) -> DataFrame:
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs:
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return edges.sparkSession.createDataFrame([(x, find(x)) for x in list(parent)], f"node {kind}, label {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = 50_000) -> DataFrame:
    """(node, label): the least node reachable, by alternating large and small stars.

    Nodes are those of the edges; an edge with a null end is left out. The distinct pairs are
    written once. Each round is written to the shared folder until nothing changes; no round
    makes more rows than edges and nodes. Where the written pairs number local_edges or fewer
    they are joined on the driver instead; 0 forbids that.
    """
    known = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    written = materialise(known.distinct(), "edges")
    if local_edges and written.count() <= local_edges:
        return _local(written.collect(), edges.schema[a].dataType.simpleString(), edges)
    lone = written.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("label"))
    pairs, state = written.where("u != v"), None
    while True:
        sums = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == state:
            named = pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")))
            return named.unionByName(lone).groupBy("node").agg(F.min("label").alias("label"))
        state = sums
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = materialise(small.where("u != v").distinct(), "edges")
