"""Connected components of a graph in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import drop_stash, stash


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long), in any direction, repeated or not. Returns node and component, the least node in it.

    Nodes without edges are left out; an edge of a node to itself is ignored. A node's neighbours are never gathered:
    their minimum is aggregated before the shuffle and joined back, and a join's frequent keys can be split. Every
    round is written to the shared folder, so lineage stays short and lost executors cost one round at most; so is the
    result, which drop_stash() removes.
    """
    now = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Done if no node has two neighbours below it, or one below and one above.
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")), F.struct(F.col("b").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("high")))).alias("e"))
        if not ends.groupBy("e.n").agg(F.sum("e.low").alias("low"), F.max("e.high").alias("high")).filter("low > 1 or low = 1 and high = 1").limit(1).count():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stash(large, "edges")
        drop_stash(now)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = stash(small.filter("a <> b").distinct(), "edges")
        drop_stash(large)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out = stash(out, "components")
    drop_stash(now)
    return out
