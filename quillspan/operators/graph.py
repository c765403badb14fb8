"""Graph operators: connected components, degrees, provenance checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through spark.checkpoint.dir; a local session without one gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-checkpoint-"))
    return df.checkpoint()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node and component, the least node of it; nodes without edges are left out.

    Each round moves every node's label to the least label among its neighbours and then follows labels of labels, so
    rounds grow with the logarithm of a component's width. Minima are aggregated before the shuffle.
    """
    e = edges.filter("a <> b").select("a", "b")
    both = checkpointed(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        step = checkpointed(step)
        if not step.filter("moved").limit(1).count():
            return step.select("node", F.col("label").alias("component"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("label2"))
        labels = checkpointed(step.join(up, "label", "left").select("node", F.coalesce("label2", "label").alias("label")))


def degrees(edges: DataFrame, source: str, target: str, by: list[str]) -> DataFrame:
    """Degree of every node that has an edge."""
    ends = edges.select(*by, F.explode(F.array(source, target)).alias("node"))
    return ends.groupBy(*by, "node").agg(F.count("*").alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame, by: list[str], node: str, source: str, target: str) -> DataFrame:
    """Nodes that are no edge's end."""
    ends = edges.select(*by, F.explode(F.array(source, target)).alias(node))
    return nodes.join(ends, [*by, node], "left_anti")


def node_edge_sets(entities: DataFrame, relations: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """by, nodes and edges as sorted sets. Bounded by a job's annotations."""
    n = entities.groupBy(*by).agg(F.array_sort(F.collect_set(name)).alias("nodes"))
    e = relations.groupBy(*by).agg(F.array_sort(F.collect_set(F.concat_ws("|", "s_name", "type", "t_name"))).alias("edges"))
    empty = F.array().cast("array<string>")
    return n.join(e, by, "full").withColumn("nodes", F.coalesce("nodes", empty)).withColumn("edges", F.coalesce("edges", empty))
