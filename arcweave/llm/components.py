"""Connected components by label propagation with pointer jumping, all in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every end of ``edges`` (a long, b long).

    Each round takes the smallest label among a node's neighbours (a partial
    aggregate, so a node with very many links is summed where its links lie)
    and then the label of that label. Rounds go on until no label changes;
    labels are written between rounds.
    """
    edges = common.stage(edges.select("a", "b").where("a <> b"), "edges")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    labels = common.stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("l"))
        step = common.stage(step, "step")
        jump = step.join(step.select(F.col("node").alias("l"), F.col("l").alias("up")), "l", "left").select("node", "old", F.least("l", F.coalesce("up", "l")).alias("label"))
        new = common.stage(jump, "labels")
        common.discard(step, labels)
        labels = new
        if not labels.where("label <> old").limit(1).count():
            break
    common.discard(edges)
    out = labels.select("node", F.col("label").alias("component"))
    out._arcweave_path = labels._arcweave_path
    return out
