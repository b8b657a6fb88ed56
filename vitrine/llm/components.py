"""Connected components of a distributed edge table."""

from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import gather
from vitrine.sources.shared import cut_lineage


def _look_up(rows, labels, key, name):
    """``rows`` with the label of ``key`` as ``name``; a hub's rows are spread over tasks."""
    got = gather(rows, labels.select(F.col("v").alias(key), F.col("label").alias("_label")), key,
                 spread=tuple(rows.columns), how="left")
    return got.withColumn(name, F.coalesce("_label", F.col(key))).drop("_label")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable, for every vertex of the edges (a, b).

    Every round hooks each root to its smallest neighbouring root, shortens the
    chains of roots, and contracts the edges to those that still join two roots.
    A hub collapses in the partial minimum; each round is written to the shared folder.
    """
    labels = cut_lineage(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("label", F.col("v")))
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    while not edges.isEmpty():
        hooks = cut_lineage(edges.groupBy(F.greatest("a", "b").alias("v")).agg(F.min(F.least("a", "b")).alias("label")))
        while True:  # label of a root's new root, until nothing changes
            jumped = _look_up(hooks.select("v", F.col("label").alias("_up")), hooks, "_up", "label")
            jumped = cut_lineage(jumped.select("v", "label", (F.col("label") < F.col("_up")).alias("moved")))
            hooks = jumped.select("v", "label")
            if jumped.where("moved").isEmpty():
                break
        labels = cut_lineage(_look_up(labels.withColumnRenamed("label", "_old"), hooks, "_old", "label").select("v", "label"))
        edges = _look_up(_look_up(edges, hooks, "a", "x"), hooks, "b", "y")
        edges = cut_lineage(edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
