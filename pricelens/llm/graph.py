"""Connected components of a graph that is only ever held as tables."""

from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import materialize


def components(edges: DataFrame, name="components") -> DataFrame:
    """`node, component` of every node of the undirected edges `a, b`; a component is its smallest node.

    In each round every node and the node it points to take the smallest label seen over an edge, and
    then labels are followed one step. Paths shorten by half or better, so rounds grow with the
    logarithm of the longest. Labels are written after each round, which cuts the lineage; partial
    minima keep a node with very many edges from meeting in one task, and joins read plain tables, so
    that adaptive execution can split a hot label.
    """
    both = edges.where("a <> b").select("a", "b").distinct()
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    least = F.least(F.col("a"), F.min("b"))
    labels = materialize(both.groupBy("a").agg(least.alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-0")
    for turn in range(1, 1_000):
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        seen = both.join(of_a, "a").join(of_b, "b").where("label_b < label_a")
        told = seen.select(F.explode(F.array("a", "label_a")).alias("node"), "label_b")
        best = told.groupBy("node").agg(F.min("label_b").alias("told"))
        lower = materialize(
            labels.join(best, "node", "left").select("node", F.least("label", F.coalesce("told", "label")).alias("label")),
            f"{name}-{turn}-told",
        )
        follow = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(lower.join(follow, "label").select("node", F.col("next").alias("label")), f"{name}-{turn}")
        if _sum(after) == _sum(labels):  # labels only ever fall
            break
        labels = after
    return labels.select("node", F.col("label").alias("component"))


def _sum(labels):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
