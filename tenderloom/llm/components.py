"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenderloom.llm.common import stored

JUMPS = 3


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (a, b) of integers.

    Each round hooks a node to the smallest of its neighbours with a smaller id, shortens the
    chains that makes by a few jumps, and contracts the edges. Hooks are minima, so a node with
    millions of edges is reduced in every task before the shuffle. Ids and edges stay in tables;
    the driver only learns whether edges are left.
    """
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stored(pairs.distinct(), "edges")
    labels = None
    for _ in range(limit):
        if left.isEmpty():
            break
        hook = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        for _ in range(JUMPS):
            further = hook.select(F.col("id").alias("to"), F.col("to").alias("_next"))
            hook = hook.join(further, "to", "left").select("id", F.coalesce("_next", "to").alias("to"))
        hook = stored(hook, "hooks")
        labels = hook if labels is None else stored(_moved(labels, hook), "labels")
        left = stored(_contracted(left, hook), "edges")
    else:
        raise RuntimeError(f"components not found in {limit} rounds")
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = labels.select("to").distinct().join(labels.select(F.col("id").alias("to")), "to", "left_anti")
    return labels.unionByName(roots.select(F.col("to").alias("id"), "to")).select("id", F.col("to").alias("component"))


def _moved(labels: DataFrame, hook: DataFrame) -> DataFrame:
    """Labels after a round: earlier labels follow their root's hook, new hooks are added."""
    step = hook.select(F.col("id").alias("to"), F.col("to").alias("_next"))
    moved = labels.join(step, "to", "left").select("id", F.coalesce("_next", "to").alias("to"))
    return moved.unionByName(hook.select("id", "to"))


def _contracted(edges: DataFrame, hook: DataFrame) -> DataFrame:
    """Edges between the nodes that are left, each once, the smaller first."""
    for end in ("a", "b"):
        step = hook.select(F.col("id").alias(end), F.col("to").alias("_next"))
        edges = edges.join(step, end, "left").withColumn(end, F.coalesce("_next", end)).drop("_next")
    return (
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
