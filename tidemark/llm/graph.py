"""Connected components of link tables by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staged


def renamed(rows: DataFrame, label: DataFrame, column: str = "comp") -> DataFrame:
    """``rows`` with each component's new name by ``label`` (node, comp); names that it lacks stay."""
    new = label.select(F.col("node").alias(column), F.col("comp").alias("new__"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("new__", column)).drop("new__")


def components(links: DataFrame, stage: Staged) -> DataFrame:
    """(node, comp) for every node that ``links`` (a, b) join with another: comp is the smallest node reachable.

    Each round hooks every label to the smallest neighbouring label and follows
    the hooks twice; then links inside one label go. Label chains halve at least,
    so rounds grow with the logarithm of the longest chain. Tables are written
    between rounds; only whether links are left comes to the driver.
    """
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("comp"))
        once = renamed(hook, hook)
        hooks.append(stage(renamed(once, hook).select("node", "comp"), "hooks"))
        rest = stage(renamed(renamed(edges, hooks[-1], "a"), hooks[-1], "b").where("a <> b").select("a", "b").distinct(), "edges")
        stage.drop(edges)
        edges = rest
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    label = hooks[0]
    for hook in hooks[1:]:
        label = renamed(label, hook)
    return stage(label.select("node", "comp"), "labels") if len(hooks) > 1 else label
