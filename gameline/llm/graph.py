"""Connected components by repeated contraction of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gameline.llm.common import released, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), as a stored table; root is the smallest node that edges reach.

    Each round hooks every node to its smallest neighbour, follows the hooks twice, renames the edges' ends and drops
    those inside one tree, so the edge table shrinks by a factor each round. Nulls and self links are ignored; repeated
    edges count once; an empty table gives no rows."""
    pairs = stored(edges.select("a", "b").where("a is not null and b is not null").select(F.least("a",
        "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    names = None
    while not pairs.isEmpty():
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("node"),
            F.col("a").alias("to")))
        first = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")))
        hook = first
        for _ in range(2):  # hooks lead to smaller nodes only
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hook = hook.join(up, "root").select("node", F.col("above").alias("root"))
        hook = stored(hook)
        released(first)
        a, b = hook.toDF("a", "x"), hook.toDF("b", "y")
        moved = pairs.join(a, "a").join(b, "b").select("x", "y")
        rest = hook.select("node", F.col("root").alias("x")).join(hook.select(F.col("node").alias("x"),
            F.col("root").alias("y")), "x").select("x", "y")  # hooks not followed to their end
        fewer = stored(moved.unionByName(rest).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        released(pairs)
        pairs = fewer
        if names is None:
            names = hook
        else:
            renamed = stored(names.join(hook.select(F.col("node").alias("root"), F.col("root").alias("above")),
                "root", "left").select("node", F.coalesce("above", "root").alias("root")))
            released(names, hook)
            names = renamed
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")) if names is None else names
