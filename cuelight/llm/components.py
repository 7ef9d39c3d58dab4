"""Connected components of a table of edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import scratch, staged


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges
    (a, b: long). Each round hooks nodes to their smallest neighbour, follows
    the hooks to their ends by doubling, and contracts the edges; a round leaves
    at most half of the nodes, so rounds are few. Every table is written to the
    shared folder, so lineage stays short."""
    with scratch() as keep:
        edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        roots = None
        while not edges.isEmpty():
            with scratch() as keep_round:
                hook = _hooked(edges)
                up = hook.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
                down = hook.select(F.col("node").alias("_m"), F.col("root").alias("_s"))
                roots = hook if roots is None else roots.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
                roots = keep_round(staged(roots, "roots"))
                left = edges.join(up, F.col("a") == F.col("_n")).join(down, F.col("b") == F.col("_m")).where("_r <> _s")
                edges = keep_round(staged(left.select(F.least("_r", "_s").alias("a"), F.greatest("_r", "_s").alias("b")).distinct(), "edges"))
        if roots is None:
            return keep(edges).select(F.col("a").alias("node"), F.col("b").alias("root"))
        return keep(roots)


def _hooked(edges: DataFrame) -> DataFrame:
    """node, root: each node's smallest neighbour, followed to the end."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), F.col("p").alias("root")), "hook")
    while True:
        up = hook.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        nxt = staged(hook.join(up, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("_moved")), "hook")
        hook = nxt.select("node", "root")
        if nxt.where("_moved").isEmpty():
            return hook
