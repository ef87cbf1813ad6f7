"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch


def components(edges: DataFrame, store: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges``; nulls are dropped.

    Labels go from neighbour to neighbour, then each root takes its root's label (pointer jumping),
    until nothing changes.  The edges of a hub meet its label in a join of two written tables, which adaptive
    execution splits; what they bring back is pre-aggregated by node."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    links = store.write(both.union(both.select("v", "u")).distinct(), "links")
    labels = store.write(links.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("root")), "labels")
    while True:
        near = links.join(labels, links.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        best = labels.join(near, labels.node == near.u, "left").select("node", "root", F.least("root", "near").alias("best"))
        up = labels.select(F.col("node").alias("best"), F.col("root").alias("top"))
        step = store.write(best.join(up, "best", "left").select("node", F.coalesce("top", "best").alias("root"), (F.coalesce("top", "best") < F.col("root")).alias("moved")), "step")
        moved = step.filter("moved").limit(1).count()
        store.drop(labels)
        labels = step.select("node", "root")
        labels._scratch_path = step._scratch_path
        if not moved:
            store.drop(links)
            return labels


def merged(roots: DataFrame, edges: DataFrame, store: Scratch) -> DataFrame:
    """The (node, root) of ``roots`` once the further ``edges`` (a, b) join its components."""
    of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b")
    up = components(between, store)
    old = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = store.write(old.unionByName(up.join(roots.select("node"), "node", "left_anti")), "merged")
    store.drop(roots, up)
    return out
