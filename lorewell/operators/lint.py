"""Audits of a knowledge base as one long table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import leaf
from lorewell.operators.graph import SEMANTIC, flat_clusters, orphans
from lorewell.operators.links import broken
from lorewell.operators.markdown import oversized


def heading_collisions(chunks: DataFrame, least: int = 3) -> DataFrame:
    """Last headings that at least ``least`` files have, with the files."""
    own = chunks.select(F.lower(leaf(F.col("heading"))).alias("heading"), "filename").filter("heading <> ''").distinct()
    return own.groupBy("heading").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_set("filename")).alias("files")).filter(F.col("n_files") >= least)


def findings(chunks: DataFrame, edges: DataFrame, links: DataFrame | None, pages: DataFrame | None = None, full_scope: bool = True) -> DataFrame:
    """finding, subject, detail: orphans, broken links, heading collisions (in full scope), oversized chunks,
    flat clusters and links to ids."""
    row = lambda df, kind, subject, detail: df.select(F.lit(kind).alias("finding"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))
    out = row(orphans(chunks.select("id", "filename"), edges, SEMANTIC), "orphan", F.col("id"), F.col("filename"))
    out = out.unionByName(row(oversized(chunks), "oversized", F.col("id"), F.col("tokens")))
    out = out.unionByName(row(chunks.filter(F.col("content").rlike(r"\]\(#[^)]*\)")), "id_href", F.col("id"), F.col("filename")))
    out = out.unionByName(row(flat_clusters(edges, chunks), "flat_cluster", F.col("filename"), F.col("n")))
    if links is not None and pages is not None:
        out = out.unionByName(row(broken(links, pages), "broken_link", F.col("target"), F.col("raw")))
    if full_scope:
        out = out.unionByName(row(heading_collisions(chunks), "heading_collision", F.col("heading"), F.col("n_files")))
    return out


def shown(found: DataFrame, most: int = 15) -> DataFrame:
    """The first ``most`` findings of each kind, and how many more there are.  Counts are summed within tasks first, and tasks keep their own first
    ``most``, so that no task gets all findings of a kind."""
    counts = found.groupBy("finding").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n_more"))
    order = Window.partitionBy("finding").orderBy("subject", "detail")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return first.join(F.broadcast(counts), "finding")  # a row for each kind
