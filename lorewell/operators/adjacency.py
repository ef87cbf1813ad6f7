"""A kept adjacency of a graph, so that a step of a traversal moves the frontier and not the edges.

One table, bucketed and sorted by slot (``sources.bucketed``): ``near`` holds every edge at both of its ends, with its other columns at its source.  A slot is a node,
or a shard of one: nodes of more than ``per_slot`` edges (``hubs``) have their edges dealt over shards by the other end, and a frontier asks for all shards of a hub,
so that no task holds a hub whole.  Hubs are kept few: in a graph of more than ``MOST_HUBS`` times ``per_slot`` ends a slot holds ends / ``MOST_HUBS`` edges, so that hubs
are sent to all and the edges, when they are dealt, are shuffled once and by their slot only.  A step joins
the frontier's slots with the table: only the frontier is shuffled, to the table's buckets, or sent to all where Spark finds it small.  Of a frontier of few slots the
slots are written into the scan, which then opens their buckets alone.

Edges with a null end can be walked to their null end only; a null weight is no way; equal rows of ``edges`` lie in one slot; an empty graph
reaches nothing.  Other columns of the edges are kept for ``subgraph``.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import graph
from lorewell.sources import bucketed
from lorewell.sources import files as S

#: Slots that are written into the scan; ends of edges for which there is one bucket at least; hubs at most; cells of nodes, by which ends are counted
#: before they are counted by node; edges that a task deals at most, so that it need not spill.
FEW_SLOTS, BUCKET_EDGES, MOST_HUBS, CELLS, TASK_EDGES = 256, 1 << 20, 1 << 17, 1 << 20, 1 << 21


class AdjacencyIndex:
    """``path``: a folder that all executors share, new for each build.  ``buckets``: files of the table at least; there are more where the edges are
    many, so that none grows with the graph.  ``per_slot``: edges of a slot, more in a graph so large that hubs were too many."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, per_slot: int = 50_000):
        self.spark, self.path, self.buckets, self.per_slot = spark, path.rstrip("/"), buckets, per_slot

    def build(self, edges: DataFrame) -> AdjacencyIndex:
        given = f"{self.path}/given"
        edges.write.option("compression", "zstd").parquet(given)  # read once, however many passes follow
        edges = self.spark.read.schema(edges.schema).parquet(given)
        n = edges.count()
        self._write_hubs(edges, max(self.per_slot, 2 * n // MOST_HUBS))
        with self._small_splits(given, n):
            self._write_near(edges, max(self.buckets, 2 * n // BUCKET_EDGES))
        S.remove(self.spark, given)
        return self

    def _write_hubs(self, edges: DataFrame, per_slot: int) -> None:
        """Nodes of more than ``per_slot`` edges: these lie in cells of as many, and only in such cells ends are counted by node."""
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node is not null").withColumn("cell", F.pmod(F.xxhash64("node"), F.lit(CELLS)).cast("int"))
        full = ends.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > per_slot).select("cell")
        count = ends.join(F.broadcast(full), "cell").groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > per_slot)
        count.select("node", F.ceil(F.col("n") / per_slot).cast("int").alias("shards")).write.parquet(f"{self.path}/hubs")

    def _write_near(self, edges: DataFrame, buckets: int) -> None:
        rest = [c for c in edges.columns if c not in ("src", "dst", "edge_type", "weight")]
        near = graph.adjacency(edges.select("src", "dst", "edge_type", "weight", *[F.struct(*rest).alias("more")] * bool(rest))).filter("node is not null and (direction = 'out' or weight >= 0)")
        if rest:
            near = near.withColumn("more", F.when(F.col("direction") == "out", F.col("more")))
        sharded = near.join(F.broadcast(self.hubs()), "node", "left")
        shard = F.when(F.col("shards").isNull(), 0).otherwise(F.pmod(F.xxhash64("neighbor"), F.col("shards")))
        bucketed.write(sharded, f"{self.path}/near", "slot", buckets, lambda dealt: dealt.drop("node", "shards"), _slot(shard, F.col("node")), "zstd")

    @contextlib.contextmanager
    def _small_splits(self, path: str, n: int) -> Iterator[None]:
        """Tasks read ``TASK_EDGES`` of the ``n`` rows of a folder at most, a MB at least, as the files are packed far closer than rows that wait to be sent."""
        fs, p = S.filesystem(self.spark, path)
        key = "spark.sql.files.maxPartitionBytes"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(min(128 << 20, max(1 << 20, fs.getContentSummary(p).getLength() * TASK_EDGES // max(1, n)))))
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def hubs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/hubs")

    def _node_type(self) -> str:
        return dict(self.hubs().dtypes)["node"]

    def slots(self, front: DataFrame) -> DataFrame:
        """The rows of a frontier (column node) once for each slot of their node."""
        shards = F.coalesce("shards", F.lit(1))
        return front.join(self.hubs(), "node", "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1))).withColumn("slot", _slot(F.col("_shard"), F.col("node"))).drop("shards", "_shard")

    def read(self, name: str, slots: DataFrame) -> DataFrame:
        """A table, of which only the buckets of the asked slots are opened if these are few."""
        table = bucketed.read(self.spark, f"{self.path}/{name}")
        few = [r[0] for r in slots.select("slot").distinct().limit(FEW_SLOTS + 1).collect()]
        return table if len(few) > FEW_SLOTS else table.filter(F.col("slot").isin(few)) if few else table.limit(0)

    def step(self, front: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
        """The neighbours of a frontier (start, node): start, node, p (where they were come from), edge_type, weight."""
        asked = self.slots(front.select("start", "node")).withColumnRenamed("node", "p")
        near = self.read("near", asked).filter("weight >= 0").select("slot", F.col("neighbor").alias("node"), "edge_type", "weight")
        if exclude:
            near = near.filter(~F.col("edge_type").isin(*exclude))
        return asked.join(near, "slot").select("start", "node", "p", "edge_type", "weight")

    def traverse(self, starts: DataFrame, depth: int = 2, exclude: tuple[str, ...] = (), min_weight: float = 0.0) -> DataFrame:
        """As ``graph.traverse``.  Each frontier is written, so that no step is computed twice and a lost executor costs one step."""
        graph.check_walk(depth, exclude)
        keep = lambda front: S.stored(front, S.work_folder(self.spark, "frontier"))
        return graph.walk(lambda front: self.step(front, exclude), starts, self._node_type(), depth, min_weight, keep)

    def neighbors(self, nodes: DataFrame) -> DataFrame:
        """The rows of ``graph.neighbors`` for some nodes (column node)."""
        asked = self.slots(nodes.select("node").distinct())
        near = self.read("near", asked).filter("weight >= 0").join(asked, "slot")
        return graph.heaviest(near, "slot").select("node", "neighbor", "edge_type", "weight", "direction")

    def subgraph(self, seeds: DataFrame, depth: int = 2, allowed: tuple[str, ...] = graph.EDGE_TYPES, max_nodes: int = 120, max_edges: int = 400, merge: bool = False) -> tuple[DataFrame, DataFrame]:
        """As ``graph.subgraph``; of the edges only those of the taken nodes' slots are read.  Columns of edges: src, dst, edge_type, weight and the others.
        ``merge``: edges that differ in their weight only are one, of the greatest weight, so that they needn't be grouped before they are kept (walks take the heaviest anyway)."""
        graph.check_subgraph(depth, allowed, max_nodes, max_edges)
        seeds = seeds.orderBy("id").limit(5)
        reach = self.traverse(seeds.select(F.col("id").alias("start")), depth, graph.other_types(allowed))
        nodes = S.stored(graph.first_nodes(reach, seeds, max_nodes), S.work_folder(self.spark, "taken"))
        asked = self.slots(nodes.select(F.col("id").alias("node"))).select("slot", "node")
        near = self.read("near", asked).filter((F.col("direction") == "out") & F.col("edge_type").isin(*allowed)).join(asked, "slot")
        within = near.select(F.col("node").alias("src"), F.col("neighbor").alias("dst"), "edge_type", "weight", *["more.*"] * ("more" in near.columns))
        within = within.join(F.broadcast(nodes.select(F.col("id").alias("dst"))), "dst", "left_semi")  # at most 255 rows
        if merge:
            within = within.groupBy(*[c for c in within.columns if c != "weight"]).agg(F.max("weight").alias("weight")).select(*within.columns)
        return nodes, graph.first_edges(within, max_edges)


def _slot(shard: Column, node: Column) -> Column:
    return F.concat_ws(":", shard.cast("string"), node.cast("string"))
