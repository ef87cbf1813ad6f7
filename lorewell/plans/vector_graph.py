"""Vector and graph queries over the ``embeddings`` table.

A row is a chunk: its label is its file, labels below 3 lie in canon, the others in knowledge; the tier goes
by label modulo 4.  Thresholds are calibrated to these vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import tier_weight
from lorewell.functions.vectors import cosine
from lorewell.operators import graph as G
from lorewell.operators import vector_search as V
from lorewell.operators.adjacency import AdjacencyIndex
from lorewell.sources import files as S

LIMITS = {"similar": 0.32, "inter": 0.30, "cross": 0.31}


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    tier = F.when(F.col("label") % 4 == 0, "canon").when(F.col("label") % 4 == 1, "wiki").when(F.col("label") % 4 == 2, "memory").otherwise("raw")
    source = F.when(F.col("label") < 3, "canon").otherwise("knowledge")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("file"), F.col("label").cast("string")).alias("filename"), source.alias("source"), tier.alias("tier"), F.concat(F.lit("h"), (F.col("vec_id") % 7).cast("string")).alias("heading"))


def query_vector(rows: DataFrame) -> list[float]:
    """The vector of the smallest id."""
    return rows.orderBy("id").select("vector").first()[0]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similarity_edges(chunks(spark, sf_dir), **LIMITS)


CHUNKS_SQL = """chunks AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, 'file' || CAST(label AS VARCHAR) AS filename,
  CASE WHEN label < 3 THEN 'canon' ELSE 'knowledge' END AS source,
  CASE label % 4 WHEN 0 THEN 'canon' WHEN 1 THEN 'wiki' WHEN 2 THEN 'memory' ELSE 'raw' END AS tier, 'h' || CAST(vec_id % 7 AS VARCHAR) AS heading FROM embeddings)"""
WEIGHT_SQL = "CASE tier WHEN 'canon' THEN 1.15 WHEN 'wiki' THEN 1.0 WHEN 'memory' THEN 0.9 ELSE 0.75 END"
SEARCH_SQL = CHUNKS_SQL + """, q AS (SELECT v AS qv FROM chunks ORDER BY id LIMIT 1),
 scored AS (SELECT c.id, filename, source, tier, heading, list_cosine_similarity(v, qv) AS score FROM chunks c, q),
 fetched AS (SELECT *, score * """ + WEIGHT_SQL + """ AS weighted FROM scored ORDER BY score DESC, id LIMIT {fetch})"""
KNN_SQL = CHUNKS_SQL + """, pairs AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS cos, a.source AS sa, a.filename AS fa, b.source AS sb, b.filename AS fb
   FROM chunks a JOIN chunks b ON a.id <> b.id),
 knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(cos, 9) DESC, dst) AS rank FROM pairs QUALIFY rank <= 12)"""
EDGES_SQL = KNN_SQL + """, typed AS (SELECT src, dst, cos, CASE WHEN cos <= 0 THEN NULL WHEN sa = sb AND fa = fb AND cos > 0.32 THEN 'similar'
   WHEN sa = sb AND fa <> fb AND cos > 0.30 THEN 'inter_file' WHEN sa <> sb AND cos > 0.31 THEN 'cross_domain' END AS edge_type FROM knn),
 ranked AS (SELECT src, dst, cos, edge_type, row_number() OVER (PARTITION BY src, edge_type ORDER BY cos DESC, dst) AS r FROM typed WHERE edge_type IS NOT NULL),
 edges AS (SELECT src, dst, edge_type, round(cos, 3) AS weight, cos,
   CASE WHEN edge_type = 'similar' THEN CAST(r AS INTEGER) END AS intra_rank,
   CASE WHEN edge_type = 'similar' THEN CAST(count(*) OVER (PARTITION BY src, edge_type) AS INTEGER) END AS intra_total
   FROM ranked WHERE edge_type <> 'similar' OR r <= 5),
 adj AS (SELECT src AS node, dst AS neighbor, 'out' AS direction, edge_type, weight FROM edges
   UNION ALL SELECT dst, src, 'in', edge_type, weight FROM edges WHERE src <> dst),
 nb AS (SELECT node, neighbor, edge_type, weight, direction FROM adj
   QUALIFY row_number() OVER (PARTITION BY node, neighbor, edge_type ORDER BY weight DESC, direction DESC) = 1)"""

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH " + SEARCH_SQL.format(fetch=30) + " SELECT id, tier, round(score, 6) AS score, round(weighted, 6) AS weighted FROM fetched ORDER BY weighted DESC, score DESC, id LIMIT 10")
def semantic_topk_tiered(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return V.search(c, query_vector(c), 10).select("id", "tier", F.round("score", 6).alias("score"), F.round("weighted", 6).alias("weighted"))


@query("WITH " + SEARCH_SQL.format(fetch=90) + ", hits AS (SELECT * FROM fetched ORDER BY weighted DESC, score DESC, id LIMIT 30)"
       " SELECT source, filename, round(max(weighted), 6) AS best, count(*) AS n_hits, string_agg(CAST(id AS VARCHAR), ',' ORDER BY weighted DESC, id) AS ids FROM hits GROUP BY 1, 2 ORDER BY best DESC, source, filename LIMIT 10")
def semantic_grouped(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return V.search_grouped(c, query_vector(c), 10).select("source", "filename", F.round("best", 6).alias("best"), "n_hits", F.array_join(F.transform("hits", lambda h: h.id.cast("string")), ",").alias("ids"))


@query("WITH " + KNN_SQL + " SELECT src, dst, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_top12(spark, sf_dir):
    return V.nearest(chunks(spark, sf_dir), 12).select("src", "dst", F.round("cos", 6).alias("cos"), "rank")


@query("WITH " + KNN_SQL + " SELECT src, dst, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_by_index(spark, sf_dir):
    """The same by a neighbour index of small cells, which skips those that cannot hold a neighbour."""
    from lorewell.operators.neighbour_index import NeighbourIndex

    own = NeighbourIndex(spark, S.work_folder(spark, "cells")).build(chunks(spark, sf_dir), cell_bytes=1 << 15)
    return own.nearest(12)[0].select("src", "dst", F.round("cos", 6).alias("cos"), "rank")


@query(CHUNKS_SQL.replace("CAST(embedding AS DOUBLE[]) AS v", "CASE WHEN vec_id % 3 = 0 THEN CAST(embedding AS DOUBLE[])[:len(embedding) // 2] ELSE CAST(embedding AS DOUBLE[]) END AS v").replace("chunks AS", "WITH chunks AS", 1) + """,
 pairs AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS cos FROM chunks a JOIN chunks b ON a.id <> b.id AND (a.id % 3 = 0) = (b.id % 3 = 0)),
 knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(cos, 9) DESC, dst) AS rank FROM pairs QUALIFY rank <= 5) SELECT src, dst, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM knn""")
def knn_mixed_lengths(spark, sf_dir):
    """Vectors of two lengths: each meets those of its own."""
    c = chunks(spark, sf_dir)
    half = F.slice("vector", 1, F.floor(F.size("vector") / 2).cast("int"))
    return V.nearest(c.withColumn("vector", F.when(F.col("id") % 3 == 0, half).otherwise(F.col("vector"))), 5).select("src", "dst", F.round("cos", 6).alias("cos"), "rank")


@query("WITH " + EDGES_SQL + " SELECT src, dst, edge_type, weight FROM edges")
def edges_classified(spark, sf_dir):
    return edges(spark, sf_dir).select("src", "dst", "edge_type", "weight")


@query("WITH " + EDGES_SQL + " SELECT src, dst, weight, intra_rank, intra_total FROM edges WHERE edge_type = 'similar'")
def similar_ranked_capped(spark, sf_dir):
    return edges(spark, sf_dir).filter("edge_type = 'similar'").select("src", "dst", "weight", "intra_rank", "intra_total")


@query("WITH " + EDGES_SQL + """, emitted AS (SELECT src, dst, 'related' AS edge_type, weight, CASE edge_type WHEN 'similar' THEN 0 WHEN 'inter_file' THEN 1 ELSE 2 END AS seq FROM edges
  UNION ALL SELECT dst, src, 'related', weight, 3 FROM edges)
  SELECT src, dst, edge_type, weight, seq FROM emitted QUALIFY row_number() OVER (PARTITION BY src, dst, edge_type ORDER BY weight DESC, seq) = 1""")
def edge_dedup_maxweight(spark, sf_dir):
    e = edges(spark, sf_dir)
    seq = F.when(F.col("edge_type") == "similar", 0).when(F.col("edge_type") == "inter_file", 1).otherwise(2)
    both = e.select("src", "dst", F.lit("related").alias("edge_type"), "weight", seq.alias("seq")).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("related").alias("edge_type"), "weight", F.lit(3).alias("seq")))
    return G.merge_edges(both)


@query("WITH " + EDGES_SQL + " SELECT * FROM nb")
def neighbors_undirected(spark, sf_dir):
    return G.neighbors(edges(spark, sf_dir))


@query("WITH " + EDGES_SQL + " SELECT * FROM nb ORDER BY node, weight DESC, edge_type, neighbor LIMIT 50 OFFSET 50")
def paged_neighbors(spark, sf_dir):
    return G.page(G.neighbors(edges(spark, sf_dir)), ["node", F.desc("weight"), "edge_type", "neighbor"], 50, 50)


def _starts(e: DataFrame) -> DataFrame:
    """The five best-connected nodes."""
    return G.starts_of(G.degrees(e), [F.desc("degree"), "id"])


BFS_SQL = """, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
 starts AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 5),
 reach AS (SELECT id AS start, id AS node, 0 AS depth FROM starts UNION ALL
   SELECT r.start, n.neighbor, r.depth + 1 FROM reach r JOIN nb n ON n.node = r.node WHERE r.depth < 2 {only})
 SELECT start, node, min(depth) AS depth FROM reach GROUP BY 1, 2 HAVING min(depth) > 0"""


@query("WITH RECURSIVE " + EDGES_SQL + BFS_SQL.format(only=""))
def bfs_depth2(spark, sf_dir):
    e = S.stored(edges(spark, sf_dir), S.work_folder(spark, "edges"))  # read at every level
    return G.traverse(e, _starts(e), 2).select("start", "node", "depth")


@query("WITH RECURSIVE " + EDGES_SQL + BFS_SQL.format(only="AND n.edge_type <> 'cross_domain'"))
def bfs_exclude_type(spark, sf_dir):
    e = S.stored(edges(spark, sf_dir), S.work_folder(spark, "edges"))  # read at every level
    return G.traverse(e, _starts(e), 2, exclude=("cross_domain",)).select("start", "node", "depth")


@query("WITH RECURSIVE " + EDGES_SQL + BFS_SQL.format(only="").rsplit(" SELECT start, node", 1)[0] + """, near AS (SELECT start, node, min(depth) AS depth FROM reach GROUP BY 1, 2),
 found AS (SELECT n.start, n.node, n.depth, max(b.weight) AS weight FROM near n JOIN near p ON p.start = n.start AND p.depth = n.depth - 1 JOIN nb b ON b.node = p.node AND b.neighbor = n.node GROUP BY 1, 2, 3),
 every AS (SELECT node AS id, min(depth) AS depth, max(weight) AS w FROM found WHERE node NOT IN (SELECT id FROM starts) GROUP BY 1 UNION ALL SELECT id, 0, NULL FROM starts),
 nodes AS (SELECT id FROM every QUALIFY row_number() OVER (ORDER BY depth, w DESC NULLS LAST, id) <= 120),
 within AS (SELECT src, dst, edge_type, weight, row_number() OVER (ORDER BY weight DESC, edge_type, src, dst) AS n, count(*) OVER () > 400 AS capped FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))
 SELECT src, dst, edge_type, weight, capped FROM within WHERE n <= 400""")
def subgraph_bounded(spark, sf_dir):
    e = S.stored(edges(spark, sf_dir), S.work_folder(spark, "edges"))  # read at every level
    nodes, within = G.subgraph(e, _starts(e).withColumnRenamed("start", "id"), 2)
    return within.select("src", "dst", "edge_type", "weight", "capped")


ITEMS_SQL = """edges AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'references' AS edge_type, round(max(l_quantity) / 50, 2) AS weight FROM lineitem GROUP BY 1, 2
   UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'similar', round(max(l_quantity) / 50, 2) FROM lineitem GROUP BY 1, 2),
 nb AS (SELECT src AS node, dst AS neighbor, edge_type, weight FROM edges UNION ALL SELECT dst, src, edge_type, weight FROM edges),
 starts AS (SELECT 'p' || p_partkey AS id FROM part ORDER BY p_partkey LIMIT 5),
 one AS (SELECT s.id AS start, n.neighbor AS node, n.edge_type, s.id AS parent, n.weight FROM starts s JOIN nb n ON n.node = s.id QUALIFY row_number() OVER (PARTITION BY s.id, n.neighbor ORDER BY n.weight DESC, n.edge_type) = 1),
 two AS (SELECT o.start, n.neighbor AS node, n.edge_type, o.node AS parent, n.weight FROM one o JOIN nb n ON n.node = o.node WHERE n.neighbor <> o.start AND NOT EXISTS (SELECT 1 FROM one x WHERE x.start = o.start AND x.node = n.neighbor)
   QUALIFY row_number() OVER (PARTITION BY o.start, n.neighbor ORDER BY n.weight DESC, n.edge_type, o.node) = 1),
 reached AS (SELECT start, node, 1 AS depth, edge_type, parent, weight FROM one UNION ALL SELECT start, node, 2, edge_type, parent, weight FROM two)"""


def _item_index(spark: SparkSession, sf_dir: str) -> tuple[AdjacencyIndex, DataFrame]:
    """The kept adjacency of orders, suppliers and their parts, an edge a line, of which the heaviest counts, and the first five parts to start from."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    named = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    pairs = lambda k, c, kind: items.select(named(k, c).alias("src"), named("p", "l_partkey").alias("dst"), F.lit(kind).alias("edge_type"), F.round(F.col("l_quantity") / 50, 2).cast("double").alias("weight"))
    edges = pairs("o", "l_orderkey", "references").unionByName(pairs("s", "l_suppkey", "similar"))
    own = AdjacencyIndex(spark, S.work_folder(spark, "adjacency"), buckets=16, per_slot=64).build(edges)
    starts = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").limit(5).select(named("p", "p_partkey").alias("start"))
    return own, starts


@query("WITH " + ITEMS_SQL + " SELECT * FROM reached")
def kept_traversal(spark, sf_dir):
    """Orders and suppliers of five parts, and their other parts, by slots of a kept adjacency."""
    own, starts = _item_index(spark, sf_dir)
    return own.traverse(starts, 2)


@query("WITH " + ITEMS_SQL + """, every AS (SELECT node AS id, min(depth) AS depth, max(weight) AS w FROM reached WHERE node NOT IN (SELECT id FROM starts) GROUP BY 1 UNION ALL SELECT id, 0, NULL FROM starts),
 nodes AS (SELECT id FROM every QUALIFY row_number() OVER (ORDER BY depth, w DESC NULLS LAST, id) <= 120),
 within AS (SELECT src, dst, edge_type, weight, row_number() OVER (ORDER BY weight DESC, edge_type, src, dst) AS n, count(*) OVER () > 400 AS capped FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))
 SELECT src, dst, edge_type, weight, capped FROM within WHERE n <= 400""")
def kept_subgraph(spark, sf_dir):
    """What lies around five parts, by slots of a kept adjacency."""
    own, starts = _item_index(spark, sf_dir)
    return own.subgraph(starts.withColumnRenamed("start", "id"), 2, merge=True)[1]


@query("WITH " + EDGES_SQL + " SELECT edge_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM edges), 4) AS edge_share FROM edges GROUP BY 1")
def graph_stats_edge_share(spark, sf_dir):
    return G.edge_shares(edges(spark, sf_dir))


@query("WITH " + EDGES_SQL + ", deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)"
       " SELECT id, degree, round(degree / (SELECT count(*) FROM edges), 4) AS share_non_pc FROM deg ORDER BY degree DESC, id LIMIT 5")
def graph_hubs(spark, sf_dir):
    return G.hubs(edges(spark, sf_dir))


@query("WITH " + EDGES_SQL + " SELECT id, filename FROM chunks WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def graph_orphans(spark, sf_dir):
    return G.orphans(chunks(spark, sf_dir), edges(spark, sf_dir), G.SEMANTIC).select("id", "filename")


@query("WITH " + EDGES_SQL + """, o AS (SELECT count(*) AS n FROM chunks WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
  n AS (SELECT count(*) AS n FROM chunks), e AS (SELECT count(*) AS n FROM edges)
  SELECT n.n AS n_nodes, e.n AS n_edges, o.n AS n_orphans, CASE WHEN n.n > 0 THEN round(2 * e.n / n.n, 1) ELSE 0.0 END AS avg_degree FROM n, e, o""")
def graph_stats(spark, sf_dir):
    return G.graph_stats(chunks(spark, sf_dir), edges(spark, sf_dir))


@query("WITH " + EDGES_SQL + """, tagged AS (SELECT CASE WHEN edge_type IN ('similar', 'inter_file', 'cross_domain') THEN 'similarity' WHEN edge_type = 'parent_child' THEN 'hierarchy' ELSE 'entity' END AS provenance FROM
   (SELECT edge_type FROM edges UNION ALL SELECT 'parent_child' FROM chunks))
 SELECT provenance, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM tagged), 1) AS percent FROM tagged GROUP BY 1""")
def provenance_classes(spark, sf_dir):
    e = edges(spark, sf_dir).select("edge_type")
    return G.provenance_shares(e.unionByName(chunks(spark, sf_dir).select(F.lit("parent_child").alias("edge_type"))))


@query("WITH " + EDGES_SQL + """ SELECT node, count(CASE WHEN weight >= 0.33 AND direction = 'out' THEN 1 END) AS n_out, count(CASE WHEN weight >= 0.33 AND direction = 'in' THEN 1 END) AS n_in,
  count(DISTINCT CASE WHEN weight >= 0.33 THEN neighbor END) AS n_neighbors, count(CASE WHEN weight < 0.33 THEN 1 END) AS n_suppressed FROM adj GROUP BY 1""")
def node_profile(spark, sf_dir):
    return G.node_profile(edges(spark, sf_dir), 0.33)


@query("WITH " + EDGES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY node, edge_type ORDER BY weight DESC, neighbor, direction) AS rank, count(*) OVER (PARTITION BY node, edge_type) AS n FROM adj)
  SELECT node, neighbor, direction, edge_type, weight, CAST(rank AS INTEGER) AS rank, greatest(n - 3, 0) AS n_more FROM r WHERE rank <= 3""")
def node_top_edges(spark, sf_dir):
    return G.top_edges(edges(spark, sf_dir), 3).select("node", "neighbor", "direction", "edge_type", "weight", "rank", "n_more")


@query("WITH " + EDGES_SQL + """, f AS (SELECT a.source AS node_source, a.filename AS node_file, b.source AS neighbor_source, b.filename AS neighbor_file, round(sum(weight), 6) AS weight
   FROM adj JOIN chunks a ON a.id = node JOIN chunks b ON b.id = neighbor WHERE a.filename <> b.filename OR a.source <> b.source GROUP BY 1, 2, 3, 4)
 SELECT *, CAST(row_number() OVER (PARTITION BY node_source, node_file ORDER BY weight DESC, neighbor_source, neighbor_file) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""")
def related_files(spark, sf_dir):
    return G.related_files(edges(spark, sf_dir), chunks(spark, sf_dir), 5)


@query("WITH " + EDGES_SQL + """ SELECT source, filename, count(*) AS n, min(weight) AS low, max(weight) AS high FROM edges JOIN chunks ON id = src WHERE edge_type = 'similar'
  GROUP BY 1, 2 HAVING count(*) >= 5 AND round(max(weight) - min(weight), 6) <= 0.2""")
def flat_similarity_clusters(spark, sf_dir):
    return G.flat_clusters(edges(spark, sf_dir), chunks(spark, sf_dir), 5, 0.2)


@query("WITH " + SEARCH_SQL.format(fetch=90) + ", b AS (SELECT id, source, filename, score FROM scored QUALIFY row_number() OVER (PARTITION BY source, filename ORDER BY score DESC, id) = 1)"
       " SELECT id, source, filename, round(score, 6) AS score FROM b ORDER BY score DESC, id LIMIT 8")
def best_hit_per_file(spark, sf_dir):
    c = chunks(spark, sf_dir)
    scored = c.withColumn("score", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query_vector(c)])))
    return V.best_per(scored, ["source", "filename"], [F.desc("score"), F.col("id")], 8).select("id", "source", "filename", F.round("score", 6).alias("score"))


@query("WITH " + EDGES_SQL + ", q AS (SELECT v AS qv FROM chunks ORDER BY id LIMIT 1), scored AS (SELECT id, tier, list_cosine_similarity(v, qv) AS score FROM chunks, q),"
       " fetched AS (SELECT *, score * " + WEIGHT_SQL + " AS weighted FROM scored ORDER BY score DESC, id LIMIT 15), hits AS (SELECT * FROM fetched ORDER BY weighted DESC, score DESC, id LIMIT 5)"
       " SELECT id AS hit, round(weighted, 6) AS weighted, neighbor, edge_type, weight FROM hits LEFT JOIN nb ON node = id AND weight >= 0.31")
def hybrid_graph_search(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = V.search(c, query_vector(c), 5).select(F.col("id").alias("hit"), F.round("weighted", 6).alias("weighted"))
    near = G.neighbors(edges(spark, sf_dir), min_weight=0.31)
    return hits.join(near, F.col("hit") == F.col("node"), "left").select("hit", "weighted", "neighbor", "edge_type", "weight")


@query("WITH " + EDGES_SQL + """, cond AS (SELECT neighbor AS id, sum((CASE edge_type WHEN 'similar' THEN 0.5 WHEN 'inter_file' THEN 0.3 WHEN 'cross_domain' THEN 0.2 END) * weight) AS gain FROM adj GROUP BY 1)
 SELECT c.id, round(least(1.0 + coalesce(gain, 0.0), 12.0) * 0.982, 6) AS heat FROM chunks c LEFT JOIN cond USING (id)""")
def heat_step(spark, sf_dir):
    heat = chunks(spark, sf_dir).select("id", F.lit(1.0).alias("heat"))
    return G.spread_heat(edges(spark, sf_dir), heat, {"similar": 0.5, "inter_file": 0.3, "cross_domain": 0.2}).select("id", F.round("heat", 6).alias("heat"))


@query("WITH " + CHUNKS_SQL + ", t AS (SELECT tier, count(*) AS n, round(avg(" + WEIGHT_SQL + "), 6) AS weight FROM chunks GROUP BY 1) SELECT tier, n, weight, CAST(CASE tier WHEN 'canon' THEN 0 WHEN 'wiki' THEN 1 WHEN 'memory' THEN 2 ELSE 3 END AS INTEGER) AS rank FROM t")
def tier_listing(spark, sf_dir):
    from lorewell.functions.text import tier_rank

    c = chunks(spark, sf_dir)
    return c.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg(tier_weight(F.col("tier"))), 6).alias("weight")).withColumn("rank", tier_rank(F.col("tier")).cast("int"))


@query("WITH " + CHUNKS_SQL + " SELECT count(DISTINCT source || ':' || filename) AS n_files, count(*) AS n_vectors FROM chunks")
def index_stats(spark, sf_dir):
    return chunks(spark, sf_dir).agg(F.countDistinct(F.struct("source", "filename")).alias("n_files"), F.count("*").alias("n_vectors"))
