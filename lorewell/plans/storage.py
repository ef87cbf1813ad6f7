"""Queries that write tables, files and documents and read them again.

They write to a folder of their own below ``spark.checkpoint.dir``; where that is unset and Spark runs inside one machine, below a
temporary one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import index, lifecycle
from lorewell.plans.library import _files, num, read, text
from lorewell.plans.library import FILES as FILES_SQL
from lorewell.sources import files as S
from lorewell.sources import snapshots

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


work = S.work_folder


@query("WITH " + FILES_SQL + " SELECT source, CASE WHEN source = 'canon' THEN 'canon' WHEN filename LIKE 'raw/%' THEN 'raw' ELSE 'wiki' END AS tier, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM f GROUP BY 1, 2")
def chunk_table(spark, sf_dir):
    """Chunks written by source and tier, some of them once more, and read again."""
    from lorewell.functions.text import tier

    f = _files(spark, sf_dir)
    rows = f.select(F.col("doc_id").cast("string").alias("id"), "source", "filename", F.col("text").alias("document"), tier(F.col("source"), F.col("filename")).alias("tier"))
    path = work(spark, "chunks")
    S.write_chunks(rows.filter("source = 'canon'").withColumn("document", F.lit("old")), path)
    S.write_chunks(rows, path)
    return S.read_chunks(spark, path).groupBy("source", "tier").agg(F.count("*").alias("n"), F.sum(F.length("document")).alias("n_chars"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'references' ELSE 'similar' END AS edge_type, count(*) AS n_edges, count(DISTINCT o_custkey) AS n_nodes FROM orders GROUP BY 1")
def graph_store(spark, sf_dir):
    """A graph written and read again."""
    o = read(spark, sf_dir, "orders")
    edges = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "references").otherwise("similar").alias("edge_type"))
    path = work(spark, "graph")
    S.write_graph(o.select(F.col("o_custkey").alias("id")).distinct(), edges, path)
    nodes, found = S.read_graph(spark, path)
    return found.join(nodes, F.col("src") == F.col("id")).groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_nodes"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a' || n_nationkey ELSE 'b' END AS target_file, count(*) AS n FROM nation GROUP BY 1")
def graph_document(spark, sf_dir):
    """A graph as one JSON document."""
    n = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    rows = [f'{{"source_id": "s", "target_id": "{"a%d" % r["n_nationkey"] if r["n_nationkey"] % 2 == 0 else "b"}", "edge_type": "references", "weight": 1.0}}' for r in n]
    path = work(spark, "document") + "/graph.json"
    S.write_small(spark, path, f'{{"nodes": [{{"id": "s"}}], "edges": [{", ".join(rows)}]}}')
    return S.read_graph_document(spark, path)[1].groupBy(F.col("dst").alias("target_file")).agg(F.count("*").alias("n"))


@query("""SELECT 'c' || conv_id AS conv_id, CAST(turn AS BIGINT) AS turn, role, md5(text) AS text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations
 UNION ALL SELECT 0, (SELECT count(*) FROM conversations WHERE conv_id = 0), 'user', 'one more')""")
def session_turns(spark, sf_dir):
    """Conversations as session documents, one with a turn more, and one deleted after it was added."""
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    path = work(spark, "sessions")
    t.select(text("c", F.col("conv_id")).alias("id"), F.lit("New Chat").alias("title"), F.transform("t", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("turns")).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    sessions = spark.read.schema(S.SESSION_SCHEMA).json(path)
    sessions = S.add_turn(sessions.unionByName(S.new_session(spark).withColumn("id", F.lit("gone"))), "c0", "user", "one more")
    return S.turns_of_sessions(S.delete_session(sessions, "gone")).select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("""WITH b AS (SELECT 'd' || doc_id || '.md' AS path, 1000 AS ms, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 7 <> 0),
 a AS (SELECT 'd' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 500 ELSE 1000 END AS ms, sha256(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' edited' ELSE '' END) AS digest FROM documents WHERE doc_id % 5 <> 0)
 SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS op, CAST(coalesce(a.ms, b.ms) AS BIGINT) AS mtime FROM b FULL JOIN a ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.digest <> b.digest""")
def snapshot_changes(spark, sf_dir):
    """Documents as the files of two snapshots; changed ones have an older time, or the same."""
    d = read(spark, sf_dir, "documents")
    own = F.coalesce("text", F.lit(""))
    of = lambda rows, ms, content: rows.select(text("d", F.col("doc_id"), ".md").alias("path"), ms.cast("long").alias("ms"), F.length(content).cast("long").alias("size"), F.sha2(content, 256).alias("digest"))
    before = of(d.filter("doc_id % 7 <> 0"), F.lit(1000), own)
    after = of(d.filter("doc_id % 5 <> 0"), F.when(F.col("doc_id") % 2 == 0, 500).otherwise(1000), F.when(F.col("doc_id") % 3 == 0, F.concat(own, F.lit(" edited"))).otherwise(own))
    return snapshots.difference(before, after)


@query("SELECT event_type AS event, count(*) AS n, '## [2024-01-02 03:04:05] ' || event_type || ' | x.md' || CASE WHEN event_type = 'view' THEN ' | tags: t' ELSE '' END AS line FROM events GROUP BY 1")
def event_log(spark, sf_dir):
    """Events appended to a log in two parts and read again, and the line of a change log."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("event"), F.create_map(F.lit("k"), F.col("props")).alias("data"))
    path = work(spark, "log")
    S.append_log(e.filter("event = 'view'"), path)
    S.append_log(e.filter("event <> 'view'"), path)
    found = S.read_log(spark, path).groupBy("event").agg(F.count("*").alias("n"))
    change = found.select("event", F.lit("2024-01-02 03:04:05").cast("timestamp").alias("ts"), F.col("event").alias("action"), F.lit("x.md").alias("target"), F.when(F.col("event") == "view", "t").otherwise("").alias("tags"))
    lines = S.mutation_log(change.select("ts", "action", "target", "tags")).withColumn("event", F.regexp_extract("value", r"\] (\w+) \|", 1))
    return found.join(lines, "event").select("event", "n", F.col("value").alias("line"))


def _tree(spark, sf_dir, name: str) -> dict[str, str]:
    """Nations as markdown files below their region's folder; odd ones are canon."""
    base = work(spark, name)
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for r in n.collect():  # 25 rows
        root = "canon" if r["n_nationkey"] % 2 else "knowledge"
        link = f"[[{(r['n_nationkey'] + 2) % 25}]]"
        S.write_small(spark, f"{base}/{root}/{r['r_name']}/{r['n_nationkey']}.md", f"# Nation {r['n_nationkey']}\n{r['n_name'].title()} lies in {r['r_name'].title()}, see {link}.\n## Part {r['n_nationkey'] % 5}\nmore\n")
    S.ensure_folder(spark, f"{base}/knowledge/empty")
    return {k: f"{base}/{k}" for k in ("canon", "knowledge")}


@query("SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'canon' ELSE 'knowledge' END AS source, r_name || '/' || n_nationkey || '.md' AS filename, CASE WHEN n_nationkey = 3 THEN 'canon' ELSE 'first' END AS found FROM nation JOIN region ON n_regionkey = r_regionkey")
def markdown_tree(spark, sf_dir):
    """Files below two roots, and one of them by its path."""
    files = S.read_markdown(spark, {**_tree(spark, sf_dir, "tree"), "absent": work(spark, "none")})
    name = files.filter("filename like '%/3.md'").select("filename").first()[0]
    one = S.read_file(files, name).select("filename", F.col("source").alias("found"))
    return files.join(one, "filename", "left").select("source", "filename", F.coalesce("found", F.lit("first")).alias("found"))


@query("""WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 1 THEN 'canon' ELSE 'knowledge' END AS source, r_name || '/' || n_nationkey || '.md' AS filename FROM nation JOIN region ON n_regionkey = r_regionkey)
 SELECT source, filename, CASE WHEN k = 4 THEN 3 ELSE 1 END AS n_chunks, 25 AS first_build, 0 AS second_build, 1 AS one_file, 0 AS elsewhere, 24 AS forced FROM n WHERE k <> 6""")
def index_lifecycle(spark, sf_dir):
    """An index built, left alone, brought up to date after an edit and a deletion, and made anew."""
    roots, path = _tree(spark, sf_dir, "vault"), work(spark, "index")
    own = lifecycle.KnowledgeIndex(spark, path, roots, index.Embedder(index.hash_embedding(16), dim=16), dim=16, parts=4)
    first, second = own.build(), own.build()
    files = {r["filename"].rsplit("/", 1)[1]: r["filename"] for r in S.read_markdown(spark, roots).select("filename").collect()}
    S.write_small(spark, f"{roots['knowledge']}/{files['4.md']}", "# New\nx\n# Newer\ny\n# Newest\nz")
    one = own.reindex_file(f"{roots['knowledge']}/{files['4.md']}")
    elsewhere = own.reindex_file(f"{path}/x.md") + own.reindex_file(f"{roots['knowledge']}/none.md")
    S.remove(spark, f"{roots['knowledge']}/{files['6.md']}")
    own.build()
    forced = own.build(force=True)
    counts = own.chunks().groupBy("source", "filename").agg(F.count("*").cast("int").alias("n_chunks"))
    return counts.select("*", *[F.lit(v).alias(k) for k, v in (("first_build", first), ("second_build", second), ("one_file", one), ("elsewhere", elsewhere), ("forced", forced))])


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT CAST(a.k AS VARCHAR) || '.md' AS src, CAST(b.k AS VARCHAR) || '.md' AS dst, 'references' AS edge_type FROM n a JOIN n b ON b.k = (a.k + 2) % 25""")
def index_graph(spark, sf_dir):
    """The links of an index's graph, built with its other edges."""
    own = lifecycle.KnowledgeIndex(spark, work(spark, "linked"), _tree(spark, sf_dir, "linked-vault"), index.Embedder(index.hash_embedding(16), dim=16), dim=16, parts=2)
    own.build()
    _, edges = own.graph()
    name = own.chunks().select("id", F.element_at(F.split("filename", "/"), -1).alias("file"))
    side = lambda k: name.select(F.col("id").alias(k), F.col("file").alias(f"{k}_file"))
    found = edges.filter("edge_type = 'references'").join(side("src"), "src").join(side("dst"), "dst")
    return found.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), "edge_type")
