"""Queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import fuzzy, index, lint, links, markdown

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LINES = "lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)"
SUMMARY = (r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: " + STRIP.format("x") + r"), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '---') AND NOT starts_with(x, '|') AND NOT regexp_matches(x, '^[-*] \[[^\]]*\]\(#')) AS p FROM documents)"
           " SELECT doc_id, CASE WHEN coalesce(len(p), 0) = 0 THEN '(no summary)' WHEN length(p[1]) > {0} THEN left(p[1], {0}) || '...' ELSE p[1] END AS summary FROM l")
TOKENS = "(CASE WHEN length({0}) > 0 THEN greatest(1, length({0}) // 4) ELSE 0 END)"


@query(SUMMARY.format(250))
def mechanical_summary(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.summary(F.col("text"), 250).alias("summary"))


@query(SUMMARY.format(150))
def doc_summary(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.summary(F.col("text"), 150).alias("summary"))


@query("WITH " + LINES + ", s AS (SELECT *, sum(CASE WHEN length(line) <= 40 AND line LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM lines)"
       " SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s GROUP BY 1, 2")
def line_sections(spark, sf_dir):
    """A short line that ends with a full stop starts a section."""
    rows = markdown.lines_of(documents(spark, sf_dir), ["doc_id"])
    out = markdown.sections(rows, ["doc_id"], (F.length("line") <= 40) & F.col("line").endswith("."))
    return out.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


HEADS = "WITH " + LINES + ", h AS (SELECT doc_id, CAST(line_no AS INTEGER) AS ord, CAST((line_no * 7 + doc_id) % 5 + 1 AS INTEGER) AS level, CAST(" + TOKENS.format("line") + " AS BIGINT) AS tokens FROM lines)"


def _heads(spark, sf_dir):
    """Every line as a heading with an invented level."""
    rows = markdown.lines_of(documents(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", F.col("line_no").alias("ord"), ((F.col("line_no") * 7 + F.col("doc_id")) % 5 + 1).cast("int").alias("level"), T.token_count(F.col("line")).alias("tokens"))


@query(HEADS + " SELECT a.doc_id, a.ord, max(b.ord) AS parent_ord FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.ord < a.ord AND b.level < a.level GROUP BY 1, 2")
def heading_parent(spark, sf_dir):
    return markdown.heading_tree(_heads(spark, sf_dir), ["doc_id"]).select("doc_id", "ord", "parent_ord")


@query(HEADS + " SELECT a.doc_id, a.ord, min(b.ord) AS end_ord FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.ord > a.ord AND b.level <= a.level GROUP BY 1, 2")
def section_end(spark, sf_dir):
    return markdown.heading_tree(_heads(spark, sf_dir), ["doc_id"]).select("doc_id", "ord", "end_ord")


@query(HEADS + ", e AS (SELECT a.doc_id, a.ord, min(b.ord) AS end_ord FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.ord > a.ord AND b.level <= a.level GROUP BY 1, 2)"
       " SELECT e.doc_id, e.ord, CAST(sum(h.tokens) AS BIGINT) AS subtree_tokens FROM e JOIN h ON h.doc_id = e.doc_id AND h.ord >= e.ord AND h.ord < coalesce(e.end_ord, 1000000) GROUP BY 1, 2")
def subtree_tokens(spark, sf_dir):
    tree = markdown.heading_tree(_heads(spark, sf_dir), ["doc_id"])
    return markdown.subtree_sums(tree, ["doc_id"], "tokens").select("doc_id", "ord", "subtree_tokens")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
 p AS (SELECT *, CAST(greatest(1, ceil((len(w) - 200) / 150) + 1) AS INTEGER) AS n_parts FROM w WHERE len(w) > 0), e AS (SELECT *, unnest(range(n_parts)) AS part FROM p)
 SELECT doc_id, CAST(part AS INTEGER) AS part, n_parts, CAST(len(list_slice(w, part * 150 + 1, part * 150 + 200)) AS INTEGER) AS n_tokens, md5(array_to_string(list_slice(w, part * 150 + 1, part * 150 + 200), ' ')) AS content FROM e""")
def token_windows_overlap(spark, sf_dir):
    return markdown.token_windows(documents(spark, sf_dir), ["doc_id"], 200, 50).select("doc_id", "part", "n_parts", "n_tokens", F.md5("content").alias("content"))


def _chunks(spark, sf_dir):
    """Lines as chunks, headed by their first word; a document is a file."""
    rows = markdown.lines_of(documents(spark, sf_dir), ["doc_id", "source"])
    return rows.select("source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"), F.split_part("line", F.lit(" "), F.lit(1)).alias("heading"), F.col("line_no").cast("long").alias("chunk_index"), T.token_count(F.col("line")).alias("token_count"))


@query("WITH " + LINES + ", c AS (SELECT source, 'd' || doc_id AS filename, trim(split_part(line, ' ', 1)) AS top, line_no, " + TOKENS.format("line") + " AS tokens FROM lines),"
       " t AS (SELECT source, filename, top, min(line_no) AS pos FROM c GROUP BY 1, 2, 3), o AS (SELECT source, filename, string_agg(top, ' | ' ORDER BY pos, top) AS o FROM t GROUP BY 1, 2),"
       " s AS (SELECT source, filename, CAST(sum(tokens) AS BIGINT) AS file_tokens, count(*) AS section_count FROM c GROUP BY 1, 2)"
       " SELECT source, filename, file_tokens, section_count, CASE WHEN length(o) > 500 THEN left(o, 497) || '...' ELSE o END AS file_outline FROM s JOIN o USING (source, filename)")
def file_rollup_outline(spark, sf_dir):
    return markdown.outline(_chunks(spark, sf_dir))


H1 = "h AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS host, lower(" + STRIP.format("regexp_extract(html, '<h1[^>]*>([^<]*)', 1)") + ") AS h1 FROM pages)"


def _h1(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select(F.col("page_id").alias("id"), T.url_host(F.col("url")).alias("filename"), F.lit("web").alias("source"), F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1).alias("heading"))


@query("WITH " + H1 + ", w AS (SELECT page_id AS id, host AS filename, split_part(h1, ' ', 1) AS h FROM h), f AS (SELECT h FROM w WHERE h <> '' GROUP BY 1 HAVING count(DISTINCT filename) BETWEEN 2 AND 3)"
       " SELECT a.id AS src, b.id AS dst, a.h AS evidence FROM w a JOIN w b ON a.h = b.h AND a.filename <> b.filename AND a.id < b.id WHERE a.h IN (SELECT h FROM f)")
def heading_name_match(spark, sf_dir):
    first = _h1(spark, sf_dir).withColumn("heading", F.split_part(T.strip(F.col("heading")), F.lit(" "), F.lit(1)))
    return links.heading_edges(first).select("src", "dst", "evidence")


@query("WITH " + H1 + ", w AS (SELECT host, split_part(h1, ' ', 1) AS heading FROM h) SELECT heading, count(DISTINCT host) AS n_files, string_agg(DISTINCT host, ',' ORDER BY host) AS files FROM w WHERE heading <> '' GROUP BY 1 HAVING count(DISTINCT host) >= 3")
def heading_collisions(spark, sf_dir):
    first = _h1(spark, sf_dir).withColumn("heading", F.split_part(T.strip(F.col("heading")), F.lit(" "), F.lit(1)))
    return lint.heading_collisions(first).select("heading", "n_files", F.array_join("files", ",").alias("files"))


SENTENCES = r"s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: " + STRIP.format("x") + "), lambda x: x <> '') AS s FROM documents)"


@query("WITH " + SENTENCES + " SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS sentences FROM s")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.coalesce("text", F.lit("")))
    return documents(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\n")).alias("sentences"))


LINKS = r"""href AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href FROM pages),
 k AS (SELECT DISTINCT page_id, href, lower(regexp_replace(href, '^/+', '')) AS path FROM href WHERE NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:')),
 known AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'web' ELSE 'alt' END AS source, regexp_extract(html, '<a href="/([^"]+)"', 1) AS filename FROM pages WHERE regexp_matches(html, '<a href="/[^"]+"')),
 p1 AS (SELECT lower(filename) AS path, count(*) AS n, min(source || '|' || filename) AS p FROM known GROUP BY 1),
 r AS (SELECT k.page_id, k.href, CASE WHEN n = 1 THEN p END AS p FROM k LEFT JOIN p1 USING (path))"""


def _href(spark, sf_dir):
    p = pages(spark, sf_dir)
    href = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1)).alias("href")).filter("not href rlike '^[A-Za-z][A-Za-z0-9+.-]*:'").distinct()
    known = p.select(F.when(F.col("page_id") % 2 == 0, "web").otherwise("alt").alias("source"), F.regexp_extract("html", '<a href="/([^"]+)"', 1).alias("filename")).filter("filename <> ''").distinct()
    return href.withColumn("target", F.regexp_replace("href", "^/+", "")), known


@query("WITH " + LINKS + " SELECT page_id, href, split_part(p, '|', 1) AS to_source, split_part(p, '|', 2) AS to_filename FROM r WHERE p IS NOT NULL")
def link_resolution(spark, sf_dir):
    return links.resolve(*_href(spark, sf_dir)).filter("to_filename is not null").select("page_id", "href", "to_source", "to_filename")


@query("WITH " + LINKS + " SELECT page_id, href FROM r WHERE p IS NULL")
def broken_links(spark, sf_dir):
    return links.broken(*_href(spark, sf_dir)).select("page_id", "href")


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"


@query("SELECT page_id, " + HOST + " AS host FROM pages")
def url_hosts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.url_host(F.col("url")).alias("host"))


@query("WITH h AS (SELECT page_id, " + HOST + " AS host FROM pages) SELECT page_id, host FROM h WHERE regexp_matches(host, '(^|\\.)(example\\.com|example\\.org|test\\.com)$')")
def placeholder_urls(spark, sf_dir):
    h = pages(spark, sf_dir).select("page_id", T.url_host(F.col("url")).alias("host"))
    return h.filter(T.placeholder_host(F.col("host")) & ~F.col("host").endswith("example.net"))


PATH = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"


@query("WITH p AS (SELECT page_id, regexp_replace(regexp_replace(" + PATH + r", '^(\./|/)+', ''), '/+', '/', 'g') AS rel FROM pages) SELECT page_id, CASE WHEN rel <> '' THEN 'canon:' || rel END AS address FROM p")
def canonical_path(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.canonical(F.lit("canon"), T.url_path(F.col("url"))).alias("address"))


@query("WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'raw/' WHEN 1 THEN 'memory/' WHEN 2 THEN 'raw-notes' ELSE '' END || source || '.md' AS path, CASE WHEN source = 'src1' THEN 'canon' ELSE 'knowledge' END AS source FROM documents)"
       " SELECT doc_id, path, CASE WHEN source = 'canon' THEN 'canon' WHEN starts_with(path, 'raw/') THEN 'raw' WHEN starts_with(path, 'memory/') THEN 'memory' ELSE 'wiki' END AS tier FROM d")
def path_tier(spark, sf_dir):
    head = F.when(F.col("doc_id") % 4 == 0, "raw/").when(F.col("doc_id") % 4 == 1, "memory/").when(F.col("doc_id") % 4 == 2, "raw-notes").otherwise("")
    d = documents(spark, sf_dir).select("doc_id", F.concat(head, "source", F.lit(".md")).alias("path"), F.when(F.col("source") == "src1", "canon").otherwise("knowledge").alias("source"))
    return d.select("doc_id", "path", T.tier(F.col("source"), F.col("path")).alias("tier"))


@query("SELECT n_nationkey, regexp_replace(regexp_replace(lower(n_name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM nation")
def slug(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", T.slug(F.concat("n_name", F.lit(" & Co."))).alias("slug"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower('_' || p_name || '  x'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor FROM part")
def anchor_norm(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.anchor(F.concat(F.lit("_"), "p_name", F.lit("  x"))).alias("anchor"))


@query("WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || p_brand AS q FROM part), n AS (SELECT DISTINCT p_name AS name FROM part),"
       " s AS (SELECT q, name, 1.0 - levenshtein(lower(q), lower(name)) / greatest(length(q), length(name)) AS ratio FROM q, n) SELECT q AS query, name, round(ratio, 6) AS ratio FROM s WHERE ratio >= 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY ratio DESC, name) <= 3")
def fuzzy_suggest(spark, sf_dir):
    """The stated set of brand queries against all part names, by edit distance."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = p.select(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("query")).distinct()
    return fuzzy.suggest_by_edits(asked, p.select(F.col("p_name").alias("name")).distinct(), 0.3, 3).select("query", "name", F.round("ratio", 6).alias("ratio"))


@query(None)
def fuzzy_suggest_blocks(spark, sf_dir):
    """The same queries by matching blocks."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = p.select(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("query")).distinct()
    return fuzzy.suggest(asked, p.select(F.col("p_name").alias("name")).distinct(), 0.45, 3)


SNAP = "stored AS (SELECT source, 'd' || doc_id AS filename, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 5 <> 4 UNION ALL SELECT source, 'old' || doc_id, n_chars FROM documents WHERE doc_id % 7 = 0), disk AS (SELECT source, 'd' || doc_id AS filename, n_chars AS mtime FROM documents)"


def _snapshot(spark, sf_dir):
    """What is on disk, and a stored snapshot in which some files are older, missing or gone."""
    d = documents(spark, sf_dir)
    disk = d.select("source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"), F.col("n_chars").alias("mtime"))
    shifted = d.filter("doc_id % 5 <> 4").select("source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"), (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("mtime"))
    gone = d.filter("doc_id % 7 = 0").select("source", F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("filename"), F.col("n_chars").alias("mtime"))
    return disk, shifted.unionByName(gone)


@query("WITH " + SNAP + " SELECT source, filename, mtime FROM disk d WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = d.source AND s.filename = d.filename AND s.mtime = d.mtime)")
def incremental_skip(spark, sf_dir):
    return index.changed_files(*_snapshot(spark, sf_dir)).select("source", "filename", "mtime")


@query("WITH " + SNAP + " SELECT source, filename FROM stored EXCEPT SELECT source, filename FROM disk")
def orphan_purge(spark, sf_dir):
    disk, stored = _snapshot(spark, sf_dir)
    return index.orphan_rows(stored, disk).select("source", "filename").distinct()


@query("WITH m AS (" + SUMMARY.format(60) + "), p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'prior ' || doc_id ELSE '(no summary)' END AS prior, CASE WHEN toxic = 1 THEN 'fresh ' || doc_id END AS fresh FROM labels)"
       " SELECT m.doc_id, coalesce(fresh, CASE WHEN prior <> summary AND prior <> '(no summary)' THEN prior END, summary) AS summary FROM m LEFT JOIN p USING (doc_id)")
def summary_precedence(spark, sf_dir):
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    prior = lab.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("prior "), F.col("doc_id").cast("string"))).otherwise("(no summary)").alias("prior"), F.when(F.col("toxic") == 1, F.concat(F.lit("fresh "), F.col("doc_id").cast("string"))).alias("fresh"))
    d = documents(spark, sf_dir).select("doc_id", T.summary(F.col("text"), 60).alias("mechanical")).join(prior, "doc_id", "left")
    return d.select("doc_id", index.best_summary(F.col("fresh"), F.col("prior"), F.col("mechanical")).alias("summary"))


FOLDERS = "f AS (SELECT " + HOST + " AS source, regexp_replace(" + PATH + ", '^/+', '') AS filename FROM pages WHERE " + PATH + " <> ''), p AS (SELECT source, filename, string_split(filename, '/') AS s FROM f)"


def _files(spark, sf_dir):
    return pages(spark, sf_dir).select(T.url_host(F.col("url")).alias("source"), F.regexp_replace(T.url_path(F.col("url")), "^/+", "").alias("filename"), T.url_path(F.col("url")).alias("p")).filter("p <> ''").drop("p")


@query("WITH " + FOLDERS + ", a AS (SELECT DISTINCT source, unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS folder FROM p), r AS (SELECT DISTINCT source, '.' AS folder FROM p WHERE len(s) = 1)"
       " SELECT source, folder, CASE WHEN folder LIKE '%/%' THEN regexp_replace(folder, '/[^/]*$', '') END AS parent FROM (SELECT * FROM a UNION SELECT * FROM r)")
def folder_hierarchy(spark, sf_dir):
    return index.folders(_files(spark, sf_dir)).select("source", "folder", "parent")


@query("WITH " + FOLDERS + ", d AS (SELECT DISTINCT source, filename, CASE WHEN len(s) > 1 THEN regexp_replace(filename, '/[^/]*$', '') ELSE '.' END AS folder FROM p),"
       " r AS (SELECT source, folder, filename, row_number() OVER (PARTITION BY source, folder ORDER BY filename) AS n FROM d)"
       " SELECT source, folder, count(*) AS file_count, string_agg(CASE WHEN n <= 20 THEN filename END, ',' ORDER BY filename) AS files FROM r GROUP BY 1, 2")
def folder_rollup(spark, sf_dir):
    return index.folder_rollup(_files(spark, sf_dir)).select("source", "folder", "file_count", F.array_join("files", ",").alias("files"))


@query("WITH t AS (SELECT doc_id, source, text, " + TOKENS.format("text") + " AS tokens, split_part(text, ' ', 1) AS h FROM documents),"
       " c AS (SELECT lower(" + STRIP.format("h") + ") AS h, count(DISTINCT 'd' || doc_id) AS n FROM t WHERE " + STRIP.format("h") + " <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)"
       " SELECT 'oversized' AS finding, count(*) AS n FROM t WHERE tokens > 2000 UNION ALL SELECT 'heading_collision', count(*) FROM c UNION ALL SELECT 'id_href', count(*) FROM t WHERE regexp_matches(text, '\\]\\(#[^)]*\\)')"
       " UNION ALL SELECT 'orphan', count(*) FROM t WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lint_report(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"), F.split_part("text", F.lit(" "), F.lit(1)).alias("heading"), F.col("text").alias("content"))
    touched = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"), F.lit("references").alias("edge_type"), F.lit(1.0).alias("weight"))
    found = lint.findings(d, touched, None)
    kinds = spark.createDataFrame([(k,) for k in ("oversized", "heading_collision", "id_href", "orphan")], "finding string")
    return kinds.join(found.groupBy("finding").agg(F.count("*").alias("n")), "finding", "left").select("finding", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _table(spark, sf_dir):
    """Lines as the chunk table: every line a section of its document, headed by its first word."""
    d = documents(spark, sf_dir).select("source", "doc_id", F.concat(F.when(F.col("doc_id") % 4 == 0, "raw/d").otherwise("d"), F.col("doc_id").cast("string")).alias("filename"), "text")
    rows = markdown.lines_of(d, ["source", "filename"])
    return rows.select("source", "filename", F.col("line_no").cast("long").alias("chunk_index"), F.lit("section").alias("type"), F.split_part("line", F.lit(" "), F.lit(1)).alias("heading"), F.left("line", F.lit(30)).alias("summary"), T.token_count(F.col("line")).alias("token_count"), T.tier(F.col("source"), F.col("filename")).alias("tier"))


TABLE = "WITH " + LINES + ", c AS (SELECT source, CASE WHEN doc_id % 4 = 0 THEN 'raw/d' ELSE 'd' END || doc_id AS filename, line_no AS chunk_index, split_part(line, ' ', 1) AS heading, left(line, 30) AS summary, CAST(" + TOKENS.format("line") + " AS BIGINT) AS token_count, CASE WHEN doc_id % 4 = 0 THEN 'raw' ELSE 'wiki' END AS tier FROM lines) "


@query(TABLE + "SELECT source, filename, CAST(chunk_index AS BIGINT) AS chunk_index, heading, summary, token_count FROM c")
def list_sections(spark, sf_dir):
    return index.list_sections(_table(spark, sf_dir))


@query(TABLE + "SELECT DISTINCT source, filename, tier, CAST(CASE tier WHEN 'wiki' THEN 1 ELSE 3 END AS INTEGER) AS rank FROM c")
def indexed_files(spark, sf_dir):
    return index.indexed_files(_table(spark, sf_dir))


@query(TABLE + ", s AS (SELECT source, filename, heading, arg_max(summary, chunk_index) AS summary FROM c WHERE summary <> '' GROUP BY 1, 2, 3) SELECT * FROM s")
def heading_summaries(spark, sf_dir):
    found = index.heading_summaries(_table(spark, sf_dir))
    return found.select("source", "filename", F.explode("summaries").alias("heading", "summary"))


@query("WITH f AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'knowledge' ELSE 'canon' END AS source, 'p' || doc_id % 300 || '/d' || doc_id // 3 || '.md' AS filename FROM documents), q AS (SELECT DISTINCT 'd' || doc_id // 3 AS name FROM documents),"
       " m AS (SELECT q.name, f.source, f.filename FROM q JOIN f ON split_part(f.filename, '/', 2) = q.name || '.md'), n AS (SELECT name, count(*) AS n, min(source) AS source, min(filename) AS filename FROM m GROUP BY 1)"
       " SELECT name, CASE WHEN n = 1 THEN source END AS source, CASE WHEN n = 1 THEN filename END AS filename, CAST(n AS BIGINT) AS n_candidates FROM n")
def resolve_files(spark, sf_dir):
    """Every base name as a query; names that several files have stay unresolved."""
    from lorewell.operators import resolve

    d = documents(spark, sf_dir)
    base = F.concat(F.lit("d"), F.expr("doc_id div 3").cast("string"))
    files = d.select(F.when(F.col("doc_id") % 2 == 0, "knowledge").otherwise("canon").alias("source"), F.concat(F.lit("p"), (F.col("doc_id") % 300).cast("string"), F.lit("/"), base, F.lit(".md")).alias("filename")).distinct()
    return resolve.resolve_files(d.select(base.alias("name")).distinct(), files).select("name", "source", "filename", "n_candidates")
