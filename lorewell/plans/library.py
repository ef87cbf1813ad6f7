"""Queries that run the library's text, page, policy and graph operators over the tables, each with SQL for the same rows.

Where an operator reads markup that the tables don't hold, the query writes it around the rows' own values, and the SQL
says from these values what must be found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.functions import tokens as K
from lorewell.operators import conversations as C
from lorewell.operators import graph as G
from lorewell.operators import index, links, lint, markdown
from lorewell.operators import pages as P
from lorewell.operators import policy, resolve
from lorewell.operators import vector_search as V
from lorewell.streaming import changes as ST

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def num(e) -> F.Column:
    return F.expr(e).cast("string")


# --- links and mentions ---


@query(r"""WITH t AS (SELECT doc_id, 'ä `[[no]]` ' AS a, '[[d' || doc_id || '#Sec ' || doc_id % 7 || '|shown ' || doc_id || ']]' AS w, '[x y](./d' || doc_id // 2 || '.md#top)' AS m, '[[D' || doc_id % 9 || ']]' AS z FROM documents)
 SELECT doc_id, CAST(length(a) AS INTEGER) AS start, 'wiki' AS kind, 'd' || doc_id || '.md' AS target, 'Sec ' || doc_id % 7 AS anchor, 'shown ' || doc_id AS display FROM t
 UNION ALL SELECT doc_id, CAST(length(a) + length(w) + 13 AS INTEGER), 'markdown', 'd' || doc_id // 2 || '.md', 'top', 'x y' FROM t
 UNION ALL SELECT doc_id, CAST(length(a) + length(w) + 13 + length(m) + 22 AS INTEGER), 'wiki', 'D' || doc_id % 9 || '.md', '', 'D' || doc_id % 9 FROM t
 UNION ALL SELECT doc_id, CAST(length(a) + length(w) + 13 + length(m) + 22 + length(z) + 1 AS INTEGER), 'wiki', 'D' || doc_id % 9 || '.md', '', 'D' || doc_id % 9 FROM t""")
def link_parse(spark, sf_dir):
    """Links in text with code, an image, an external link, and one link twice."""
    d = read(spark, sf_dir, "documents")
    z = text("[[D", num("doc_id % 9"), "]]")
    made = text("ä `[[no]]` ", "[[d", F.col("doc_id"), "#Sec ", num("doc_id % 7"), "|shown ", F.col("doc_id"), "]]", " ![[a]] b, c ", "[x y](./d", num("doc_id div 2"), ".md#top)", " [out](https://a.b/c) ", z, " ", z)
    return links.parse_links(d.select("doc_id", made.alias("text")), ["doc_id"]).select("doc_id", "start", "kind", "target", "anchor", "display")


PAIR = "c AS (SELECT doc_id * 2 + k AS id, doc_id, k FROM documents, (SELECT unnest([0, 1]) AS k))"


def _pairs(spark, sf_dir):
    """Every document as a file of two chunks, the first of which links to the next two documents."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    content = F.when(F.col("k") == 0, text("see [[p", num("doc_id + 1"), "#part-b|go]] and [", "there](p", num("doc_id + 2"), ".md) or [[p", F.col("doc_id"), "]]")).otherwise("```\n[[p1]]\n```")
    return d.select((F.col("doc_id") * 2 + F.col("k")).alias("id"), F.lit("knowledge").alias("source"), text("p", F.col("doc_id"), ".md").alias("filename"), F.when(F.col("k") == 0, "Intro").otherwise("Intro > Part B").alias("heading"), F.col("k").cast("long").alias("chunk_index"), content.alias("content"))


@query("WITH " + PAIR + """ SELECT a.id AS src, b.id AS dst, CAST(1.0 AS DOUBLE) AS weight, 'go' AS link_text, 'wiki' AS link_kind, 'p' || b.doc_id || '.md' AS target_file, 'part-b' AS target_anchor FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND b.k = 1 WHERE a.k = 0
 UNION ALL SELECT a.id, b.id, 1.0, 'there', 'markdown', 'p' || b.doc_id || '.md', '' FROM c a JOIN c b ON b.doc_id = a.doc_id + 2 AND b.k = 0 WHERE a.k = 0""")
def link_edges(spark, sf_dir):
    c = _pairs(spark, sf_dir)
    out = links.link_edges(c, c.select("source", "filename").distinct())
    return out.select("src", "dst", F.col("weight").cast("double").alias("weight"), "link_text", "link_kind", "target_file", "target_anchor")


@query("WITH " + PAIR + " SELECT a.id AS src, b.id AS dst, 'parent_child' AS edge_type FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.k = 0 AND b.k = 1")
def hierarchy_edges(spark, sf_dir):
    return links.hierarchy_edges(_pairs(spark, sf_dir)).select("src", "dst", "edge_type")


NAMES = "SELECT DISTINCT lower(unnest(regexp_extract_all(html, '<a href=\"/([A-Za-z]{3,})\"', 1))) AS alias FROM pages"
WORDS_OF = r"""v AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS v FROM documents),
 e AS (SELECT doc_id, unnest(v) AS sentence, generate_subscripts(v, 1) AS no FROM v),
 w AS (SELECT doc_id, no, regexp_extract_all(lower(regexp_replace(sentence, '[-_]', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM e)"""


def page_names(spark, sf_dir):
    """What the pages' own links name, of three letters and more, as pages."""
    p = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="/([A-Za-z]{3,})"'), 1)).alias("n"))
    names = p.select(F.lower("n").alias("n")).distinct()
    return links.page_aliases(names.select(F.lit("knowledge").alias("source"), F.concat(F.lit("wiki/"), "n", F.lit(".md")).alias("filename")))


@query("WITH " + WORDS_OF + ", a AS (" + NAMES + "), x AS (SELECT doc_id, unnest(w) AS alias FROM w) SELECT doc_id, alias, count(*) AS n FROM x JOIN a USING (alias) GROUP BY 1, 2")
def page_mentions(spark, sf_dir):
    """How often each document names each page that the pages' links name."""
    found = links.mentions(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), ["doc_id"], page_names(spark, sf_dir))
    return found.groupBy("doc_id", "alias").agg(F.count("*").alias("n"))


@query("WITH " + WORDS_OF + ", a AS (" + NAMES + """), x AS (SELECT doc_id, no, w, unnest(w) AS alias, generate_subscripts(w, 1) AS at FROM w), m AS (SELECT x.* FROM x JOIN a USING (alias)),
 n AS (SELECT doc_id, no, list_distinct(list(alias)) AS named FROM m GROUP BY 1, 2),
 p AS (SELECT f.doc_id, f.alias AS s, g.alias AS o FROM m f JOIN m g ON f.doc_id = g.doc_id AND f.no = g.no AND f.at < g.at AND f.alias <> g.alias JOIN n ON n.doc_id = f.doc_id AND n.no = f.no
   WHERE len(list_filter(list_slice(f.w, f.at + 1, g.at - 1), lambda t: regexp_full_match(t, '[a-z]{3,}') AND t NOT IN ('and', 'or', 'the', 'with', 'for', 'from', 'into', 'onto') AND NOT list_contains(named, t))) > 0)
 SELECT DISTINCT doc_id, 'wiki/' || s || '.md' AS subject_file, 'wiki/' || o || '.md' AS object_file FROM p""")
def page_bridges(spark, sf_dir):
    """Pages that a document brings together in a sentence."""
    found = links.bridged(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), ["doc_id"], page_names(spark, sf_dir))
    return found.select("doc_id", "subject_file", "object_file")


PHRASES = r"""b AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '[-_]', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM benchmark),
 a AS (SELECT array_to_string(w[1:k], ' ') AS alias, min('wiki/b' || item_id || '.md') AS filename FROM b, (SELECT unnest([2, 3, 5]) AS k) WHERE len(w) >= k GROUP BY 1)"""


def phrase_names(spark, sf_dir):
    """The first two, three and five words of each benchmark item as names of its page."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace("text", "[-_]", " ")), F.lit(r"[\p{L}\p{N}]+"), 0)
    b = read(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))).alias("k")).filter(F.size("w") >= F.col("k"))
    return b.groupBy(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("alias")).agg(F.min(text("wiki/b", F.col("item_id"), ".md")).alias("filename")).withColumn("source", F.lit("knowledge"))


@query("WITH " + WORDS_OF + ", " + PHRASES + """, k AS (SELECT unnest([2, 3, 5]) AS k), x AS (SELECT doc_id, no, pos, pos + k - 1 AS until, array_to_string(w[pos:pos + k - 1], ' ') AS alias FROM (SELECT doc_id, no, w, unnest(range(1, len(w) + 1)) AS pos FROM w), k WHERE pos + k - 1 <= len(w)),
 m AS (SELECT x.*, filename FROM x JOIN a USING (alias)), f AS (SELECT *, max(until) OVER (PARTITION BY doc_id, no ORDER BY pos, until DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM m)
 SELECT doc_id, alias, filename, count(*) AS n FROM f WHERE far IS NULL OR pos > far GROUP BY 1, 2, 3""")
def phrase_mentions(spark, sf_dir):
    """Names of two, three and five words in documents; those within a longer one do not count."""
    found = links.mentions(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), ["doc_id"], phrase_names(spark, sf_dir))
    return found.groupBy("doc_id", "alias", "filename").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'p' || p_partkey || '.md' WHEN 1 THEN '' WHEN 2 THEN 'a/p' || p_partkey || '.md' WHEN 3 THEN '' WHEN 4 THEN 'x.MD' ELSE 'canon:p' || p_partkey || '.md' END AS target FROM part")
def link_targets(spark, sf_dir):
    k = F.col("p_partkey")
    given = F.when(k % 6 == 0, text("./p", k, "#top")).when(k % 6 == 1, text("https://a.b/", k)).when(k % 6 == 2, text(" //a/p", k, ".md ")).when(k % 6 == 3, text("#s", k)).when(k % 6 == 4, F.lit("x.MD")).otherwise(text("canon:p", k))
    return read(spark, sf_dir, "part").select("p_partkey", T.link_target(given).alias("target"))


# --- markdown ---


HEADED = "'# Title ' || doc_id || chr(10) || 'about' || chr(10) || '## Part ' || doc_id % 3 || chr(10) || 'a ' || left(replace(coalesce(text, ''), chr(10), ' '), 40) || chr(10) || '### Deep' || chr(10) || 'b' || chr(10) || '## Last' || chr(10) || 'c'"


def _headed(spark, sf_dir):
    flat = F.left(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(40))
    body = text("# Title ", F.col("doc_id"), "\nabout\n## Part ", num("doc_id % 3"), "\na ", flat, "\n### Deep\nb\n## Last\nc")
    return read(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


@query("WITH t AS (SELECT doc_id, " + HEADED + " AS t, strpos(" + HEADED + ", '## Part') AS a, strpos(" + HEADED + ", '## Last') AS z FROM documents) SELECT doc_id, 'Part ' || doc_id % 3 AS heading, md5(substr(t, a, z - a - 1)) AS section FROM t")
def section_by_name(spark, sf_dir):
    """The part of each text under a heading, with what is nested in it."""
    return markdown.section_text(_headed(spark, sf_dir), ["doc_id"], "PART").select("doc_id", "heading", F.md5("section").alias("section"))


@query("WITH t AS (SELECT doc_id, " + HEADED + " AS t, strpos(" + HEADED + ", '### Deep') AS a, strpos(" + HEADED + ", '## Last') AS z FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'X > Deeper' ELSE 'Deep' END AS heading, md5(CASE WHEN doc_id % 2 = 0 THEN 'chunk ' || doc_id ELSE substr(t, a, z - a - 1) END) AS section FROM t")
def section_by_chunk_or_text(spark, sf_dir):
    """A section by the headings of chunks first, then by those of the text."""
    docs = _headed(spark, sf_dir)
    chunks = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("X > Deeper").alias("heading"), text("chunk ", F.col("doc_id")).alias("content"), F.lit(0).alias("chunk_index"))
    return markdown.find_section(chunks, docs, ["doc_id"], "deep").select("doc_id", "heading", F.md5("section").alias("section"))


LINE_TOKENS = "greatest(1, length({0}) // 4)"


@query("WITH t AS (SELECT doc_id, 'a ' || left(replace(coalesce(text, ''), chr(10), ' '), 40) AS body FROM documents), n AS (SELECT doc_id, CAST(" + LINE_TOKENS.format("body") + " AS BIGINT) AS n FROM t)"
       " SELECT doc_id, '# Title ' || doc_id || ' (' || (1 + n + 1 + 1) || ' tokens)' AS line FROM n UNION ALL SELECT doc_id, '  ## Part ' || doc_id % 3 || ' (' || (n + 1) || ' tokens)' FROM n UNION ALL SELECT doc_id, '    ### Deep (1 tokens)' FROM n UNION ALL SELECT doc_id, '  ## Last (1 tokens)' FROM n")
def heading_lines(spark, sf_dir):
    """The heading tree of each text as lines, with the tokens below each heading."""
    return resolve.heading_lines(_headed(spark, sf_dir), ["doc_id"]).select("doc_id", "line")


@query("SELECT doc_id, 'Part ' || doc_id % 3 AS title, 'about ' || doc_id AS summary FROM documents UNION ALL SELECT doc_id, 'Title ' || doc_id, NULL FROM documents UNION ALL SELECT doc_id, 'Deep', NULL FROM documents UNION ALL SELECT doc_id, 'Last', NULL FROM documents")
def tree_summaries(spark, sf_dir):
    """Headings with the index's summaries, ignoring case."""
    docs = _headed(spark, sf_dir)
    heads = markdown.markdown_lines(docs, ["doc_id"]).filter("level is not null")
    known = docs.select("doc_id", text("PART ", num("doc_id % 3")).alias("heading"), text("about ", F.col("doc_id")).alias("summary"))
    return markdown.with_summaries(heads, known, ["doc_id"]).select("doc_id", "title", "summary")


@query("""SELECT doc_id, concat_ws(chr(10), '---', 'file: d' || doc_id || '.md', 'position: ' || (doc_id % 5 + 1) || '/5', CASE doc_id % 3 WHEN 1 THEN 'ancestors: A' WHEN 2 THEN 'ancestors: A > B' END, CASE WHEN doc_id % 2 = 0 THEN 'doc_summary: ' || source END, '---') AS header FROM documents""")
def context_headers(spark, sf_dir):
    k = F.col("doc_id")
    heading = F.when(k % 3 == 0, "A").when(k % 3 == 1, "A > B").otherwise("A > B > C")
    about = F.when(k % 2 == 0, F.col("source")).otherwise("(no summary)")
    return read(spark, sf_dir, "documents").select("doc_id", markdown.context_header(text("d", k, ".md"), k % 5, F.lit(5), heading, about).alias("header"))


@query("WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Plain ' || doc_id WHEN 1 THEN 'Head ' || doc_id || ' \\nbody\\tx' ELSE '\\tonly' END AS h FROM documents) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Plain ' || doc_id WHEN 1 THEN 'Head ' || doc_id ELSE '(unknown)' END AS heading, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'body    x' ELSE 'only' END AS body FROM t")
def heading_repairs(spark, sf_dir):
    k = F.col("doc_id")
    h = F.when(k % 3 == 0, text("Plain ", k)).when(k % 3 == 1, text("Head ", k, " \\nbody\\tx")).otherwise(F.lit("\\tonly"))
    return read(spark, sf_dir, "documents").select("doc_id", T.heading_repair(h).alias("r")).select("doc_id", "r.heading", "r.body")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN '' END AS owner FROM documents")
def front_matter_values(spark, sf_dir):
    """One value of the front matter; null where there is neither."""
    k = F.col("doc_id")
    made = F.when(k % 3 == 0, text("---\ntitle: x\nowner:  ", F.col("source"), " \n---\nowner: no")).when(k % 3 == 1, F.lit("---\nowner:\n---\nx")).otherwise(F.lit("---\ntitle: x\n---\nowner: no"))
    return read(spark, sf_dir, "documents").select("doc_id", T.front_matter_value(made, "owner").alias("owner"))


@query("SELECT doc_id, 'A: ' || source || '|b' AS tags, 'x, y' AS quoted, 'Body ' || doc_id AS body FROM documents")
def front_matter_lists(spark, sf_dir):
    """Lists and quoted values of YAML front matter."""
    made = text('---\ntags:\n  - "A: ', F.col("source"), '"\n  - b\nquoted: ["x, y"]\nempty:\n---\n\nBody ', F.col("doc_id"))
    f = read(spark, sf_dir, "documents").select("doc_id", P.front_matter_of(made).alias("f"))
    return f.select("doc_id", F.array_join("f.meta.tags", "|").alias("tags"), F.array_join("f.meta.quoted", "|").alias("quoted"), "f.body")


@query("WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE greatest(1, length(t) // 4) END AS BIGINT) AS n, CAST(floor(1.5 * CASE WHEN t = '' THEN 0 ELSE greatest(1, length(t) // 4) END) AS BIGINT) AS estimate,"
       " md5(CASE WHEN length(t) // 4 <= 50 THEN t ELSE left(t, 200) END) AS head, length(t) // 4 > 50 AS truncated, md5(CASE WHEN greatest(1, length(t) // 4) <= 10 THEN '' WHEN length(t) // 4 <= 30 THEN substr(t, 41) ELSE substr(t, 41, 80) END) AS part, length(t) // 4 > 30 AS more FROM t")
def token_cuts(spark, sf_dir):
    """Counts, heads and slices by tokens of the default encoder."""
    t = F.coalesce("text", F.lit(""))
    cut, part = K.truncate_to_tokens(t, 50), K.slice_tokens(t, 10, 20)
    d = read(spark, sf_dir, "documents").select("doc_id", K.count_tokens(t).alias("n"), K.estimate_tokens(t).alias("estimate"), cut.alias("c"), part.alias("p"))
    return d.select("doc_id", "n", "estimate", F.md5("c.content").alias("head"), "c.truncated", F.md5("p.content").alias("part"), "p.more")


@query("WITH t AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS n FROM documents) SELECT doc_id, md5(CASE WHEN n <= 10 THEN '' WHEN n <= 30 THEN substr(t, 41) ELSE substr(t, 41, 80) END) AS content, CASE WHEN n <= 30 THEN 'COMPLETE' ELSE 'TRUNCATED' END AS state, CAST(CASE WHEN n > 30 THEN 30 END AS INTEGER) AS next_offset FROM t")
def section_slices(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("section"))
    return resolve.load_slice(d, 10, 20).select("doc_id", F.md5("content").alias("content"), "state", "next_offset")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'It is ' || source || '.' WHEN 1 THEN 'Kept ' || doc_id WHEN 2 THEN 'two. three. four.' ELSE 'b' END AS summary FROM documents")
def summary_cleaning(spark, sf_dir):
    k = F.col("doc_id")
    given = F.when(k % 4 == 0, text("<think>no<think> **Plan:**\nIt is ", F.col("source"), ".")).when(k % 4 == 1, text("<|start|>1. first\nKept ", k)).when(k % 4 == 2, F.lit("1. one. two. three. four.")).otherwise(F.lit("Plan\nb"))
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_summary(given).alias("summary"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS of_file, 'one-two-' || p_partkey || '-four--five-six' AS of_talk, CASE WHEN p_partkey % 2 = 0 THEN 'thread-c' || left(CAST(p_partkey AS VARCHAR) || 'abcdefgh', 7) ELSE 'x' END AS of_thread FROM part")
def slug_suggestions(spark, sf_dir):
    k = F.col("p_partkey")
    talk = text("One  two\n", k, " four! five six seven")
    return read(spark, sf_dir, "part").select("p_partkey", T.slug_of_file(text("a/", F.col("p_name"), ".md")).alias("of_file"), T.slug_of_talk(talk, F.lit("c")).alias("of_talk"), T.slug_of_talk(F.when(k % 2 == 0, "!!").otherwise("X"), text("c", k, "abcdefgh")).alias("of_thread"))


@query(r"WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS b FROM documents) SELECT doc_id, md5(trim('my d ' || doc_id || ' ' || left('. ' || b, 250))) AS query FROM t")
def compile_queries(spark, sf_dir):
    """What is searched for when a document is compiled."""
    body = text("---\ntitle: x\n---\n# Heading of it. ", F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.query_of_file(text("w/my-d_", F.col("doc_id"), ".md"), body)).alias("query"))


@query(r"""WITH t AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS b, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) // 4 AS k FROM documents WHERE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> ''),
 p AS (SELECT *, CASE WHEN greatest(1, k) <= 400 THEN 1 ELSE CAST(ceil((k - 400) / 350.0) AS INTEGER) + 1 END AS n FROM t), e AS (SELECT *, unnest(range(n)) AS i FROM p),
 c AS (SELECT *, CASE WHEN n = 1 THEN b WHEN i = n - 1 THEN substr(b, i * 1400 + 1) ELSE substr(b, i * 1400 + 1, 1600) END AS content FROM e)
 SELECT source, 'd' || doc_id || '.md' AS filename, 'd' || doc_id AS heading, CAST(i AS BIGINT) AS chunk_index, CAST(greatest(1, length(content) // 4) AS BIGINT) AS token_count, CAST(n AS BIGINT) AS total_chunks, md5(content) AS content FROM c""")
def chunked_documents(spark, sf_dir):
    """Documents through the chunker; those above the limit are split into overlapping parts."""
    d = read(spark, sf_dir, "documents").select("source", text("d", F.col("doc_id"), ".md").alias("filename"), "text")
    return markdown.chunk_files(d, 400).select("source", "filename", "heading", "chunk_index", "token_count", "total_chunks", F.md5("content").alias("content"))


# --- pages ---


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'wiki/p' || p_partkey || '.md' WHEN 1 THEN 'memory/m.md' END AS path, CASE p_partkey % 5 WHEN 2 THEN 'path climbs out' WHEN 3 THEN 'raw is read-only' WHEN 4 THEN 'canon is read-only' END AS error FROM part")
def wiki_paths(spark, sf_dir):
    k = F.col("p_partkey")
    given = F.when(k % 5 == 0, text(" p", k)).when(k % 5 == 1, F.lit("knowledge/memory/m.md")).when(k % 5 == 2, F.lit("wiki/../x")).when(k % 5 == 3, F.lit("raw/x")).otherwise(F.lit("canon\\x"))
    return read(spark, sf_dir, "part").select("p_partkey", T.wiki_path(given).alias("w")).select("p_partkey", "w.path", "w.error")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def iso_days(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select("o_orderkey", T.iso_date(F.when(k % 3 == 0, F.concat(d, F.lit("T10:00:00Z"))).when(k % 3 == 1, d).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))).alias("day"))


@query("SELECT doc_id, md5(CASE WHEN length(t) - length(replace(t, chr(10), '')) < 2 THEN replace(replace(replace(t, '\\n', chr(10)), '\\t', chr(9)), '\\\"', '\"') ELSE t END) AS decoded FROM (SELECT doc_id, coalesce(text, '') || '\\n\\t\\\"x\\\"' AS t FROM documents)")
def decoded_escapes(spark, sf_dir):
    t = F.concat(F.coalesce("text", F.lit("")), F.lit('\\n\\t\\"x\\"'))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.decode_escapes(t)).alias("decoded"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) || '|' || p_type || '+' AS tags, CASE WHEN p_partkey % 4 = 0 THEN 'bad tag: [x]' END AS error FROM part")
def page_tags(spark, sf_dir):
    """Tags from comma lists, each once whatever its case."""
    first, kind = F.split_part("p_name", F.lit(" "), F.lit(1)), text(F.col("p_type"), "+")
    given = F.array(text(first, ", ", kind, ","), F.upper(first))
    bad = F.when(F.col("p_partkey") % 4 == 0, F.array(first, F.lit("[x]"))).otherwise(given)
    out = read(spark, sf_dir, "part").select("p_partkey", P.clean_tags(given).alias("t"), P.tag_error(bad).alias("error"))
    return out.select("p_partkey", F.array_join("t", "|").alias("tags"), "error")


@query("SELECT p_partkey, 'https://www.example.com/' || p_partkey AS url FROM part UNION ALL SELECT p_partkey, 'http://my-placeholder-' || p_partkey || '.io/a' FROM part")
def bad_urls(spark, sf_dir):
    k = F.col("p_partkey")
    made = text("See https://www.example.com/", k, "). and (http://my-placeholder-", k, ".io/a) or https://en.wikipedia.org/example.com; https://www.example.com/", k, "!")
    return P.bad_urls(read(spark, sf_dir, "part").select("p_partkey", made.alias("content")), "p_partkey")


@query("SELECT doc_id, 'c' || doc_id AS conv_id, CAST(doc_id % 4 AS BIGINT) AS first, CAST(doc_id % 4 + 2 AS BIGINT) AS last FROM documents UNION ALL SELECT doc_id, 'd', 7, 7 FROM documents")
def page_citations(spark, sf_dir):
    """What the sources section of a page cites, and nothing outside of it."""
    k = F.col("doc_id")
    made = text("conversation:no:turn:1\n## Sources\n- conversation:c", k, ":turn:", num("doc_id % 4"), "-", num("doc_id % 4 + 2"), "\n- conversation:d:turn:7\n## More\nconversation:no:turn:2")
    return P.citations(read(spark, sf_dir, "documents").select("doc_id", made.alias("content")), "doc_id")


@query("""SELECT doc_id, concat_ws(chr(10), '---', 'aliases:' || chr(10) || '  - "d ' || doc_id || '"', 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - "a: b"', 'created: ' || CASE WHEN doc_id % 2 = 0 THEN '2020-01-02' ELSE '2024-05-06' END, 'updated: 2024-05-06', 'source: knowledge', 'tier: ' || CASE WHEN doc_id % 2 = 0 THEN 'memory' ELSE 'wiki' END, CASE WHEN doc_id % 2 = 0 THEN 'project: ' || source END, '---') AS front FROM documents""")
def merged_front_matter(spark, sf_dir):
    """Front matter that keeps what a page already has."""
    k, even = F.col("doc_id"), F.col("doc_id") % 2 == 0
    old = {"created": F.when(even, "2020-01-02T09:00:00"), "tags": F.array(F.upper("lang"), F.lit("a: b")), "tier": F.when(even, "memory").otherwise(""), "project": F.when(even, F.col("source"))}
    return read(spark, sf_dir, "documents").select("doc_id", P.merged_front(F.lit("2024-05-06"), F.array("lang"), F.array(text("d ", k)), old).alias("front"))


@query("""SELECT doc_id, '---' || chr(10) || 'x: 1' || chr(10) || '---' || chr(10) || chr(10) || '# T ' || doc_id || chr(10) || chr(10) || '- [One](#one)' || chr(10) || '- [Two ' || doc_id || '](#two-' || doc_id || ')' || chr(10) || chr(10) || '## One' || chr(10) || 'a' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Two ' || doc_id || chr(10) || 'b' || chr(10) || chr(10) || '<!-- related:begin -->' || chr(10) || '- [[z' || doc_id || ']]' || chr(10) || '<!-- related:end -->' AS page FROM documents""")
def assembled_pages(spark, sf_dir):
    """Pages put together from front matter, title, contents, ruled sections and a related block that replaces an old one."""
    k = F.col("doc_id")
    body = text("## One\na\n\n## Two ", k, "\nb\n\n<!-- related:begin -->\nold\n<!-- related:end -->")
    page = P.assemble(F.lit("---\nx: 1\n---"), text("T ", k), body)
    return read(spark, sf_dir, "documents").select("doc_id", P.with_related(page, text("- [[z", k, "]]")).alias("page"))


@query("SELECT doc_id, '[[wiki/a' || doc_id || '#b|x]] ![i](wiki/i.md) [o](https://a.b/wiki/c.md) [c](../../canon/d.md)' AS body, '../../../canon/law/' || doc_id || '.md' AS href FROM documents")
def rewritten_links(spark, sf_dir):
    k = F.col("doc_id")
    body = text("[x](./wiki/a", k, ".md#b) ![i](wiki/i.md) [o](https://a.b/wiki/c.md) [c](../../canon/d.md)")
    return read(spark, sf_dir, "documents").select("doc_id", P.wiki_links(body).alias("body"), P.canon_href(F.lit("wiki/sub/p.md"), text("law/", k, ".md")).alias("href"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS rank, '- [' || upper(left(n_name, 1)) || lower(substr(n_name, 2)) || '](../../canon/' || n_name || '.md#part-' || n_nationkey || ')' AS line FROM nation WHERE n_name NOT LIKE '% %' QUALIFY rank <= 5")
def citation_lines(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_name not like '% %'")
    hits = n.select(F.expr("cast(row_number() over (order by n_nationkey) as int)").alias("rank"), F.concat("n_name", F.lit(".md")).alias("filename"), text("A > Part_", F.col("n_nationkey")).alias("heading"))
    return P.citation_lines(hits, "wiki/p.md")


@query("WITH c AS (SELECT DISTINCT lower(p_brand) || '.md' AS b FROM part WHERE p_partkey % 3 = 0), w AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand AS filename, CASE WHEN b IS NULL THEN 'wiki/' || p_brand || '.md' END AS path, CASE WHEN b IS NOT NULL THEN 'canon has a page of this name' END AS error FROM w LEFT JOIN c ON b = lower(p_brand) || '.md'")
def planned_writes(spark, sf_dir):
    """Pages to be written, refused where canon has the name."""
    p = read(spark, sf_dir, "part")
    canon = p.filter("p_partkey % 3 = 0").select(text("law/", F.col("p_brand"), ".md").alias("filename")).distinct()
    pages = p.select(F.col("p_brand").alias("filename"), F.lit("x").alias("content"), F.array(F.lit("t")).alias("tags")).distinct()
    return P.plan_writes(pages, canon).select("filename", "path", "error")


@query("WITH t AS (SELECT doc_id, 'One ' || doc_id || ' is here. Two is there. ' || repeat('x', 60) AS t FROM documents) SELECT doc_id, 'One ' || doc_id || ' is here. Two is there.' AS content, 'TRUNCATED' AS state FROM t WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'One ' || doc_id, 'COMPLETE' FROM t WHERE doc_id % 2 = 1")
def section_loads(spark, sf_dir):
    """Sections for reading, cut where a sentence ends."""
    k = F.col("doc_id")
    made = F.when(k % 2 == 0, text("One ", k, " is here. Two is there. ", F.repeat(F.lit("x"), F.lit(60)))).otherwise(text("One ", k))
    return read(spark, sf_dir, "documents").select("doc_id", P.section_load(made, 60).alias("s")).select("doc_id", "s.content", "s.state")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'via ''L' || o_orderkey || ''' [wiki] #top' WHEN 1 THEN 'rank 1/' || o_custkey % 9 WHEN 2 THEN left('e' || repeat('v', 200), 140) ELSE 'via ''x'' [prose]: because' END AS provenance FROM orders")
def edge_provenance(spark, sf_dir):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    of = lambda i, x, kind="string": F.when(k % 4 == i, x).otherwise(F.lit(None).cast(kind))
    link_text = F.when(k % 4 == 0, text("L", k)).when(k % 4 == 3, "x").otherwise(none)
    e = read(spark, sf_dir, "orders").select("o_orderkey", link_text.alias("link_text"), F.when(k % 4 == 0, "wiki").when(k % 4 == 3, "prose").alias("link_kind"), of(0, F.lit("top")).alias("target_anchor"), of(1, F.lit(1), "int").alias("intra_rank"), of(1, (F.col("o_custkey") % 9).cast("int"), "int").alias("intra_total"), F.when(k % 4 == 2, F.concat(F.lit("e"), F.repeat(F.lit("v"), F.lit(200)))).when(k % 4 == 3, "because").alias("evidence"))
    return P.edge_lines(e).select("o_orderkey", "provenance")


# --- index ---


FILES = "f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'canon' ELSE 'knowledge' END AS source, CASE WHEN doc_id % 3 = 0 THEN 'raw/s/' WHEN doc_id % 3 = 1 THEN 'wiki/' ELSE '' END || 'd' || doc_id || '.md' AS filename, doc_id, text FROM documents)"


def _files(spark, sf_dir):
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, "raw/s/").when(k % 3 == 1, "wiki/").otherwise("")
    return read(spark, sf_dir, "documents").select(F.when(k % 2 == 0, "canon").otherwise("knowledge").alias("source"), text(folder, "d", k, ".md").alias("filename"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1_700_000_000).cast("long").alias("mtime"))


@query("WITH " + FILES + """, t AS (SELECT DISTINCT source, CASE WHEN filename LIKE 'raw/%' THEN 'raw/s' WHEN filename LIKE 'wiki/%' THEN 'wiki' ELSE '.' END AS folder FROM f), a AS (SELECT * FROM t UNION SELECT source, 'raw' FROM t WHERE folder = 'raw/s')
 SELECT 'chunk' AS kind, count(*) AS n FROM f UNION ALL SELECT 'folder', count(*) FROM a UNION ALL SELECT 'edge', (SELECT count(*) FROM f) + (SELECT count(*) FROM a WHERE folder = 'raw/s')""")
def structure_counts(spark, sf_dir):
    """Nodes and edges of files in folders."""
    f = _files(spark, sf_dir)
    chunks = f.select(text("c", F.col("doc_id")).alias("id"), "source", "filename", F.lit("H").alias("heading"), index.folder_of(F.col("filename")).alias("folder"), T.tier(F.col("source"), F.col("filename")).alias("tier"))
    nodes, edges = index.structure_nodes(chunks, f)
    return nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


@query("WITH " + FILES + " SELECT source, filename, left('S' || repeat('s', 150) || doc_id, 120) AS summary, '2023-11-14' AS modified, CASE WHEN source = 'canon' THEN 'canon' WHEN filename LIKE 'raw/%' THEN 'raw' ELSE 'wiki' END AS tier FROM f")
def file_catalog(spark, sf_dir):
    f = _files(spark, sf_dir)
    first = f.select("source", "filename", F.lit(0).alias("chunk_index"), text("S", F.repeat(F.lit("s"), F.lit(150)), F.col("doc_id")).alias("summary"), "mtime", T.tier(F.col("source"), F.col("filename")).alias("tier"))
    later = first.withColumns({"chunk_index": F.lit(1), "summary": F.lit("no")})
    log = first.withColumn("filename", F.lit("wiki/log.md"))
    return index.catalog(first.unionByName(later).unionByName(log))


@query("WITH " + FILES + " SELECT 'd' || doc_id || '.md' AS name, filename AS path, CASE WHEN filename LIKE 'raw/%' THEN 'raw/s' WHEN filename LIKE 'wiki/%' THEN 'wiki' ELSE '.' END AS folder, CASE WHEN doc_id % 5 = 0 THEN 'u' || doc_id END AS last_modified_by FROM f WHERE source = 'canon'")
def file_listing(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 5 == 0, text("---\nlast_modified_by: u", F.col("doc_id"), "\n---\n")).otherwise("x"))
    return index.file_list(f, "canon")


@query("WITH " + FILES + " SELECT source, filename, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM f WHERE NOT (doc_id % 4 = 0 AND doc_id % 8 = 0) UNION ALL SELECT source, filename, 'new' FROM f WHERE doc_id % 8 = 0")
def replaced_files(spark, sf_dir):
    f = _files(spark, sf_dir)
    stored = f.select("source", "filename", F.lit("old").alias("v"))
    return index.replace_files(stored, f.filter("doc_id % 4 = 0").select("source", "filename", F.lit("new").alias("v")))


@query("WITH c AS (SELECT r_name, n_name, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)"
       " SELECT r_name || '/' || n_name AS folder, n AS file_count, 1 AS depth, '│   ' || n_name || '/ (' || n || ')' AS line FROM c UNION ALL SELECT DISTINCT r_name, 0, 0, r_name || '/ (0)' FROM c")
def folder_listing(spark, sf_dir):
    """Customers as files in folders of their nations, as a printed tree."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    files = n.select(F.lit("knowledge").alias("source"), text(F.col("r_name"), "/", F.col("n_name"), "/c", F.col("c_custkey"), ".md").alias("filename"))
    return index.folder_tree(files).select("folder", "file_count", "depth", "line")


@query("SELECT lang AS finding, CAST(doc_id AS VARCHAR) AS subject, source AS detail, CAST(row_number() OVER w AS INTEGER) AS rank, greatest(count(*) OVER (PARTITION BY lang) - 15, 0) AS n_more FROM documents WINDOW w AS (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR), source) QUALIFY rank <= 15")
def shown_findings(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select(F.col("lang").alias("finding"), F.col("doc_id").cast("string").alias("subject"), F.col("source").alias("detail"))
    return lint.shown(found)


# --- policy, calls, streams as batches ---


@query("SELECT event_type, CASE event_type WHEN 'view' THEN 'orient' WHEN 'error' THEN 'maintenance' ELSE 'explore' END AS class, count(*) AS n FROM events GROUP BY 1, 2")
def tool_classes(spark, sf_dir):
    """Unknown tools explore."""
    e = read(spark, sf_dir, "events").select("event_type", policy.class_of(F.col("event_type"), {"view": "orient", "error": "maintenance"}).alias("class"))
    return e.groupBy("event_type", "class").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'NOT_EXECUTED' WHEN length(text) > CASE source WHEN 'src1' THEN 500 ELSE 1000 END THEN 'TRUNCATED' ELSE 'COMPLETE' END AS frame, CAST(length(CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(text, CASE source WHEN 'src1' THEN 500 ELSE 1000 END) END) AS INTEGER) AS delivered FROM documents")
def framed_results(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tool"), "text", (F.col("doc_id") % 3 != 0).alias("executed"))
    return policy.frame_results(d, {"src1": 500}, 1000).select("doc_id", "frame", F.length("delivered").alias("delivered"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 8192 WHEN n_nationkey % 3 = 1 THEN 131072 ELSE 32000 END AS tokens FROM nation")
def context_windows(spark, sf_dir):
    k = F.col("n_nationkey")
    model = F.when(k % 3 == 0, "big:7b").when(k % 3 == 1, text("big:", k)).otherwise(text("other-", k))
    return read(spark, sf_dir, "nation").select("n_nationkey", policy.context_window(model, {"big:7b": 8192, "big": 131_072}).alias("tokens"))


@query("""SELECT event_id, event_type || '::[{"key":"a","value":"' || user_id || '"},{"key":"b","value":"x"}]' AS signature FROM events""")
def call_signatures(spark, sf_dir):
    """A call's signature does not depend on the order of its arguments."""
    args = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", T.signature(F.col("event_type"), args).alias("signature"))


@query("""WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS path, epoch_ms(ts) AS ms, event_type FROM events)
 SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.path = e.path AND e.ms BETWEEN p.ms AND p.ms + 3600000)""")
def suppressed_events(spark, sf_dir):
    """Events that remain if those within an hour after a purchase of the same user are suppressed."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("mtime"), "event_type")
    return ST.suppress(e, e.filter("event_type = 'purchase'").select("path", F.col("mtime").alias("at_ms")).distinct(), 3_600_000).select("event_id")


@query("WITH g AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap_us FROM events) SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS at_us, CAST(gap_us AS BIGINT) AS gap_us FROM g WHERE gap_us > 3000000")
def heartbeat_gaps(spark, sf_dir):
    """Silences of more than three seconds."""
    return ST.heartbeats(read(spark, sf_dir, "events"), 3000).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "gap_us")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 600000000 THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT CAST(user_id AS VARCHAR) AS path, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) + 600000000 AS BIGINT) AS until_us, count(*) AS n FROM s GROUP BY user_id, session""")
def debounced_sessions(spark, sf_dir):
    """Bursts of a user's events that are less than ten minutes apart."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts")
    return ST.debounce(e, "10 minutes").select("path", F.unix_micros("first").alias("first_us"), F.unix_micros("until").alias("until_us"), "n")


# --- conversations ---


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1), n AS (SELECT count(*) AS n FROM e),
 s AS (SELECT c.conv_id, c.turn, role, list_cosine_similarity(v, qv) AS score FROM conversations c, n, q JOIN e ON TRUE WHERE e.vec_id = (c.conv_id * 7 + c.turn) % n.n AND role IN ('user', 'assistant') AND trim(text) <> '')
 SELECT conv_id, turn, role, round(score, 6) AS score FROM s ORDER BY s.score DESC, conv_id, turn LIMIT 7""")
def turn_search(spark, sf_dir):
    """Turns by the vectors that are dealt to them."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v_id"), F.col("embedding").alias("vector"))
    c = read(spark, sf_dir, "conversations")
    first = e.orderBy("v_id").select("vector").first()[0]
    met = c.join(e, F.col("v_id") == (F.col("conv_id") * 7 + F.col("turn")) % F.lit(e.count()))
    return C.search_turns(met, first, 7).select("conv_id", "turn", "role", F.round("score", 6).alias("score"))


@query(r"""WITH p AS (SELECT conv_id, role, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations), s AS (SELECT * FROM p WHERE pos BETWEEN 1 AND 2)
 SELECT conv_id, md5(regexp_replace(string_agg('### turn[' || pos || '] ' || role || chr(10) || t || chr(10), chr(10) ORDER BY pos), '\s+$', '')) AS body, md5(left(coalesce(arg_min(CASE WHEN role = 'user' THEN t END, CASE WHEN role = 'user' THEN pos END), regexp_replace(string_agg('### turn[' || pos || '] ' || role || chr(10) || t || chr(10), chr(10) ORDER BY pos), '\s+$', '')), 500)) AS query FROM s GROUP BY 1""")
def rendered_talk(spark, sf_dir):
    """The second and third turn of each conversation as the text of a page, and what is searched for."""
    r = C.rendered(read(spark, sf_dir, "conversations"), 1, 2)
    return r.select("conv_id", F.md5("body").alias("body"), F.md5(C.query_of_talk(F.col("first_user"), F.col("body"))).alias("query"))


HISTORY = r"""a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'again' FROM conversations GROUP BY 1 UNION ALL SELECT conv_id, max(turn) + 2, 'user', 'again' FROM conversations GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM a), k AS (SELECT *, rn - 1 AS n FROM r WHERE rn > 1),
 c AS (SELECT *, CASE WHEN n <= 2 THEN text ELSE '[earlier turn: ' || left(regexp_replace(text, '\s+', ' ', 'g'), 60) || ']' END AS content FROM k),
 s AS (SELECT *, sum(CASE WHEN length(content) > 0 THEN greatest(1, length(content) // 4) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM c)"""


@query("WITH " + HISTORY + " SELECT conv_id, turn, md5(content) AS content FROM s WHERE n <= 2 OR spent <= 300")
def model_history(spark, sf_dir):
    """A model's history: a share of its window, and the last turn not twice."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("m"))
    again = lambda i: last.select("conv_id", (F.col("m") + i).alias("turn"), F.lit("user").alias("role"), F.lit("again").alias("text"))
    return C.history_for_model(t.unionByName(again(1)).unionByName(again(2)), 2000).select("conv_id", "turn", F.md5("content").alias("content"))


@query("WITH s AS (SELECT conv_id, count(*) AS turn_count, max(turn) AS last FROM conversations GROUP BY 1), r AS (SELECT 'c' || conv_id AS id, CAST(turn_count AS INTEGER) AS turn_count, (SELECT count(*) FROM s) AS total, row_number() OVER (ORDER BY last DESC, 'c' || conv_id) AS n FROM s) SELECT id, turn_count, total, CAST(CASE WHEN total > 15 THEN 15 END AS INTEGER) AS next_offset FROM r WHERE n > 5 AND n <= 15")
def recent_sessions(spark, sf_dir):
    """The second page of sessions by recency."""
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"), F.max("turn").alias("last"))
    s = t.select(text("c", F.col("conv_id")).alias("id"), F.lit("t").alias("title"), F.lit("x").alias("created_at"), F.lpad(F.col("last").cast("string"), 9, "0").alias("updated_at"), "turns")
    return C.recent(s, 5, 10).select("id", "turn_count", "total", "next_offset")


# --- graph records and resolution ---


NODES = "n AS (SELECT CASE p_size % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'concept' ELSE 'chunk' END AS node_type, CASE WHEN p_size % 3 = 2 THEN 'c' || p_partkey % 40 ELSE 'e' || p_partkey END AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, [p_brand, lang] AS tags, 'x' || p_partkey % 5 AS source_chunk_id, p_partkey AS seq FROM part, (SELECT 'all' AS lang))"


def _nodes(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 3 == 0, "entity").when(F.col("p_size") % 3 == 1, "concept").otherwise("chunk")
    return read(spark, sf_dir, "part").select(kind.alias("node_type"), F.when(F.col("p_size") % 3 == 2, text("c", num("p_partkey % 40"))).otherwise(text("e", k)).alias("id"), F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.array("p_brand", F.lit("all")).alias("tags"), text("x", num("p_partkey % 5")).alias("source_chunk_id"), k.alias("seq"))


@query("WITH " + NODES + """ SELECT node_type, arg_min(id, seq) AS id, arg_min(name, seq) AS name, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, array_to_string(list_sort(list_distinct(list(source_chunk_id))), ',') AS chunk_ids FROM n WHERE node_type <> 'chunk' GROUP BY node_type, lower(name)
 UNION ALL SELECT node_type, id, name, array_to_string(tags, ','), source_chunk_id FROM n WHERE node_type = 'chunk' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1""")
def merged_nodes(spark, sf_dir):
    m = G.merge_nodes(_nodes(spark, sf_dir))
    return m.select("node_type", "id", "name", F.array_join("tags", ",").alias("tags"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("WITH " + NODES + " SELECT id, name FROM n WHERE node_type <> 'chunk' AND contains(lower(name), 'wid') ORDER BY len(tags) DESC, id LIMIT 10")
def entity_search(spark, sf_dir):
    return G.search_entities(_nodes(spark, sf_dir), "WID").select("id", "name")


@query("""WITH p AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b FROM part) SELECT DISTINCT 'entity:' || a AS src, CAST(p_partkey AS VARCHAR) AS dst, 'references' AS edge_type, CAST(0.9 AS DOUBLE) AS weight FROM p
 UNION SELECT DISTINCT 'entity:' || b, CAST(p_partkey AS VARCHAR), 'references', 0.9 FROM p UNION SELECT DISTINCT 'entity:' || a, 'entity:' || b, 'relates_to', 0.7 FROM p""")
def entity_edges(spark, sf_dir):
    """Both words of a part's name as entities, related to each other."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
    one = lambda c: p.select("chunk_id", F.lit("entity").alias("kind"), F.col(c).alias("name"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("relation"))
    related = p.select("chunk_id", F.lit("relationship").alias("kind"), F.upper("a").alias("name"), F.col("b").alias("other"), F.lit("with").alias("relation"))
    return resolve.entity_edges(one("a").unionByName(one("b")).unionByName(related)).select("src", "dst", "edge_type", F.col("weight").cast("double").alias("weight"))


@query("SELECT 'd' || doc_id || '.md > part-' || doc_id % 4 AS address, 'found' AS outcome, CAST(doc_id AS VARCHAR) AS ids FROM documents UNION ALL SELECT 'd' || doc_id || '.md > nothing here', 'missing', NULL FROM documents")
def resolved_sections(spark, sf_dir):
    """Addresses of sections, with the heading written in other ways."""
    d = read(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("id"), text("d", F.col("doc_id"), ".md").alias("filename"), text("Top > Part ", num("doc_id % 4")).alias("heading"))
    asked = d.select(F.explode(F.array(text("d", F.col("doc_id"), ".md > part-", num("doc_id % 4")), text("d", F.col("doc_id"), ".md > nothing here"))).alias("address"))
    return resolve.resolve_sections(asked, chunks).select("address", "outcome", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


CHUNKS = "c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, CASE WHEN label < 3 THEN 'canon' ELSE 'knowledge' END AS source, 'h' || vec_id % 7 AS heading FROM embeddings), q AS (SELECT v AS qv FROM c ORDER BY id LIMIT 1)"


def _vectors(spark, sf_dir):
    k = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(k.alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") < 3, "canon").otherwise("knowledge").alias("source"), text("f", F.col("label"), ".md").alias("filename"), text("h", num("vec_id % 7")).alias("heading"), F.lit("wiki").alias("tier"), text("knowledge:f", F.col("label"), ".md").alias("path"), text("Text ", k, " ", F.repeat(F.lit("y"), F.lit(600))).alias("content"), (k % 5).alias("chunk_index"), F.lit(5).alias("section_count"))


def _first(rows):
    return rows.orderBy("id").select("vector").first()[0]


@query("WITH " + CHUNKS + ", s AS (SELECT id, round(list_cosine_similarity(v, qv), 6) AS cos, CAST(heading = 'h3' AS INTEGER) AS exact, CAST(source = 'canon' AS INTEGER) AS local FROM c, q) SELECT * FROM s ORDER BY cos DESC, exact DESC, local DESC, id LIMIT 20")
def ranked_candidates(spark, sf_dir):
    c = _vectors(spark, sf_dir)
    return resolve.rank_candidates(c, "h3", "canon", _first(c)).limit(20).select("id", F.round("cos", 6).alias("cos"), "exact", "local")


@query("WITH " + CHUNKS + ", s AS (SELECT id, label, list_cosine_similarity(v, qv) AS score FROM c, q ORDER BY score DESC, id LIMIT 3) SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, 'knowledge:f' || label || '.md > h' || id % 7 AS label, id % 5 + 1 AS position, 5 AS total, round(score, 6) AS score, left('Text ' || id || ' ' || repeat('y', 600), 500) AS excerpt FROM s")
def context_excerpts(spark, sf_dir):
    c = _vectors(spark, sf_dir)
    return V.excerpts(c, _first(c)).withColumn("score", F.round("score", 6))


@query("WITH " + CHUNKS + ", s AS (SELECT id, label, list_cosine_similarity(v, qv) AS score FROM c, q ORDER BY score DESC, id LIMIT 5) SELECT 'knowledge:f' || label || '.md' AS path, left('Text ' || id || ' ' || repeat('y', 600), 200) AS snippet, round(score, 6) AS score FROM s")
def search_listing(spark, sf_dir):
    c = _vectors(spark, sf_dir)
    return V.search_records(c, _first(c)).withColumn("score", F.round("score", 6))


@query("WITH " + CHUNKS + """, s AS (SELECT id, source || ':f' || label || '.md' AS file, row_number() OVER (ORDER BY list_cosine_similarity(v, qv) DESC, id) AS rank FROM c, q QUALIFY rank <= 10)
 SELECT id, CAST(rank AS INTEGER) AS rank, CASE WHEN lag(file) OVER (ORDER BY rank) IS DISTINCT FROM file THEN '== ' || file || ' [wiki]' END AS header FROM s""")
def search_headers(spark, sf_dir):
    """Hits with a header wherever the file changes."""
    c = _vectors(spark, sf_dir)
    return V.with_file_headers(V.search(c, _first(c), 10), [F.desc("weighted"), F.desc("score"), F.col("id")]).select("id", "rank", "header")


@query("SELECT 'node:' || vec_id AS id, 'h' || vec_id % 7 AS label, CASE WHEN label < 3 THEN 'canon' ELSE 'knowledge' END || ':f' || label || '.md' AS file, CASE WHEN label < 3 THEN 'canon' ELSE 'wiki' END AS tier FROM embeddings")
def node_records(spark, sf_dir):
    n = _vectors(spark, sf_dir).select("id", F.lit("chunk").alias("node_type"), F.lit("n").alias("name"), "filename", F.concat(F.lit("A > "), "heading").alias("heading"), F.lit(None).cast("string").alias("summary"), "source", F.array("source").alias("tags"))
    return G.node_records(n).select("id", "label", "file", "tier")


@query("SELECT 'edge:' || o_custkey || ':' || o_orderkey || ':references' AS id, 'node:' || o_custkey AS source, 'node:' || o_orderkey AS target, round(o_orderkey % 1000 / 999.0, 3) AS weight, repeat('e', 140) AS evidence, 'wiki' AS link_kind FROM orders")
def edge_records(spark, sf_dir):
    e = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("references").alias("edge_type"), (F.col("o_orderkey") % 1000 / 999.0).alias("weight"), F.repeat(F.lit("e"), F.lit(150)).alias("evidence"), F.lit("wiki").alias("link_kind"))
    return G.edge_records(e).select("id", "source", "target", "weight", "evidence", "link_kind")


REFS = "e AS (SELECT o_custkey AS src, o_orderkey AS dst, CASE WHEN o_orderkey % 5 = 0 THEN 'similar' ELSE 'references' END AS edge_type, CASE o_orderkey % 4 WHEN 0 THEN 'wiki' WHEN 1 THEN 'markdown' WHEN 2 THEN 'prose' END AS link_kind FROM orders)"


def _references(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), k.alias("dst"), F.when(k % 5 == 0, "similar").otherwise("references").alias("edge_type"), F.lit(1.0).alias("weight"), F.when(k % 4 == 0, "wiki").when(k % 4 == 1, "markdown").when(k % 4 == 2, "prose").alias("link_kind"))


@query("WITH " + REFS + ", r AS (SELECT coalesce(link_kind, 'other') AS link_kind, count(*) AS n FROM e WHERE edge_type = 'references' GROUP BY 1) SELECT link_kind, n, CAST(round(100 * n / (SELECT sum(n) FROM r)) AS INTEGER) AS percent FROM r")
def reference_kinds(spark, sf_dir):
    return G.reference_kinds(_references(spark, sf_dir))


@query("WITH " + REFS + """, a AS (SELECT src AS node, * FROM e UNION ALL SELECT dst, * FROM e WHERE src <> dst), k AS (SELECT node, coalesce(link_kind, 'other') AS kind, count(*) AS n FROM a WHERE edge_type = 'references' GROUP BY 1, 2),
 s AS (SELECT node, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM k GROUP BY 1) SELECT node, count(*) AS n_edges, coalesce(any_value(kinds), '') AS kinds FROM a LEFT JOIN s USING (node) GROUP BY 1""")
def profiles_by_kind(spark, sf_dir):
    p = G.node_profile(_references(spark, sf_dir))
    shown = F.transform(F.array_sort(F.map_entries("references_by_kind")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return p.select("node", (F.col("n_out") + F.col("n_in")).alias("n_edges"), F.array_join(shown, ",").alias("kinds"))


@query("SELECT vec_id AS id, 'x' || vec_id AS heading, CAST(CASE WHEN vec_id % 2 = 0 THEN vec_id END AS BIGINT) AS node FROM embeddings")
def hit_nodes(spark, sf_dir):
    """Hits with their nodes, by file and heading whatever its case and spacing."""
    hits = _vectors(spark, sf_dir).select("id", "source", "filename", text("x", F.col("id")).alias("heading"))
    nodes = hits.filter("id % 2 = 0").select("id", "source", "filename", F.concat(F.lit(" "), F.upper("heading"), F.lit(" ")).alias("heading"))
    return G.hits_to_nodes(hits, nodes).select("id", "heading", "node")


@query("WITH " + REFS + ", k AS (SELECT src || ':' || dst || ':' || edge_type AS key FROM e) SELECT key, (SELECT count(*) FROM k) AS total, CAST(CASE WHEN (SELECT count(*) FROM k) > 30 THEN 30 END AS INTEGER) AS next_offset FROM k ORDER BY key LIMIT 10 OFFSET 20")
def edge_pages(spark, sf_dir):
    """The third page of edges by their key."""
    return G.next_page(G.with_key(_references(spark, sf_dir)).select("key"), ["key"], 20, 10)


@query("WITH " + REFS + """, x AS (SELECT src, dst, edge_type FROM e WHERE dst % 2 = 0 UNION SELECT src, dst, edge_type FROM e WHERE dst % 3 = 0), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM x UNION ALL SELECT dst FROM x) GROUP BY 1),
 n AS (SELECT dst AS id, CASE WHEN dst % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM e WHERE dst % 2 = 0 OR dst % 3 = 0) SELECT n.id, v, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (id)""")
def client_graph(spark, sf_dir):
    """A viewer's graph after more was loaded."""
    e = _references(spark, sf_dir)
    side = lambda m, v: (e.filter(f"dst % {m} = 0").select(F.col("dst").alias("id"), F.lit(v).alias("v")), e.filter(f"dst % {m} = 0").select("src", "dst", "edge_type"))
    nodes, _ = G.merge_client(*side(2, "old"), *side(3, "new"))
    return nodes.select("id", "v", "degree")


@query("WITH " + CHUNKS + """, s AS (SELECT id, source, label, list_cosine_similarity(v, qv) * CASE WHEN source = 'canon' THEN 1.15 ELSE 1.0 END AS w, CASE WHEN source = 'canon' THEN 'canon' ELSE 'wiki' END AS tier, list_cosine_similarity(v, qv) AS cos FROM c, q),
 f AS (SELECT * FROM s ORDER BY cos DESC, id LIMIT 60), h AS (SELECT * FROM f ORDER BY w DESC, cos DESC, id LIMIT 20), b AS (SELECT * FROM h WHERE 'f' || label || '.md' <> 'f5.md' QUALIFY row_number() OVER (PARTITION BY tier, label ORDER BY w DESC, id) = 1)
 SELECT tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY w DESC, id) AS INTEGER) AS rank, 'f' || label || '.md' AS filename, round(w, 6) AS weighted FROM b QUALIFY rank <= 8""")
def compile_plan(spark, sf_dir):
    """What to read before a page about one file is written."""
    c = _vectors(spark, sf_dir).withColumns({"tier": F.when(F.col("source") == "canon", "canon").otherwise("wiki"), "summary": F.lit("s")})
    hits = V.search(c, _first(c), 20)
    return resolve.compile_plan(c, hits, "f5.md").select("tier", "rank", "filename", F.round("weighted", 6).alias("weighted"))


@query("WITH " + REFS + """, a AS (SELECT src AS node, dst AS neighbor, 1 AS o FROM e WHERE edge_type = 'references' UNION ALL SELECT dst, src, 0 FROM e WHERE edge_type = 'references' AND src <> dst)
 SELECT node, neighbor, CASE max(o) WHEN 1 THEN 'out' ELSE 'in' END AS direction FROM a WHERE neighbor % 2 = 0 GROUP BY 1, 2""")
def known_neighbors(spark, sf_dir):
    """Neighbours by one type of edge, as far as they are nodes."""
    e = _references(spark, sf_dir)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().filter("id % 2 = 0")
    return G.neighbors(e, nodes, "references").select("node", "neighbor", "direction")


@query("WITH " + FILES + " SELECT filename, source || CASE WHEN filename LIKE 'raw/%' THEN '|raw/s' WHEN filename LIKE 'wiki/%' THEN '|wiki' ELSE '' END || '|tier:' || CASE WHEN source = 'canon' THEN 'canon' WHEN filename LIKE 'raw/%' THEN 'raw' ELSE 'wiki' END AS tags FROM f")
def node_tags(spark, sf_dir):
    f = _files(spark, sf_dir)
    folder = F.when(index.folder_of(F.col("filename")) == ".", "").otherwise(index.folder_of(F.col("filename")))
    return f.select("filename", F.array_join(T.tags(F.col("source"), folder, T.tier(F.col("source"), F.col("filename"))), "|").alias("tags"))


@query("""WITH t AS (SELECT doc_id, 'a ' || left(replace(coalesce(text, ''), chr(10), ' '), 40) AS a FROM documents),
 u AS (SELECT *, '# Title ' || doc_id || chr(10) || chr(10) || 'about' || chr(10) || '## Part ' || doc_id % 3 || chr(10) || a || chr(10) || '### Deep' || chr(10) || 'b' || chr(10) || '## Last' || chr(10) || 'c' AS whole FROM t)
 SELECT doc_id, 'Title ' || doc_id AS heading, md5(whole) AS content FROM u WHERE length(whole) // 4 <= 20 UNION ALL SELECT doc_id, 'Title ' || doc_id, md5('about') FROM u WHERE length(whole) // 4 > 20
 UNION ALL SELECT doc_id, 'Title ' || doc_id || ' > Part ' || doc_id % 3, md5('## Part ' || doc_id % 3 || chr(10) || chr(10) || a || chr(10) || '### Deep' || chr(10) || 'b') FROM u WHERE length(whole) // 4 > 20
 UNION ALL SELECT doc_id, 'Title ' || doc_id || ' > Last', md5('## Last' || chr(10) || chr(10) || 'c') FROM u WHERE length(whole) // 4 > 20""")
def chunked_headings(spark, sf_dir):
    """Texts with headings through the chunker: front matter goes, and what is too long is divided at the next headings."""
    d = _headed(spark, sf_dir)
    files = d.select(F.lit("knowledge").alias("source"), F.col("doc_id").cast("string").alias("filename"), F.concat(F.lit("---\ntitle: x\n---\n"), "text").alias("text"))
    return markdown.chunk_files(files, 20).select(F.col("filename").cast("long").alias("doc_id"), "heading", F.md5("content").alias("content"))
