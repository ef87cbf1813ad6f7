"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.langid import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.line_dedup import drop_boilerplate

    done = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"))
    return done.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.chat import format_chats

    done = format_chats(table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "part", "n_turns", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.suffix_dedup import kept_digest, repeated_spans

    return kept_digest(repeated_spans(table(spark, sf_dir, "documents"), 200))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.quality_rules import judge_documents

    return judge_documents(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.collocations import mine_phrases

    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_ngram_jaccard_join, op3_source_mixing, op4_language_id, op5_line_dedup, op6_embedding_near_dedup, op7_lm_scoring, op8_chat_formatting, op9_merkle_fingerprints, op10_suffix_dedup,
        op11_quality_rules, op12_phrase_collocations, op13_spelling_variants,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "w AS (SELECT doc_id, regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+') AS w FROM documents)"
_BARE = r"regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')"

SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": "WITH RECURSIVE " + _WORDS + """,
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
 r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
 c AS (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY 1)
 SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op3_source_mixing": r"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, md5('1|' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
 t AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY 1), p AS (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM t) AS p FROM t WHERE tokens > 0), one AS (SELECT list(p) AS ps, count(*) AS k FROM p),
 b AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
   SELECT step + 1, CASE WHEN h >= 0.9 * ln(k) - 1e-12 THEN mid ELSE lo END, CASE WHEN h >= 0.9 * ln(k) - 1e-12 THEN hi ELSE mid END FROM (
     SELECT step, lo, hi, mid, k, ln(z) - list_sum(list_transform(ws, lambda x: x * ln(x))) / z AS h FROM (
       SELECT *, list_sum(ws) AS z FROM (SELECT step, lo, hi, k, (lo + hi) / 2 AS mid, list_transform(ps, lambda x: pow(x, (lo + hi) / 2)) AS ws FROM b, one WHERE step < 48)))),
 c AS (SELECT step, lo, hi FROM b WHERE step = 48),
 nat AS (SELECT -list_sum(list_transform(ps, lambda x: x * ln(x))) >= 0.9 * ln(k) - 1e-12 AS even FROM one),
 e1 AS (SELECT CASE WHEN even THEN 1.0 ELSE lo END AS a FROM c, nat),
 e AS (SELECT CASE WHEN list_max(ps) > 0 AND greatest(pow(list_min(ps), a - 1), pow(list_max(ps), a - 1)) / least(pow(list_min(ps), a - 1), pow(list_max(ps), a - 1)) <= 2 THEN a ELSE 1 - ln(2) / ln(list_max(ps) / list_min(ps)) END AS a FROM e1, one),
 w AS (SELECT s, tokens, pow(p, a) / (SELECT sum(pow(p, a)) FROM p, e) AS w FROM p, e), g AS (SELECT max(ceil(round(tokens / w, 3))) AS budget FROM w),
 q AS (SELECT s, CAST(floor(round(w * budget, 3)) AS BIGINT) // tokens AS epochs, CAST(floor(round(w * budget, 3)) AS BIGINT) % tokens AS rest FROM w, g),
 r AS (SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY d.s ORDER BY key RANGE UNBOUNDED PRECEDING) AS run FROM d LEFT JOIN q ON q.s = d.s)
 SELECT doc_id, source, n_tokens, CAST(coalesce(epochs + CASE WHEN n_tokens > 0 AND run <= rest THEN 1 ELSE 0 END, 1) AS BIGINT) AS copies FROM r""",
    "op5_line_dedup": "WITH pages AS (SELECT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),"
    " l AS (SELECT host, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + _BARE + "), lambda y: y <> ''))) AS line FROM pages),"
    " b AS (SELECT host, list(line) AS lines FROM (SELECT host, line, count(*) AS n FROM l GROUP BY 1, 2) JOIN (SELECT host, count(*) AS pages FROM pages GROUP BY 1) USING (host) WHERE n > 1 AND n > CAST(0.05 AS DOUBLE) * pages GROUP BY 1),"
    " k AS (SELECT doc_id, text, string_split(text, chr(10)) AS a, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(lines, []), " + _BARE + ")) AS kept FROM documents d LEFT JOIN b ON b.host = coalesce(d.source, ''))"
    " SELECT doc_id, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(a) - len(kept), 0) AS BIGINT) AS n_dropped, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM k",
    "op7_lm_scoring": "WITH " + _WORDS + """, p AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
 g AS (SELECT doc_id, 1 AS k, c AS g FROM p UNION ALL SELECT doc_id, 2, b || ' ' || c FROM p WHERE i > 1 UNION ALL SELECT doc_id, 3, a || ' ' || b || ' ' || c FROM p WHERE i > 2),
 own AS (SELECT doc_id, k, g, count(*) AS n FROM g GROUP BY 1, 2, 3), al AS (SELECT k, g, sum(n) AS n FROM own GROUP BY 1, 2),
 rest AS (SELECT doc_id, o.k, o.g, al.n - o.n AS n FROM own o JOIN al ON al.k = o.k AND al.g = o.g),
 nd AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), na AS (SELECT count(*) AS n FROM p),
 v AS (SELECT p.doc_id, i, greatest(na.n - nd.n, 1) AS others, r1.n AS n1, r2.n AS n2, r3.n AS n3, q1.n AS m1, q2.n AS m2 FROM p JOIN nd USING (doc_id), na
   JOIN rest r1 ON r1.doc_id = p.doc_id AND r1.k = 1 AND r1.g = c LEFT JOIN rest r2 ON r2.doc_id = p.doc_id AND r2.k = 2 AND r2.g = b || ' ' || c LEFT JOIN rest r3 ON r3.doc_id = p.doc_id AND r3.k = 3 AND r3.g = a || ' ' || b || ' ' || c
   LEFT JOIN rest q1 ON q1.doc_id = p.doc_id AND q1.k = 1 AND q1.g = b LEFT JOIN rest q2 ON q2.doc_id = p.doc_id AND q2.k = 2 AND q2.g = a || ' ' || b),
 s1 AS (SELECT *, CASE WHEN n1 > 0 THEN n1 ELSE 0.5 END / others AS s FROM v), s2 AS (SELECT * REPLACE (CASE WHEN i < 2 THEN s WHEN n2 > 0 THEN n2 / m1 ELSE CAST(0.4 AS DOUBLE) * s END AS s) FROM s1),
 s3 AS (SELECT * REPLACE (CASE WHEN i < 3 THEN s WHEN n3 > 0 THEN n3 / m2 ELSE CAST(0.4 AS DOUBLE) * s END AS s) FROM s2),
 z AS (SELECT doc_id, count(CASE WHEN n3 > 0 THEN 1 END) AS n_seen, round(avg(log10(s)), 6) AS score FROM s3 GROUP BY 1)
 SELECT d.doc_id, CAST(coalesce(nd.n, 0) AS BIGINT) AS n_words, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen, score FROM documents d LEFT JOIN nd USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op8_chat_formatting": """WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 h AS (SELECT conv_id, turn, string_agg(turn || '|' || length(role) || '|' || role || '|' || length(text) || '|' || text, chr(1)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix,
   count(*) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS n, count(*) OVER (PARTITION BY conv_id) AS n_all, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC, text DESC) AS last FROM t),
 whole AS (SELECT prefix, min(conv_id) AS conv_id FROM h WHERE n = n_all GROUP BY 1),
 kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM h WHERE n < n_all AND last = 1)),
 q AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 256 AS part FROM t WHERE conv_id IN (SELECT conv_id FROM kept)),
 r AS (SELECT conv_id, CAST(part AS BIGINT) AS part, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text FROM q GROUP BY 1, 2)
 SELECT conv_id, part, n_turns, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM r""",
    "op11_quality_rules": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 m AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM t),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM m WHERE len(w) > 2),
 f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM f, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
 x AS (SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
   len(l) AS n_lines, len(list_filter(w, lambda y: regexp_matches(y, '\pL'))) AS lettered, len(list_filter(l, lambda y: regexp_matches(y, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets, len(list_filter(l, lambda y: regexp_matches(y, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots FROM m LEFT JOIN c USING (doc_id)),
 b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 3 * n_words OR word_chars > 10 * n_words)::INT + 8 * (10 * n_symbols > n_words)::INT + 16 * (100 * lettered < 80 * n_words)::INT
   + 32 * (100 * n_dup_lines > 50 * n_lines)::INT + 64 * (100 * n_dup_lines > 30 * n_lines)::INT + 128 * (100 * bullets > 90 * n_lines)::INT + 256 * (100 * dots > 30 * n_lines)::INT AS BIGINT) AS fails FROM x)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails & 3 <> 0 AS base_failed, fails & 63 = 0 AS kept, fails, CAST(2 AS INT) AS policy FROM b""",
    "op12_phrase_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(""" + _LOWER + r""", '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
 w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
 t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
 g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
 f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
 c AS (SELECT lang, k, g, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
 s AS (SELECT c.*, x.f AS l, y.f AS r, t.n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1:] JOIN t ON t.lang = c.lang),
 m AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS nth FROM s),
 h AS (SELECT lang, g[i:j] AS g, max(f) AS longer FROM (SELECT lang, g, f, k, unnest(range(1, k)) AS i FROM f WHERE k > 2), (SELECT unnest(range(2, 6)) AS j) WHERE j > i AND j <= k AND j - i < k - 1 GROUP BY 1, 2),
 q AS (SELECT m.lang, array_to_string(m.g, ' ') AS phrase, a, l, r, n, score FROM m LEFT JOIN h ON h.lang = m.lang AND h.g = m.g WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
 o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
 SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
    "op13_spelling_variants": r"""WITH RECURSIVE tab AS (SELECT 0 AS step, i::BIGINT AS i, i::BIGINT AS v FROM range(256) t(i) UNION ALL SELECT step + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab WHERE step < 8),
 crc AS (SELECT list(v ORDER BY i) AS tab FROM tab WHERE step = 8),
 o AS (SELECT doc_id, r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(""" + _LOWER + r""", '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY 1, 2),
 b AS (SELECT r, k, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r) AS b FROM o),
 h AS (SELECT r, k, xor(list_reduce(list_transform(range(1, 2 * octet_length(b), 2), lambda i: ('0x' || hex(b)[i:i + 1])::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, crc),
 x AS (SELECT CASE WHEN h % 31 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS w, k FROM h),
 v AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM x WHERE length(w) >= 7 GROUP BY 1 HAVING sum(k) > 1),
 d AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM v), e AS (SELECT w, i, w[:i - 1] || w[i + 1:] AS e FROM d),
 near AS (SELECT e.w AS a, v.w AS b FROM e JOIN v ON v.w = e.e UNION SELECT v.w, e.w FROM e JOIN v ON v.w = e.e UNION SELECT y.w, z.w FROM e y JOIN e z ON y.e = z.e AND y.i = z.i AND y.w <> z.w),
 best AS (SELECT a, count(*) AS n_near, first(near.b ORDER BY n DESC, near.b) AS b, max(n) AS m FROM near JOIN v ON v.w = near.b GROUP BY 1),
 f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN b END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.a = v.w),
 up AS (SELECT w, w AS root, 0 AS step FROM f UNION ALL SELECT up.w, f.form, step + 1 FROM up JOIN f ON f.w = up.root WHERE f.form IS NOT NULL),
 last AS (SELECT w, first(root ORDER BY step DESC) AS root FROM up GROUP BY 1)
 SELECT f.w AS word, form, root, n, n_near, form_n FROM f JOIN last USING (w)""",
}
