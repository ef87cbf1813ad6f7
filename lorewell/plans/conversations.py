"""Queries over ``conversations`` and over ``events`` as a log of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions.text import conversation_ref, snippet
from lorewell.operators import conversations as C
from lorewell.operators import policy as P

QUERIES, SQL = {}, {}
TOKENS_SQL = "(CASE WHEN length({0}) > 0 THEN greatest(1, length({0}) // 4) ELSE 0 END)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def calls(spark, sf_dir):
    """events as calls: a turn is a user's day, the class goes by the event type, the arguments are props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cls = F.when(F.col("event_type") == "view", "orient").when(F.col("event_type") == "click", "explore").when(F.col("event_type") == "error", "maintenance").otherwise("write")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("turn_id"), F.col("event_id").alias("seq"), cls.alias("class"), F.concat_ws("::", "event_type", "props").alias("signature"), "ts", "user_id", "value")


CALLS_SQL = """calls AS (SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS turn_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'orient' WHEN 'click' THEN 'explore' WHEN 'error' THEN 'maintenance' ELSE 'write' END AS class, event_type || '::' || props AS signature, ts, user_id, value FROM events)"""


@query("SELECT conv_id, count(*) AS turn_count, max(turn) AS last_turn FROM conversations GROUP BY 1")
def conversation_rollup(spark, sf_dir):
    return C.rollup(turns(spark, sf_dir))


@query("SELECT conv_id, CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)")
def conversation_title(spark, sf_dir):
    return C.titles(turns(spark, sf_dir))


@query(r"SELECT conv_id, turn, left(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 160) AS snippet FROM conversations")
def turn_snippet(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", snippet(F.col("text")).alias("snippet"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_turns(spark, sf_dir):
    return C.last_turns(turns(spark, sf_dir), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos FROM conversations QUALIFY pos BETWEEN 1 AND 3")
def turn_range(spark, sf_dir):
    return C.turn_range(turns(spark, sf_dir), 1, 3).select("conv_id", "turn", "pos")


@query(r"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
 c AS (SELECT *, CASE WHEN rn <= 2 THEN text ELSE '[earlier turn: ' || left(regexp_replace(text, '\s+', ' ', 'g'), 60) || ']' END AS content FROM r),
 s AS (SELECT *, """ + TOKENS_SQL.format("content") + r""" AS cost FROM c),
 t AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM s)
 SELECT conv_id, turn, content, CAST(cost AS BIGINT) AS cost FROM t WHERE rn <= 2 OR spent <= 300""")
def history_budget(spark, sf_dir):
    return C.history_within_budget(turns(spark, sf_dir), 300, 2).select("conv_id", "turn", "content", "cost")


@query("""WITH c AS (SELECT *, """ + TOKENS_SQL.format("text") + """ AS cost FROM conversations),
 s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM c),
 m AS (SELECT *, CASE WHEN spent <= 400 THEN 'full' WHEN spent = cost THEN 'head' ELSE 'stop' END AS state FROM s),
 k AS (SELECT *, sum(CASE WHEN state = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS stops FROM m)
 SELECT conv_id, turn, role, state, CASE state WHEN 'full' THEN text WHEN 'head' THEN left(text, 100) ELSE '' END AS shown FROM k WHERE stops = 0 OR (stops = 1 AND state = 'stop')""")
def read_conversation_budget(spark, sf_dir):
    return C.read_within_budget(turns(spark, sf_dir), 400, 100)


@query("SELECT conv_id, CAST(sum(" + TOKENS_SQL.format("text") + ") + 4 * count(*) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def message_tokens(spark, sf_dir):
    return C.message_tokens(turns(spark, sf_dir))


@query("WITH u AS (SELECT conv_id, turn, CAST(sum(" + TOKENS_SQL.format("text") + " + 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations)"
       " SELECT *, CASE WHEN used >= 0.85 * 1000 THEN 'brake' WHEN used >= 0.6 * 1000 THEN 'compact' ELSE 'ok' END AS state FROM u")
def context_usage(spark, sf_dir):
    return C.context_usage(turns(spark, sf_dir), 1000).select("conv_id", "turn", "used", "state")


@query("""WITH l AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations)
 SELECT conv_id, turn, CASE WHEN turn < coalesce(last, -1) AND role = 'assistant' AND length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS content FROM l""")
def context_compaction(spark, sf_dir):
    return C.compact_context(turns(spark, sf_dir)).select("conv_id", "turn", "content")


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
 cited AS (SELECT conv_id * 2 AS conv_id, turn AS first, turn + conv_id % 3 AS last FROM conversations)
 SELECT c.conv_id, first, last, CASE WHEN n IS NULL THEN 'unknown conversation' WHEN first < 0 OR last >= n OR last < first THEN 'bad range' ELSE 'ok' END AS verdict FROM cited c LEFT JOIN n USING (conv_id)""")
def citation_validation(spark, sf_dir):
    t = turns(spark, sf_dir)
    cited = t.select((F.col("conv_id") * 2).alias("conv_id"), F.col("turn").alias("first"), (F.col("turn") + F.col("conv_id") % 3).alias("last"))
    return C.validate_citations(cited, t)


@query(r"""WITH r AS (SELECT CASE turn % 4 WHEN 0 THEN 'c' || conv_id WHEN 1 THEN 'c' || conv_id || ':last:' || turn WHEN 2 THEN 'c' || conv_id || ':turn:' || turn ELSE 'c' || conv_id || ':turn:' || turn || '-' || (turn + conv_id % 3 - 1) END AS ref FROM conversations)
 SELECT ref, CASE WHEN ref LIKE '%:last:%' THEN 'last' WHEN ref NOT LIKE '%:turn:%' THEN 'all' WHEN ref LIKE '%-%' AND CAST(regexp_extract(ref, '-(\d+)$', 1) AS BIGINT) < CAST(regexp_extract(ref, ':(\d+)-', 1) AS BIGINT) THEN 'invalid' ELSE 'range' END AS kind FROM r""")
def conversation_refs(spark, sf_dir):
    n, c = F.col("turn").cast("string"), F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    span = F.concat(c, F.lit(":turn:"), n, F.lit("-"), (F.col("turn") + F.col("conv_id") % 3 - 1).cast("string"))
    ref = F.when(F.col("turn") % 4 == 0, c).when(F.col("turn") % 4 == 1, F.concat(c, F.lit(":last:"), n)).when(F.col("turn") % 4 == 2, F.concat(c, F.lit(":turn:"), n)).otherwise(span)
    return turns(spark, sf_dir).select(ref.alias("ref")).select("ref", conversation_ref(F.col("ref"))["kind"].alias("kind"))


@query("WITH " + CALLS_SQL + " SELECT seq, turn_id, row_number() OVER (PARTITION BY turn_id, signature ORDER BY seq) > 1 AS duplicate FROM calls")
def duplicate_calls(spark, sf_dir):
    return P.duplicate_calls(calls(spark, sf_dir)).select("seq", "turn_id", "duplicate")


@query("WITH " + CALLS_SQL + " SELECT turn_id, class, count(*) AS n, count(*) > CASE class WHEN 'orient' THEN 5 WHEN 'explore' THEN 10 WHEN 'write' THEN 2 ELSE 3 END AS exceeded FROM calls GROUP BY 1, 2")
def class_usage(spark, sf_dir):
    return P.class_counts(calls(spark, sf_dir))


@query("WITH " + CALLS_SQL + """, f AS (SELECT turn_id, class, signature, min(seq) AS first FROM calls GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY turn_id, class ORDER BY first) AS nth, CASE class WHEN 'orient' THEN 5 WHEN 'explore' THEN 10 WHEN 'write' THEN 2 ELSE 3 END AS budget FROM f),
 l AS (SELECT turn_id, class, min(first) AS full_at FROM n WHERE nth = budget GROUP BY 1, 2)
 SELECT c.turn_id, c.seq, CASE WHEN c.seq > l.full_at THEN 'REFUSED' WHEN c.seq = n.first THEN 'EXECUTED' ELSE 'SKIPPED' END AS decision FROM calls c JOIN n ON n.turn_id = c.turn_id AND n.class = c.class AND n.signature = c.signature LEFT JOIN l ON l.turn_id = c.turn_id AND l.class = c.class""")
def call_budget_admission(spark, sf_dir):
    return P.admit(calls(spark, sf_dir)).select("turn_id", "seq", "decision")


@query("WITH " + CALLS_SQL + """, l AS (SELECT seq, turn_id, CAST(value * 100 AS BIGINT) AS tokens, 8000 + seq % 5 * 100 - 100 AS available FROM calls),
 b AS (SELECT *, count(*) OVER w AS before, coalesce(sum(tokens) OVER w, 0) AS used FROM l WINDOW w AS (PARTITION BY turn_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT turn_id, seq, CASE WHEN before >= 3 THEN 'too many loads' WHEN available < 8000 THEN 'too little room' WHEN used >= 8000 THEN 'half the window is used' ELSE 'ok' END AS gate FROM b""")
def load_gate(spark, sf_dir):
    loads = calls(spark, sf_dir).select("seq", "turn_id", F.round(F.col("value") * 100).cast("long").alias("tokens"), (8000 + F.col("seq") % 5 * 100 - 100).alias("available"))
    return P.load_gate(loads, most=3, window=16_000).select("turn_id", "seq", "gate")


@query("""SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type, CAST(date_trunc('day', ts) AS DATE))""")
def event_rollup(spark, sf_dir):
    """An extra beyond the knowledge-base operators: grouping sets."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total"))
