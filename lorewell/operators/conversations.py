"""Operators over conversation turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import snippet, title, token_count
from lorewell.functions.vectors import cosine
from lorewell.operators.graph import next_page

KEY = ("conv_id", "turn")


def rollup(turns: DataFrame) -> DataFrame:
    """Conversations with their number of turns and last turn."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("turn_count"), F.max("turn").alias("last_turn"))


def recent(sessions: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Sessions (id, title, created_at, updated_at, turns) by recency, one page, with their turns and how many sessions there are."""
    rows = sessions.select("id", "title", "created_at", "updated_at", F.size("turns").alias("turn_count"))
    return next_page(rows, [F.desc("updated_at"), "id"], offset, limit)


def rendered(turns: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """conv_id, body, first_user, first_text: turns by place from ``first`` to ``last`` as one text, each under its place and role, and the
    first texts in it (of the user, of anyone)."""
    own = turn_range(turns, first, 2**31 - 1 if last is None else last)
    text = F.trim(F.coalesce("text", F.lit("")))
    part = F.struct("pos", F.concat(F.lit("### turn["), F.col("pos").cast("string"), F.lit("] "), F.coalesce("role", F.lit("?")), F.lit("\n"), text, F.lit("\n")).alias("t"))
    body = F.rtrim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n"), r"\s+$", ""))
    at = lambda keep: F.min_by(F.when(keep, text), F.when(keep, F.col("pos")))
    return own.groupBy("conv_id").agg(body.alias("body"), at(F.col("role") == "user").alias("first_user"), at(text != "").alias("first_text"))


def query_of_talk(first_user, body):
    """What to search for when a conversation is compiled: 500 characters of the first user turn, else of all."""
    return F.left(F.when(F.coalesce(first_user, F.lit("")) != "", first_user).otherwise(body), F.lit(500))


def history_for_model(turns: DataFrame, window: int = 32_000, share: float = 0.15, always_full: int = 2) -> DataFrame:
    """The newest turns within ``share`` of a model's window, without a last user turn that repeats the one before it."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ranked = turns.withColumns({"_rn": F.row_number().over(w), "_before": F.lead(F.struct("role", "text")).over(w)})
    again = (F.col("_rn") == 1) & (F.col("role") == "user") & (F.col("_before") == F.struct("role", "text"))
    return history_within_budget(ranked.filter(~F.coalesce(again, F.lit(False))).drop("_rn", "_before"), int(window * share), always_full)


def titles(turns: DataFrame) -> DataFrame:
    """A title from the first user turn."""
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select("conv_id", title(F.col("t")).alias("title"))


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def turn_range(turns: DataFrame, first: int, last: int) -> DataFrame:
    """Turns first to last by place from 0; a last place beyond the end means the end."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos").between(first, last))


def compact(role, text, tools=None):
    """A turn in one line: that of an assistant with tools names them, others keep their head."""
    head = F.concat(F.lit("[earlier turn: "), F.left(F.regexp_replace(text, r"\s+", " "), F.lit(60)), F.lit("]"))
    if tools is None:
        return head
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(tools, lambda t: t["name"]))), ", ")
    return F.when(F.size(tools) > 0, F.concat(F.lit("[earlier turn: "), names, F.lit("]"))).otherwise(head)


def history_within_budget(turns: DataFrame, budget: int, always_full: int = 2) -> DataFrame:
    """The newest turns: the last ``always_full`` in any case, and while their summed tokens stay within
    the budget older ones in compact form, up to the first that does not fit; with column content."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ranked = turns.withColumn("rn", F.row_number().over(newest))
    content = F.when(F.col("rn") <= always_full, F.col("text")).otherwise(compact(F.col("role"), F.col("text")))
    costed = ranked.withColumn("content", content).withColumn("cost", token_count(F.col("content")))
    spent = costed.withColumn("spent", F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return spent.filter((F.col("rn") <= always_full) | (F.col("spent") <= budget))


def read_within_budget(turns: DataFrame, budget: int = 6000, head_chars: int = 4000) -> DataFrame:
    """Turns from the oldest: whole while they fit, the marker 'stop' at the first that does not, and
    nothing after; a first turn over the budget gives its head."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    costed = turns.withColumn("cost", token_count(F.col("text"))).withColumn("spent", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("spent") - F.col("cost")
    state = F.when(F.col("spent") <= budget, "full").when(before == 0, "head").otherwise("stop")
    marked = costed.withColumn("state", state).withColumn("stops", F.count(F.when(state == "stop", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shown = F.when(F.col("state") == "full", F.col("text")).when(F.col("state") == "head", F.left("text", F.lit(head_chars))).otherwise("")
    return marked.filter("stops = 0 or (stops = 1 and state = 'stop')").select("conv_id", "turn", "role", "state", shown.alias("shown"))


def search_turns(turns: DataFrame, query: list[float], limit: int = 5, vector: str = "vector") -> DataFrame:
    """User and assistant turns with text by cosine, at most 20, with a snippet."""
    own = turns.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return own.withColumn("score", score).orderBy(F.desc("score"), "conv_id", "turn").limit(min(20, max(1, limit))).select("conv_id", "turn", "role", "score", snippet(F.col("text")).alias("snippet"))


def message_tokens(turns: DataFrame) -> DataFrame:
    """Tokens of a conversation as messages: four for each message besides its text."""
    return turns.groupBy("conv_id").agg((F.sum(token_count(F.col("text"))) + 4 * F.count("*")).cast("long").alias("tokens"))


def context_usage(turns: DataFrame, window: int = 32_000, compact_at: float = 0.6, brake_at: float = 0.85) -> DataFrame:
    """Running share of the context window, and what is due at it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(token_count(F.col("text")) + 4).over(w)
    state = F.when(F.col("used") >= brake_at * window, "brake").when(F.col("used") >= compact_at * window, "compact").otherwise("ok")
    return turns.withColumn("used", used.cast("long")).withColumn("state", state)


def compact_context(messages: DataFrame, head: int = 200, trim: int = 300) -> DataFrame:
    """Messages before the last assistant block in short form: tool results as a stub of their head,
    assistant text cut; system and user messages stay whole."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    old = F.col("turn") < F.coalesce(F.col("_last"), F.lit(-1))
    short = F.when(old & (F.col("role") == "tool"), F.concat(F.lit("[compacted] "), F.left("text", F.lit(head)))).when(old & (F.col("role") == "assistant") & (F.length("text") > trim), F.concat(F.left("text", F.lit(trim)), F.lit("..."))).otherwise(F.col("text"))
    return messages.withColumn("_last", last).withColumn("content", short).drop("_last")


def validate_citations(cited: DataFrame, turns: DataFrame) -> DataFrame:
    """Citations (conv_id, first, last) with a verdict: ok, unknown conversation, or bad range."""
    counts = turns.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n"))
    verdict = F.when(F.col("n").isNull(), "unknown conversation").when((F.col("first") < 0) | (F.col("last") >= F.col("n")) | (F.col("last") < F.col("first")), "bad range").otherwise("ok")
    return cited.join(counts, F.col("conv_id") == F.col("id"), "left").withColumn("verdict", verdict).drop("id", "n")
