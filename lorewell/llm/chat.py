"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again after every turn, so that a logged conversation is a prefix of
longer ones.  Every turn gets a hash of its place, role and text; the running sum of these is the
hash of the turn-prefix.  A conversation whose whole hash occurs among the proper prefixes of longer
conversations goes (anti-join); of equal conversations the smallest conv_id stays.  What remains is
maximal and is rendered by a template.

Places are the values of ``turn``; rows of one turn are ordered by role and text.  Nulls and edges: rows
with a null conv_id are ignored; a null turn comes first, as turn -1; null role and text are
empty; exact repeats of a row count once; an empty table gives no rows; extra columns are ignored.
Conversations of more than ``chunk`` rows, in order, are rendered in several parts of as many rows, so no task gathers a conversation of
unbounded length, not even where turns are null or tied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes are masked so that a sum of 2**32 of them cannot overflow; three make up 93 bits.
_MASK = (1 << 31) - 1
_HASHES = ("h1", "h2", "h3")


def turns_of(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return (
        conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1).cast("long")).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .filter("conv_id is not null").distinct()
    )


def before_chunk(turns: DataFrame, sums: dict[str, Column], place: Column) -> DataFrame:
    """conv_id, chunk and the sums over all earlier chunks of the conversation, as name_0."""
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = turns.groupBy("conv_id", place.alias("chunk")).agg(*[c.alias(n) for n, c in sums.items()])
    return chunks.select("conv_id", "chunk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_0") for n in sums])


def prefix_hashes(turns: DataFrame, chunk: int) -> DataFrame:
    """conv_id, turn, n and the hashes: rows up to and including this turn, and what marks them."""
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "turn", "role", "text").bitwiseAND(F.lit(_MASK)))
    place = F.floor(F.col("turn") / chunk).cast("long")
    names = ("n", *_HASHES)
    per_turn = turns.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *[mark(i).alias(h) for i, h in enumerate(_HASHES)]).withColumn("chunk", place)
    # running sums in two levels: within chunks of turns, and over the chunks of a conversation
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    local = per_turn.select("conv_id", "turn", "chunk", *[F.sum(c).over(inside).alias(c) for c in names])
    starts = before_chunk(per_turn, {c: F.sum(c) for c in names}, F.col("chunk"))
    return local.join(starts, ["conv_id", "chunk"]).select("conv_id", "turn", *[(F.col(c) + F.col(f"{c}_0")).alias(c) for c in names])


def maximal(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """(conv_id, n_rows) of the conversations that are no prefix of a longer one, nor equal to one with a smaller conv_id."""
    prefixes = prefix_hashes(turns, chunk)
    key = ["n", *_HASHES]
    sizes = prefixes.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("w"))
    whole = sizes.select("conv_id", *[F.col(f"w.{c}").alias(c) for c in key])
    proper = prefixes.join(whole.select("conv_id", F.col("n").alias("n_all")), "conv_id").filter("n < n_all").select(*key).distinct()
    first = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    return first.join(proper, key, "left_anti").select("conv_id", F.col("n").alias("n_rows"))


def render(turns: DataFrame, chunk: int = 256, opening: str = "<|{role}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """conv_id, part, n_turns, text: each ``chunk`` rows of a conversation, in order, in the chat template."""
    before, _, after = opening.partition("{role}")
    place = F.floor(F.col("turn") / chunk).cast("long")
    # numbered in two levels: within chunks of turns, and by the rows of earlier chunks
    inside = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text"))
    local = turns.withColumn("chunk", place).withColumn("at", inside)
    numbered = local.join(before_chunk(turns, {"n": F.count("*")}, place), ["conv_id", "chunk"]).withColumn("part", F.floor((F.col("n_0") + F.col("at") - 1) / chunk).cast("long"))
    parts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    shown = F.transform("t", lambda t: F.concat(F.lit(before), t.role, F.lit(after), t.text, F.lit("\n" + closing)))
    return parts.select("conv_id", "part", F.size("t").cast("long").alias("n_turns"), F.array_join(shown, "").alias("text"))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = 256) -> DataFrame:
    turns = turns_of(conversations, id_col, turn_col, role_col, text_col)
    return render(turns.join(maximal(turns, chunk).select("conv_id"), "conv_id", "left_semi"), chunk)
