"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised.  The exponent is bisected: the
largest one in [0, 1] whose weights meet the target entropy (a share of the greatest possible) without
repeating any source more than ``max_epochs`` times as often as the least repeated one.  If the limit on
repetition and the entropy cannot both be met, the limit wins.  Weights are realised as budgeted
block permutations: a source's documents stand in a pseudo-random order, in blocks by the leading
digits of a hash; whole epochs take every document, the rest of the source's budget takes the
beginning of the next permutation, as far as whole documents fit.  Without a budget, the smallest one is
taken at which no source is cut: every document comes at least once.

Tokens are words divided by white space.  Nulls and edges: a null source is the source ''; null text has no
tokens; documents without tokens come once per whole epoch; rows with equal id stand side by
side and are taken together;
a corpus without tokens gets every document once; an empty table gives no rows; clashing
columns are replaced.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

#: Exponents tried in one pass over the sources, and passes: the interval shrinks to 32**-9.
GRID, PASSES = 32, 9


def words(text: Column) -> Column:
    """How many words a text has."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def bisect_exponent(shares: DataFrame, entropy_share: float, max_epochs: float) -> float:
    """The largest exponent in [0, 1] that meets both limits; ``shares``: column p > 0 by source."""
    n = shares.count()
    if n <= 1:
        return 1.0
    low, high = 0.0, 1.0

    def measures(grid: list[float]) -> list[tuple[float, float]]:
        # one small aggregate for all exponents of the grid: entropy, and the spread of repetition
        each = [(F.pow("p", F.lit(a))) for a in grid]
        cols = [c for a, w in zip(grid, each) for c in (F.sum(w), F.sum(w * F.log(w)), F.max(F.pow("p", F.lit(a - 1))), F.min(F.pow("p", F.lit(a - 1))))]
        r = shares.agg(*cols).first()
        return [(log(r[4 * i]) - r[4 * i + 1] / r[4 * i], r[4 * i + 2] / r[4 * i + 3]) for i in range(len(grid))]

    def allowed(h: float, spread: float) -> tuple[bool, bool]:
        return h >= entropy_share * log(n) - 1e-12, spread <= max_epochs * (1 + 1e-12)

    # entropy falls and the spread of repetition narrows as the exponent grows
    for want in (0, 1):
        lo, hi = low, high
        ends = [allowed(*m)[want] for m in measures([lo, hi])]
        if want == 0 and not ends[1]:  # the natural shares are too uneven: the largest exponent that is even enough
            for _ in range(PASSES):
                grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
                good = [a for a, m in zip(grid, measures(grid)) if allowed(*m)[0]]
                lo = max(good, default=lo)
                hi = min([a for a in grid if a > lo], default=hi)
            high = low = lo
        elif want == 1 and not allowed(*measures([low if low == high else high])[0])[1]:
            lo, hi = low, 1.0
            for _ in range(PASSES):
                grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
                good = [a for a, m in zip(grid, measures(grid)) if allowed(*m)[1]]
                hi = min(good, default=hi)
                lo = max([a for a in grid if a < hi], default=lo)
            high = low = hi
    return high


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_share: float = 0.9, max_epochs: float = 2.0, budget: int | None = None, seed: int = 1
) -> DataFrame:
    """``docs`` with n_tokens and copies: how often the mixture takes each document (0 and up)."""
    store = Scratch(docs.sparkSession, "mixing")
    extra = ("n_tokens", "copies")
    kept = [c for c in docs.columns if c not in extra]
    # blocks: the leading 3 digits of the permutation's key, so that a hot source is 4096 windows
    named = docs.select(*kept, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__mix_source"), words(F.col(text_col)).alias("n_tokens"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("__mix_key")).withColumn("__mix_block", F.substring("__mix_key", 1, 3))
    blocks = store.write(named.groupBy("__mix_source", "__mix_block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = store.write(blocks.groupBy("__mix_source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.filter("tokens > 0").select("__mix_source", "tokens", (F.col("tokens") / F.lit(max(1, total))).alias("p"))
    a = bisect_exponent(shares, entropy_share, max_epochs)
    weights = shares.withColumn("w", F.pow("p", F.lit(a)))
    norm = weights.agg(F.sum("w")).first()[0] or 1.0
    weights = weights.withColumn("w", F.col("w") / norm)
    if budget is None:
        budget = weights.agg(F.max(F.ceil(F.round(F.col("tokens") / F.col("w"), 3)))).first()[0] or 0
    quotas = weights.select("__mix_source", "tokens", F.floor(F.round(F.col("w") * budget, 3)).cast("long").alias("quota"))
    quotas = quotas.select("__mix_source", F.expr("quota div tokens").alias("__mix_epochs"), F.expr("quota % tokens").alias("__mix_rest"))
    over = Window.partitionBy("__mix_source").orderBy("__mix_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__mix_source", "__mix_block", "tokens", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("__mix_start")).join(quotas, "__mix_source", "left")
    # a permutation's beginning is all keys up to a cut, which lies in one block of each source
    whole = starts.filter(F.col("__mix_start") + F.col("tokens") <= F.col("__mix_rest")).groupBy("__mix_source").agg(F.max("__mix_block").alias("__mix_whole"))
    split = few(starts.filter((F.col("tokens") > 0) & (F.col("__mix_start") <= F.col("__mix_rest")) & (F.col("__mix_start") + F.col("tokens") > F.col("__mix_rest"))).select("__mix_source", "__mix_block", "__mix_start", "__mix_rest"), store)
    inside = Window.partitionBy("__mix_source").orderBy("__mix_key").rangeBetween(Window.unboundedPreceding, 0)
    running = named.join(split, ["__mix_source", "__mix_block"]).select("__mix_source", "__mix_key", "__mix_rest", (F.col("__mix_start") + F.sum("n_tokens").over(inside)).alias("__mix_run"))
    last = running.filter("__mix_run <= __mix_rest").groupBy("__mix_source").agg(F.max("__mix_key").alias("__mix_cut"))
    cuts = few(quotas.join(whole, "__mix_source", "left").join(last, "__mix_source", "left").select("__mix_source", "__mix_epochs", F.greatest(F.concat("__mix_whole", F.lit("~")), "__mix_cut").alias("__mix_cut")), store)
    once_more = F.when((F.col("n_tokens") > 0) & (F.col("__mix_key") <= F.col("__mix_cut")), 1).otherwise(0)
    return named.join(cuts, "__mix_source", "left").select(*kept, "n_tokens", F.coalesce(F.col("__mix_epochs") + once_more, F.lit(1)).cast("long").alias("copies"))


def few(rows: DataFrame, store: Scratch) -> DataFrame:
    """A table of one row per source, broadcast if it has at most 50,000 rows."""
    rows = store.write(rows, "few")
    return F.broadcast(rows) if rows.count() <= 50_000 else rows
