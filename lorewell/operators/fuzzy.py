"""Fuzzy suggestions of names for a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are taken against all names at once.
MOST_QUERIES = 10_000


def _asked(queries: DataFrame) -> list[str]:
    asked = [r[0] for r in queries.select("query").distinct().limit(MOST_QUERIES + 1).collect()]
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    return asked


def _top(scored: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("ratio"), "name")
    return scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def suggest_by_edits(queries: DataFrame, names: DataFrame, least: float = 0.5, most: int = 5) -> DataFrame:
    """query, name, ratio: 1 less the edit distance by the longer one's length; names whose length alone is too far off are not looked at,
    and a distance is followed only as far as it may count."""
    asked = F.broadcast(queries.sparkSession.createDataFrame([(q,) for q in _asked(queries)], "query string"))
    longer, shorter = F.greatest(F.length("query"), F.length("name")), F.least(F.length("query"), F.length("name"))
    far = F.levenshtein(F.lower("query"), F.lower("name"))
    pairs = names.select("name").join(asked, (longer > 0) & (shorter >= (least - 1e-9) * longer))
    return _top(pairs.withColumn("ratio", 1.0 - far / longer).filter(F.col("ratio") >= least), most)


def best_ratio(matcher: SequenceMatcher, query: str, least: float, best: float) -> float:
    """The ratio of the matcher's text and a query if it is at least ``least`` and greater than ``best``, else ``best``."""
    matcher.set_seq1(query)
    floor = max(least, best)
    # cheap upper bounds first
    if matcher.real_quick_ratio() < floor or matcher.quick_ratio() < floor:
        return best
    return max(best, matcher.ratio())


def suggest(queries: DataFrame, names: DataFrame, least: float = 0.45, most: int = 3, bonus: float = 0.2) -> DataFrame:
    """query, name, ratio: the share of matching blocks (Ratcliff and Obershelp), of the whole name or its
    last part, and a bonus for names that hold the query."""
    asked = [(q, q.lower()) for q in _asked(queries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                low = (name or "").lower()
                matchers = [SequenceMatcher(None, "", x, autojunk=False) for x in {low, low.rsplit(" > ", 1)[-1], low.rsplit("/", 1)[-1]}]
                for q, p in asked:
                    more, best = (bonus if p in low else 0.0), 0.0
                    for m in matchers:
                        best = best_ratio(m, p, least - more, best)
                    if best + more >= least:
                        out.append((q, name, best + more))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.float64()))], ["query", "name", "ratio"])

    return _top(names.select("name").mapInArrow(run, "query string, name string, ratio double"), most)
