"""Line dedup by site-relative frequency.

For each host, the number of its pages that contain a line is divided by the host's pages; repeated lines
(on two pages at least: one page repeats nothing, whatever its share) above ``ratio`` are boilerplate and are dropped
from that host's pages.  Copies of a page are pages like any other, so a text that makes up more than ``ratio`` of its
host is boilerplate as a whole.  A host has at most (mean lines of its pages) / ratio such lines, so they travel as one short
array per host.

Lines are divided by line feeds and compared after trimming spaces, tabs and carriage returns, by their 64-bit hash; blank
lines are never dropped.  Nulls and edges: a null text stays null, has no lines and is no page; a page without a
host (null) counts with the host ''; a line that repeats within a page counts once; repeated rows
are pages of their own; texts are split whole, however long; lines exactly at the ratio stay; an empty table gives no rows;
columns with clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

#: Of a host's pages; clearly below the tenth at which lines repeated throughout a site stand, above passages quoted here and there.
RATIO = 0.05


def bare(line: Column) -> Column:
    return F.regexp_replace(line, "^[ \\t\\r]+|[ \\t\\r]+$", "")


def boilerplate(pages: DataFrame, host: Column, text_col: str, ratio: float) -> DataFrame:
    """(host, lines): the hashes of every host's boilerplate lines."""
    sited = pages.filter(F.col(text_col).isNotNull()).select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    totals = sited.groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: bare(x) != ""), lambda x: F.xxhash64(bare(x))))
    counts = sited.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter("n > 1")
    return counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("__lines"))


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, lines_name: str = "n_lines", dropped_name: str = "n_dropped", counted: DataFrame | None = None) -> DataFrame:
    """``pages`` with the boilerplate lines gone from their text, the lines it had, and those dropped.  Lines are counted on all of
    ``pages``, or on the rows of ``counted`` if given."""
    store = Scratch(pages.sparkSession, "lines")
    found = store.write(boilerplate(pages if counted is None else counted, host, text_col, ratio), "boilerplate")
    kept = [c for c in pages.columns if c not in (lines_name, dropped_name)]
    sited = pages.select(*kept, F.coalesce(host.cast("string"), F.lit("")).alias("__host"))
    size = found.agg(F.sum(F.size("__lines") + 8)).first()[0] or 0
    small = F.broadcast(found) if size <= 1_000_000 else found  # 8 bytes each: 8 MB at most
    joined = sited.join(small.withColumnRenamed("host", "__host"), "__host", "left")
    split = F.split(F.col(text_col), "\n")
    left = F.filter(split, lambda x: ~F.array_contains("__lines", F.xxhash64(bare(x))))
    text = F.when(F.col("__lines").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    out = joined.withColumn("__text", text)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split))
    gone = F.when(F.col("__lines").isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(split) - F.size(left))
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(c) for c in kept], n_lines.cast("long").alias(lines_name), gone.cast("long").alias(dropped_name))
