"""A corpus pipeline of five operators.  Each stage is written as Parquet and read again as the next one's ``docs``.

Stages work on every row their predecessor kept and, but for the last, return the columns of documents.  An empty table
gives an empty table; rows may repeat, ids may be null or repeat: rows are judged one by one; texts are taken whole, however
long; further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.langid import identify, train
from lorewell.llm.line_dedup import drop_boilerplate
from lorewell.llm.mixing import mix_sources
from lorewell.llm.ngram_join import similar_documents
from lorewell.llm.packing import pack_documents
from lorewell.llm.queries import tokenizer_path
from lorewell.llm.scratch import Scratch

#: What packing holds at a time, in a worker: the executors' heaps have grown in the stages before, and what is left is shared by the workers.
PACKING_MEMORY = {"group_chars": 1 << 19, "cache_words": 50_000, "batch_bytes": 2 << 20}
#: Below this probability of the best language a document is rejected, as is one without letters.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model learns from the labelled ones.  A null or empty text, or one without a
    letter, goes; a null language is not learned from; equal texts get equal answers."""
    marked = identify(docs, train(docs), "text", "__lang", "__score")
    return marked.filter((F.col("__lang") != "und") & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def _pairs(lines: Column) -> Column:
    """Hashes of each word of the lines with the one that follows it in its line."""
    words = lambda line: F.filter(F.split(line, "[ \\t\\r]+"), lambda w: w != "")
    return F.flatten(F.transform(lines, lambda line: F.transform(words(line), lambda w, i: F.xxhash64(w, F.get(words(line), i + 1)))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of each source (null: the source '').  Lines are counted on the different texts of a source, so
    that copies, which the next stage settles, do not turn their own lines into boilerplate.  Near copies do: a text stays whole where at
    least two lines and most of it would go, and what remains is hardly its own, that is where at most a ninth as many pairs of words as it has
    words are in none of the lines that go from such texts of its source (two texts that share eight ninths are
    similar by 0.8, so the next stage takes them for one).  Pages under one menu have more of their own, and lose it.  Documents of which nothing
    is left go; a null or empty text has no lines and stays."""
    store = Scratch(spark, "copied")
    whole, text, dropped, host = F.col("__stage_whole"), F.col("text"), F.col("__stage_dropped"), F.coalesce(F.col("source").cast("string"), F.lit(""))
    done = drop_boilerplate(docs.withColumn("__stage_whole", text), F.col("source"), lines_name="__stage_lines", dropped_name="__stage_dropped", counted=docs.select("source", "text").distinct())
    suspect = (dropped > 1) & (2 * F.length(text) <= F.length(whole))
    gone = F.array_except(F.split(whole, "\n"), F.split(text, "\n"))
    pairs = done.filter(suspect).select(host.alias("__stage_host"), F.explode(F.array_distinct(_pairs(gone))).alias("pair")).distinct()
    known = store.write(pairs.groupBy("__stage_host").agg(F.collect_list("pair").alias("__stage_known")), "known")  # of boilerplate lines: their number is bounded by the ratio
    size = known.agg(F.sum(F.size("__stage_known") + 8)).first()[0] or 0
    joined = done.withColumn("__stage_host", host).join(F.broadcast(known) if size <= 1_000_000 else known, "__stage_host", "left")  # 8 bytes each: 8 MB at most
    own = F.size(F.array_except(_pairs(F.split(text, "\n")), F.coalesce("__stage_known", F.array().cast("array<bigint>"))))
    copied = F.when(suspect, 9 * own <= F.size(_pairs(F.split(whole, "\n")))).otherwise(False)
    judged = joined.withColumn("__stage_copied", copied).filter(F.col("__stage_copied") | (dropped == 0) | dropped.isNull() | text.rlike("\\S"))
    kept = F.col("__stage_copied")
    n_chars = F.when(kept | (dropped == 0), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return judged.select(*[F.when(kept, whole).otherwise(text).alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five words, a similarity of 0.8 or more).  Documents without a word, null
    texts among them, are similar to none; of equal texts one row stays."""
    store = Scratch(spark, "kept")
    row = "__stage_row"  # ids may be null or stand in several rows: the decision comes back by row
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    if docs._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() != "LogicalRelation":
        keyed = store.write(keyed, "rows")  # rows of files that are read as they are have the same number each time
    found = similar_documents(keyed.select(row, "text"), id_col=row, width=5, percent=80)
    kept = store.write(found.filter("kept").select(F.col("doc_id").alias(row)), "found")
    return keyed.join(kept, row, "left_semi").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it.  Documents without a word, null texts among them, come once a whole epoch;
    rows with equal id are taken together."""
    taken = mix_sources(docs).filter("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null text is
    empty and has its closing id only; repeated rows are packed one by one; equal lengths may change places."""
    return pack_documents(docs, tokenizer_path(), **PACKING_MEMORY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: SQL cannot express the learned model nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
