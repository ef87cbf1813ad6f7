"""Markdown structure: headings, sections, chunks, and token windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import token_count
from lorewell.functions.tokens import DEFAULT, Encoder

MAX_TOKENS, OVERLAP = 8000, 50
CHUNK_SCHEMA = "source string, filename string, heading string, content string, chunk_index long, token_count long, total_chunks long, doc_summary string"

_heading = re.compile(r"(#{1,5})[ \t]+(.*\S)[ \t]*$")


# --- line-based relational operators -----------------------------------------------------------


def lines_of(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line: keys, line_no from 0, line."""
    return docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def markdown_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines with level (1 to 6 for headings outside of fenced code, else null) and title."""
    rows = lines_of(docs, keys, text)
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.coalesce(F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(w), F.lit(0))
    is_heading = (fence % 2 == 0) & F.col("line").rlike(r"^#{1,6}[ \t]+\S")
    return rows.withColumn("level", F.when(is_heading, F.length(F.regexp_extract("line", "^(#+)", 1)))).withColumn("title", F.when(is_heading, F.regexp_extract("line", r"^#+[ \t]+(.*\S)\s*$", 1)))


def sections(rows: DataFrame, keys: list[str], starts: Column) -> DataFrame:
    """Lines with the number of their section: how many section starts there are up to this line."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def heading_tree(headings: DataFrame, keys: list[str], levels: int = 6) -> DataFrame:
    """Headings (keys, ord, level) with parent_ord, the nearest one before of a smaller level, and end_ord, the
    next one of no greater level (null at the end)."""
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    last = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(before) for k in range(1, levels + 1)]
    following = [F.min(F.when(F.col("level") == k, F.col("ord"))).over(after) for k in range(1, levels + 1)]
    out = headings.select("*", *[c.alias(f"_l{k + 1}") for k, c in enumerate(last)], *[c.alias(f"_n{k + 1}") for k, c in enumerate(following)])
    parent, end = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in range(levels, 0, -1):
        less, upto = [F.col(f"_l{i}") for i in range(1, k)], [F.col(f"_n{i}") for i in range(1, k + 1)]
        parent = F.when(F.col("level") == k, F.greatest(*less) if len(less) > 1 else less[0] if less else F.lit(None)).otherwise(parent)
        end = F.when(F.col("level") == k, F.least(*upto) if len(upto) > 1 else upto[0]).otherwise(end)
    return out.select(*headings.columns, parent.alias("parent_ord"), end.alias("end_ord"))


def subtree_sums(tree: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Headings with the sum of ``value`` over themselves and all below: a difference of running sums,
    as a heading's descendants are the headings up to its end."""
    w = Window.partitionBy(*keys).orderBy("ord")
    run = tree.withColumn("_run", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.sum(value).over(Window.partitionBy(*keys))
    run = run.withColumn("_whole", whole)
    ends = run.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ord").alias("_ord"), (F.col("_run") - F.col(value)).alias("_until"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("end_ord") == F.col("_ord")]
    joined = run.join(ends, on, "left")
    return joined.select(*tree.columns, (F.coalesce("_until", "_whole") - (F.col("_run") - F.col(value))).alias(f"subtree_{value}"))


def section_text(docs: DataFrame, keys: list[str], wanted: str, text: str = "text") -> DataFrame:
    """The first section whose heading holds ``wanted`` (ignoring case), up to the next heading of no greater level."""
    rows = markdown_lines(docs, keys, text).withColumn("ord", F.col("line_no"))
    heads = heading_tree(rows.filter("level is not null").select(*keys, "ord", "level", "title"), keys)
    first = heads.filter(F.lower("title").contains(wanted.lower())).groupBy(*keys).agg(F.min_by(F.struct("ord", "end_ord", "title"), "ord").alias("h"))
    inside = rows.join(first, keys).filter((F.col("ord") >= F.col("h.ord")) & F.coalesce(F.col("ord") < F.col("h.end_ord"), F.lit(True)))
    return inside.groupBy(*keys).agg(F.first("h.title").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x.line), "\n").alias("section"))


def find_section(chunks: DataFrame, docs: DataFrame, keys: list[str], wanted: str, text: str = "text") -> DataFrame:
    """keys, heading, section: the first chunk (keys, heading, content, chunk_index) whose heading holds ``wanted``, ignoring case; for
    documents without one, the first such section of the text."""
    hits = chunks.filter(F.lower("heading").contains(wanted.lower())).groupBy(*keys).agg(F.min_by(F.struct("heading", "content"), "chunk_index").alias("h"))
    first = hits.select(*keys, F.col("h.heading").alias("heading"), F.col("h.content").alias("section"))
    rest = docs.join(first.select(*keys), keys, "left_anti")
    return first.unionByName(section_text(rest, keys, wanted, text).select(*keys, "heading", "section"))


def with_summaries(headings: DataFrame, summaries: DataFrame, keys: list[str], title: str = "title") -> DataFrame:
    """Headings with the summary that the index has for them, ignoring case; of several that differ in case only, the last."""
    known = summaries.groupBy(*keys, F.lower("heading").alias("_h")).agg(F.max_by("summary", "heading").alias("summary"))
    return headings.withColumn("_h", F.lower(title)).join(known, [*keys, "_h"], "left").drop("_h")


def token_windows(docs: DataFrame, keys: list[str], size: int, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Windows of ``size`` words, each beginning size - overlap after the one before, up to the first that
    reaches the end: keys, part, n_parts, first, n_tokens, content."""
    step = max(1, size - overlap)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    n = F.size("_w")
    parts = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - size) / step) + 1)).cast("int")
    own = docs.select(*keys, words.alias("_w")).withColumn("n_parts", parts).filter("n_parts > 0")
    out = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    window = F.slice("_w", F.col("part") * step + 1, F.lit(size))
    return out.select(*keys, "part", "n_parts", (F.col("part") * step).alias("first"), F.size(window).alias("n_tokens"), F.array_join(window, " ").alias("content"))


def outline(chunks: DataFrame, most: int = 500) -> DataFrame:
    """Per file: tokens, sections, and its distinct top headings in order, cut at ``most`` characters."""
    top = F.trim(F.split_part("heading", F.lit(" > "), F.lit(1)))
    tops = chunks.withColumn("top", top).groupBy("source", "filename", "top").agg(F.min("chunk_index").alias("pos"))
    listed = tops.groupBy("source", "filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "top"))), lambda x: x.top), " | ").alias("o"))
    sums = chunks.groupBy("source", "filename").agg(F.sum("token_count").alias("file_tokens"), F.count("*").alias("section_count"))
    cut = F.when(F.length("o") > most, F.concat(F.left("o", F.lit(most - 3)), F.lit("..."))).otherwise(F.col("o"))
    return sums.join(listed, ["source", "filename"]).select("source", "filename", "file_tokens", "section_count", cut.alias("file_outline"))


def context_header(filename: Column, index: Column, total: Column, heading: Column, doc_summary: Column) -> Column:
    """What stands above a chunk's text, between rules: file, position, the headings above, and the document's summary if it has one."""
    above = F.when(heading.contains(" > "), F.regexp_replace(heading, "(?s) > (?:(?! > ).)*$", ""))
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("file: "), filename), F.concat(F.lit("position: "), (index + 1).cast("string"), F.lit("/"), total.cast("string")), F.concat(F.lit("ancestors: "), above), F.when(~F.coalesce(doc_summary, F.lit("")).isin("", "(no summary)"), F.concat(F.lit("doc_summary: "), doc_summary)), F.lit("---"))


# --- the chunker: recursive, so a function of one file's text ------------------------------------


@dataclass
class Section:
    heading: str
    body: list[str] = field(default_factory=list)


def split_frontmatter(text: str) -> tuple[dict[str, str], str]:
    """Flat ``key: value`` pairs between --- lines at the top, and the rest; no closing line, no front matter."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return {}, text
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            pairs = (x.partition(":") for x in lines[1:i] if ":" in x)
            return {k.strip(): v.strip() for k, _, v in pairs}, "\n".join(lines[i + 1 :])
    return {}, text


def heading_levels(lines: list[str]) -> list[int]:
    """The level of each line that is a heading (1 to 5), else 0; fenced code has none."""
    out, fenced = [], False
    for line in lines:
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            out.append(0)
        else:
            found = None if fenced else _heading.match(line)
            out.append(len(found[1]) if found else 0)
    return out


def split_at(lines: list[str], level: int) -> list[Section]:
    """Sections that begin with headings of ``level``; what stands before the first is '(preamble)', if not blank."""
    out = [Section("(preamble)")]
    for line, own in zip(lines, heading_levels(lines)):
        if own == level:
            title, leaked = repair_heading(_heading.match(line)[2])
            out.append(Section(title, leaked.split("\n") if leaked else []))
        else:
            out[-1].body.append(line)
    for s in out:
        while s.body and not s.body[-1].strip():
            s.body.pop()
        if s.body and s.body[-1].strip() == "---":
            s.body.pop()
    return [s for s in out if s.heading != "(preamble)" or any(x.strip() for x in s.body)]


def hard_split(text: str, most: int, overlap: int, encoder: Encoder = DEFAULT) -> list[str]:
    """Overlapping parts of at most ``most`` tokens, up to the first that reaches the end."""
    tokens, step, out = encoder.encode(text), max(1, most - overlap), []
    for lo in range(0, max(1, len(tokens)), step):
        out.append(encoder.decode(tokens[lo : lo + most]))
        if lo + most >= len(tokens):
            break
    return out


def repair_heading(heading: str) -> tuple[str, str]:
    r"""(heading, body) of a heading into which a spelled-out \n, \r or \t brought its body."""
    for mark in ("\\n", "\\r", "\\t"):
        head, found, _ = heading.partition(mark)
        if found:
            body = heading[len(head) :].replace("\\n", "\n").replace("\\r", "\n").replace("\\t", "    ")
            return head.rstrip() or "(unknown)", body.lstrip()
    return heading, ""


def chunk_text(text: str, filename: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, encoder: Encoder = DEFAULT) -> list[tuple[str, str]]:
    """(heading path, content) of a markdown file's chunks."""
    count = lambda t: len(encoder.encode(t))
    body = split_frontmatter(text or "")[1].strip()
    if not body:
        return []
    name = filename.rsplit("/", 1)[-1]
    name = name[:-3] if name.endswith(".md") else name
    lines = body.split("\n")
    level = min((x for x in heading_levels(lines) if x), default=0)
    if not level:
        return [(name, part) for part in (hard_split(body, max_tokens, overlap, encoder) if count(body) > max_tokens else [body])]
    out: list[tuple[str, str]] = []

    def walk(path: str, section: Section, own: int) -> None:
        inner = "\n".join(section.body).strip()
        title = path.rsplit(" > ", 1)[-1]
        content = inner if section.heading == "(preamble)" else f"{'#' * own} {title}\n\n{inner}".rstrip()
        if count(content) <= max_tokens:
            out.append((path, content))
            return
        below = min((x for x in heading_levels(section.body) if x), default=0)
        if below > own:
            for s in split_at(section.body, below):
                walk(path if s.heading == "(preamble)" else f"{path} > {s.heading}", s, below)
            return
        parts = hard_split(content, max_tokens, overlap, encoder)
        out.extend((f"{path} (part {i}/{len(parts)})", p) for i, p in enumerate(parts, 1))

    for s in split_at(lines, level):
        walk(s.heading, s, level)
    return out


def first_prose(text: str, most: int = 150) -> str:
    for line in split_frontmatter(text or "")[1].split("\n"):
        line = line.strip()
        if line and not line.startswith(("#", "---", "|", "- [")):
            return line if len(line) <= most else line[:most] + "..."
    return "(no summary)"


def chunk_files(files: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, encoder: Encoder = DEFAULT) -> DataFrame:
    """Chunks of every file (source, filename, text), numbered from 0.  Null text has no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, filename, text in zip(*(c.to_pylist() for c in batch.columns)):
                got = chunk_text(text or "", filename or "", max_tokens, overlap, encoder)
                about = first_prose(text or "")
                out += [(source, filename, h, c, i, len(encoder.encode(c)), len(got), about) for i, (h, c) in enumerate(got)]
            kinds = [*[pa.string()] * 4, *[pa.int64()] * 3, pa.string()]
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["source", "filename", "heading", "content", "chunk_index", "token_count", "total_chunks", "doc_summary"])

    return files.select("source", "filename", "text").mapInArrow(run, CHUNK_SCHEMA)


def oversized(chunks: DataFrame, most: int = 2000, text: str = "content") -> DataFrame:
    return chunks.withColumn("tokens", token_count(F.col(text))).filter(F.col("tokens") > most)
