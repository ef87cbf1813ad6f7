"""Writing pages: validation, front matter, assembly, and link rewriting.  Texts are rows; nothing is a loop over a corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.text import anchor, contents, distinct_ignoring_case, iso_date, leaf, placeholder_host, provenance, stem, strip, url_host, wiki_path

BEGIN, END = "<!-- related:begin -->", "<!-- related:end -->"
CITATION = r"conversation:([A-Za-z0-9_-]+):turn:(\d+)(?:-(\d+))?"


def clean_tags(tags: Column) -> Column:
    """A comma list, or an array of such, as distinct tags."""
    return distinct_ignoring_case(F.flatten(F.transform(tags, lambda t: F.split(t, ","))))


def tag_error(tags: Column) -> Column:
    bad = F.filter(clean_tags(tags), lambda t: t.rlike(r"[\[\]{}:#\n]"))
    return F.when(F.size(clean_tags(tags)) == 0, "no tags").when(F.size(bad) > 0, F.concat(F.lit("bad tag: "), F.get(bad, 0)))


def bad_urls(pages: DataFrame, key: str = "filename", text: str = "content") -> DataFrame:
    """key, url: links to placeholder hosts, each once, without trailing punctuation."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s<>\"')\]}]+"), 0), lambda u: F.regexp_replace(u, r"""[.,;:!?)'"]+$""", ""))
    found = pages.select(key, F.explode(F.array_distinct(urls)).alias("url"))
    return found.filter(placeholder_host(url_host(F.col("url"))))


def citations(pages: DataFrame, key: str = "filename", text: str = "content") -> DataFrame:
    """key, conv_id, first, last: what the section ``## Sources`` cites of conversations."""
    block = F.regexp_extract(text, r"(?ms)^## Sources[ \t]*$(.*?)(?=^## |\z)", 1)
    found = pages.select(key, F.explode(F.regexp_extract_all(block, F.lit(CITATION), 0)).alias("c"))
    part = lambda i: F.nullif(F.regexp_extract("c", CITATION, i), F.lit(""))
    return found.select(key, part(1).alias("conv_id"), part(2).cast("long").alias("first"), F.coalesce(part(3), part(2)).cast("long").alias("last"))


def front_matter(title: Column, tags: Column, created: Column, updated: Column, aliases: Column | None = None) -> Column:
    lines = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(name + ":\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), title), lines("tags", tags), lines("aliases", aliases) if aliases is not None else F.lit(None), F.concat(F.lit("created: "), F.coalesce(created, updated)), F.concat(F.lit("updated: "), updated), F.lit("---"))


def yaml_list(key: str, items: Column) -> Column:
    """A key with its items, one a line, quoted where needed; null without items."""
    item = lambda x: F.when(x.rlike(r"""^['"-]|[:{}\[\]#,&*|>!%\s]"""), F.concat(F.lit('  - "'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.concat(F.lit("  - "), x))
    own = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.when(F.size(own) > 0, F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(own, item), "\n")))


def merged_front(today: Column, tags: Column, aliases: Column, old: dict[str, Column], source: Column | None = None, tier: Column | None = None) -> Column:
    """Front matter to write: aliases and tags with those that the page has already, the day of its making kept, today's as that of the
    last change.  ``old``: columns of the present page's created, date_created, tags, aliases, source, tier and project, as far as it has them."""
    have = lambda k, kind="string": old[k] if k in old else F.lit(None).cast(kind)
    both = lambda new, k: distinct_ignoring_case(F.concat(F.coalesce(F.lit(None).cast("array<string>") if new is None else new, F.array().cast("array<string>")), F.coalesce(have(k, "array<string>"), F.array().cast("array<string>"))))
    day = F.coalesce(iso_date(have("created")), have("created"), iso_date(have("date_created")), have("date_created"), today)
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    named = lambda k, given, default: F.coalesce(F.nullif(have(k), F.lit("")), given if given is not None else F.lit(default))
    return F.concat_ws("\n", F.lit("---"), yaml_list("aliases", both(aliases, "aliases")), yaml_list("tags", both(tags, "tags")), line("created", day), line("updated", today), line("source", named("source", source, "knowledge")), line("tier", named("tier", tier, "wiki")), line("project", F.nullif(have("project"), F.lit(""))), F.lit("---"))


def parse_front_matter(text: str | None) -> tuple[dict, str]:
    """(values, body) of the YAML at a text's top: scalars, quoted or plain, and lists in either form.  What can't be read is
    no front matter."""
    if not text or not text.startswith("---"):
        return {}, text or ""
    parts = text.split("---", 2)
    if len(parts) < 3:
        return {}, text
    out: dict = {}
    key = None
    for line in parts[1].split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s*- (.*)$", line)
        pair = re.match(r"([^\s:#-][^:]*):(?:\s+(.*)|\s*)$", line)
        if item and key is not None and isinstance(out.get(key), list | None):
            out[key] = [*(out[key] or []), _scalar(item[1])]
        elif pair:
            key, value = pair[1].strip(), (pair[2] or "").strip()
            inner = re.fullmatch(r"\[(.*)\]", value)
            out[key] = [_scalar(x) for x in _items(inner[1])] if inner else _scalar(value) if value else None
        else:
            return {}, text
    return out, parts[2].strip()


def _items(inner: str) -> list[str]:
    return [x for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)\s*(?:,|$)""", inner) if x.strip()]


def _scalar(x: str) -> str:
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] == '"':
        return re.sub(r"\\(.)", r"\1", x[1:-1])
    if len(x) > 1 and x[0] == x[-1] == "'":
        return x[1:-1].replace("''", "'")
    return re.sub(r"\s+#.*$", "", x)


def front_matter_of(text: Column) -> Column:
    """struct<meta, body>: front matter as a map of lists of strings (a scalar is a list of one), and the text below it."""

    @F.udf("meta map<string,array<string>>, body string", useArrow=True)
    def run(t: str):
        meta, body = parse_front_matter(t)
        return {"meta": {k: [] if v is None else [str(x) for x in v] if isinstance(v, list) else [str(v)] for k, v in meta.items()}, "body": body}

    return run(text)


def citation_lines(hits: DataFrame, page: str, most: int = 5) -> DataFrame:
    """rank, line: canon hits (rank, filename, heading) as links that can be copied into a wiki page."""
    name = F.initcap(F.replace(stem(F.col("filename")), F.lit("-"), F.lit(" ")))
    frag = anchor(leaf(F.coalesce("heading", F.lit(""))))
    href = F.concat(canon_href(F.lit(page), F.col("filename")), F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""))
    return hits.filter(F.trim("filename") != "").orderBy("rank").limit(most).select("rank", F.concat(F.lit("- ["), name, F.lit("]("), href, F.lit(")")).alias("line"))


def dividers(body: Column) -> Column:
    """A rule above every second-level heading but one at the top or below a rule."""
    return F.regexp_replace(body, r"(?<!---)\n\n+(## )", "\n\n---\n\n$1")


def assemble(front: Column, title: Column, body: Column) -> Column:
    toc = contents(body)
    return F.concat_ws("\n\n", front, F.concat(F.lit("# "), title), F.when(toc != "", toc), dividers(strip(body)))


def with_related(body: Column, block: Column) -> Column:
    """The body with its related block put in or replaced; without a block it goes."""
    bare = F.regexp_replace(body, rf"(?s)\n*{re.escape(BEGIN)}.*?{re.escape(END)}", "")
    return F.when(F.coalesce(block, F.lit("")) == "", bare).otherwise(F.concat(bare, F.lit("\n\n" + BEGIN + "\n"), block, F.lit("\n" + END)))


def related_block(related: DataFrame) -> DataFrame:
    """node_source, node_file, block: the related files as wiki links, in order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "neighbor_file")))
    link = lambda x: F.concat(F.lit("- [["), F.regexp_replace(x.neighbor_file, r"\.md$", ""), F.lit("]]"))
    return related.groupBy("node_source", "node_file").agg(F.array_join(F.transform(listed, link), "\n").alias("block"))


def wiki_links(body: Column) -> Column:
    """Markdown links to wiki or memory pages as wiki links; images, external and canon links, and code spans stay."""
    return F.regexp_replace(body, r"(?<![!`])\[([^\[\]]+)\]\((?:\./|/)?((?:wiki|memory)/[^()\s#]+?)(?:\.md)?(#[^()\s]*)?\)(?!`)", "[[$2$3|$1]]")


def canon_href(page: Column, target: Column) -> Column:
    """The relative address of a canon file from a wiki page."""
    return F.concat(F.repeat(F.lit("../"), F.size(F.split(page, "/"))), F.lit("canon/"), target)


def plan_writes(pages: DataFrame, canon: DataFrame) -> DataFrame:
    """pages (filename, content, tags) with path and error: bad path, bad tags, or a plain name that canon has."""
    base = canon.select(F.lower(F.element_at(F.split("filename", "/"), -1)).alias("_base")).distinct().withColumn("_taken", F.lit(True))
    own = pages.withColumn("_p", wiki_path(F.col("filename"))).withColumn("_base", F.when(~F.col("filename").contains("/"), F.lower(F.element_at(F.split("_p.path", "/"), -1))))
    joined = own.join(base, "_base", "left")
    error = F.coalesce(F.col("_p.error"), tag_error(F.col("tags")), F.when(F.col("_taken"), "canon has a page of this name"))
    return joined.withColumn("path", F.when(error.isNull(), F.col("_p.path"))).withColumn("error", error).drop("_p", "_base", "_taken")


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edges with a text of how they came about."""
    have = set(edges.columns)
    get = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    return edges.withColumn("provenance", provenance(get("link_kind"), get("link_text"), get("target_anchor"), get("intra_rank", "int"), get("intra_total", "int"), get("evidence")))


def cut_at_sentence(text: str | None, most: int) -> str | None:
    """A head of about ``most`` characters that ends well: at a paragraph, else a sentence, line or word, as long as
    that keeps a quarter; else it goes on to the next space, or is cut."""
    if text is None or len(text) <= most:
        return text
    head = text[:most]
    for mark in ("\n\n", ". ", "? ", "! ", ".\n", "?\n", "!\n", "\n", " "):
        at = head.rfind(mark)
        if at > most // 4:
            return head[: at + len(mark)].rstrip()
    at = text.find(" ", most)
    return text[:at] if 0 <= at < 2 * most else head


@F.udf(T.StringType(), useArrow=True)
def sentence_cut(text: str, most: int) -> str:
    return cut_at_sentence(text, most)


def section_load(text: Column, most_chars: int = 48_000) -> Column:
    """struct<content, state>: a section for reading, cut at a sentence."""
    return F.struct(F.when(F.length(text) > most_chars, sentence_cut(text, F.lit(most_chars))).otherwise(text).alias("content"), F.when(F.length(text) > most_chars, "TRUNCATED").otherwise("COMPLETE").alias("state"))
