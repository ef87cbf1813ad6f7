"""Links between pages: parsing, resolution, anchors, and prose bridges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import MARKDOWN_LINK, WIKI_LINK, anchor, blank_code, leaf, let, link_anchor, link_target, page_name, prose, sentences, spans, stem, strip
from lorewell.operators.resolve import holding

#: Words that connect no two pages (fixed values).
GLUE = ("and", "or", "the", "with", "for", "from", "into", "onto")


def parse_links(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, start, kind (wiki, markdown), raw, target, anchor, display: every internal link outside of code, images apart, with its place
    in the text."""
    clean = docs.select(*keys, blank_code(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    of = lambda kind, pattern: F.transform(spans(F.col("_t"), pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["raw"].alias("raw")))
    found = clean.select(*keys, F.inline(F.concat(of("wiki", WIKI_LINK), of("markdown", MARKDOWN_LINK))))
    wiki = F.col("kind") == "wiki"
    part = lambda i: F.regexp_extract("raw", WIKI_LINK, i)
    url = F.regexp_extract("raw", MARKDOWN_LINK, 2)
    page = F.when(wiki, part(1)).otherwise(F.regexp_replace(url, "#.*$", ""))
    shown = F.when(wiki, F.when(part(3) != "", part(3)).otherwise(part(1))).otherwise(F.regexp_extract("raw", MARKDOWN_LINK, 1))
    out = found.select(*keys, "start", "kind", "raw", link_target(page).alias("target"), strip(F.when(wiki, part(2)).otherwise(link_anchor(url))).alias("anchor"), strip(shown).alias("display"))
    return out.filter("target <> ''")


def resolve(links: DataFrame, pages: DataFrame, target: str = "target") -> DataFrame:
    """Links with the page (to_source, to_filename) they mean: the one with that path, else the only one with
    that base name, ignoring case; several candidates at a stage, and the link stays unresolved."""
    low = F.lower(F.regexp_replace(F.col(target), r"^(knowledge|canon)[:/]", ""))
    named = links.withColumn("_path", low).withColumn("_base", F.element_at(F.split(low, "/"), -1))
    by_path = pages.groupBy(F.lower("filename").alias("_path")).agg(F.count("*").alias("n1"), F.min(F.struct("source", "filename")).alias("p1"))
    by_base = pages.groupBy(F.lower(F.element_at(F.split("filename", "/"), -1)).alias("_base")).agg(F.count("*").alias("n2"), F.min(F.struct("source", "filename")).alias("p2"))
    hit = F.when(F.col("n1") == 1, F.col("p1")).when(F.col("n1") > 1, None).when(F.col("n2") == 1, F.col("p2"))
    return named.join(by_path, "_path", "left").join(by_base, "_base", "left").withColumn("_hit", hit).select(*links.columns, F.col("_hit.source").alias("to_source"), F.col("_hit.filename").alias("to_filename"))


def broken(links: DataFrame, pages: DataFrame) -> DataFrame:
    return resolve(links, pages).filter("to_filename is null").drop("to_source", "to_filename")


def link_edges(chunks: DataFrame, pages: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """References of weight 1 from chunks (id, source, filename, heading, chunk_index, content) to the first chunk
    of the target page whose heading fits the anchor, else to the page's first chunk; none to itself.  ``parsed``: the links (id, ...), where they are
    kept; ``chunks`` then needs no content.  Goals are found once for each page and anchor, however many links there are."""
    found = parse_links(chunks, ["id"], "content") if parsed is None else parsed
    links = resolve(found, pages).filter("to_filename is not null").withColumn("_a", anchor(F.col("anchor")))
    page = ["to_source", "to_filename"]
    norm, tail = anchor(F.col("heading")), anchor(leaf(F.col("heading")))
    goals = chunks.select(F.col("id").alias("dst"), F.col("source").alias("to_source"), F.col("filename").alias("to_filename"), F.col("chunk_index").alias("pos"), norm.alias("_h"), tail.alias("_l"))
    a = F.col("_a")
    fits = (a != "") & ((F.col("_h") == a) | (F.col("_l") == a) | F.col("_h").contains(a))
    best = links.select(*page, "_a").distinct().join(goals, page).groupBy(*page, "_a").agg(F.min_by("dst", F.struct(~F.coalesce(fits, F.lit(False)), "pos", "dst")).alias("dst"))
    met = links.join(best, [*page, "_a"]).filter("id <> dst")
    first = F.row_number().over(Window.partitionBy("id", "dst").orderBy("start", "raw"))
    out = met.withColumn("_k", first).filter("_k = 1")
    text = F.when(F.col("display") != "", F.col("display")).otherwise(F.regexp_replace("target", r"\.md$", ""))
    return out.select(F.col("id").alias("src"), "dst", F.lit("references").alias("edge_type"), F.lit(1.0).alias("weight"), text.alias("link_text"), F.col("kind").alias("link_kind"), F.col("to_filename").alias("target_file"), F.col("anchor").alias("target_anchor"))


def link_names(target: Column) -> Column:
    """struct<path, base>: the names by which ``resolve`` looks a target up."""
    low = F.lower(F.regexp_replace(target, r"^(knowledge|canon)[:/]", ""))
    return F.struct(low.alias("path"), F.element_at(F.split(low, "/"), -1).alias("base"))


def page_aliases(pages: DataFrame) -> DataFrame:
    """(alias, source, filename): names of at least three characters; a name of several pages means the first."""
    names = F.array(stem(F.col("filename")), F.coalesce(F.col("title"), F.lit(""))) if "title" in pages.columns else F.array(stem(F.col("filename")))
    every = pages.select("source", "filename", F.explode(F.array_distinct(F.transform(names, page_name))).alias("alias")).filter(F.length("alias") >= 3)
    return every.groupBy("alias").agg(F.min(F.struct("source", "filename")).alias("p")).select("alias", "p.source", "p.filename")


def _sentences(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, sentence_no, sentence, _w: the sentences of the prose, with their words in lower case."""
    own = texts.select(*keys, F.posexplode_outer(sentences(prose(F.coalesce(F.col(text), F.lit(""))))).alias("sentence_no", "sentence")).filter("sentence_no is not null")
    return own.withColumn("_w", F.regexp_extract_all(F.lower(F.regexp_replace("sentence", r"[-_]", " ")), F.lit(r"[\p{L}\p{N}]+"), 0))


#: Names that are looked up within a sentence, as a set that comes with the plan, and characters of these; beyond, by joins.
FEW_NAMES, FEW_CHARS = 20_000, 1 << 20


def _settled(texts: DataFrame, keys: list[str], aliases: DataFrame, text: str, longest: int, few: int) -> tuple[DataFrame, DataFrame] | None:
    """Sentences with their settled mentions (_hits: at, end, alias, in order), and the names as a small table; nothing if there are more than ``few`` names."""
    own = _sentences(texts, keys, text)
    size = F.size(F.split("alias", " "))
    found = aliases.select("alias", "source", "filename", size.alias("n")).limit(few + 1).collect()
    if len(found) > few or sum(len(r["alias"]) for r in found) > FEW_CHARS:
        return None
    if not found:
        own = own.limit(0)
    most = min(longest, max((r["n"] for r in found), default=1))
    names, first = [r["alias"] for r in found] or [""], sorted({r["alias"].split(" ")[0] for r in found}) or [""]
    w = F.col("_w")
    starts = F.filter(F.transform(w, lambda x, i: F.when(x.isin(first), i + 1)), lambda at: at.isNotNull())
    runs = lambda at: F.transform(F.sequence(F.least(F.lit(most), F.size(w) - at + 1), F.lit(1), F.lit(-1)), lambda n: F.struct(at.alias("at"), (at + n - 1).alias("end"), F.array_join(F.slice(w, at, n), " ").alias("alias")))
    hits = F.filter(F.flatten(F.transform(starts, runs)), lambda x: x["alias"].isin(names))
    # of a start's hits the longest comes first; a hit goes if one before it, which cannot begin more than ``most`` words before, ends at its start or behind
    within = lambda hs, x, i: F.exists(F.slice(hs, F.greatest(i + 1 - most * most, F.lit(1)), F.least(i, F.lit(most * most))), lambda y: y["end"] >= x["at"])
    settled = let(hits, lambda hs: F.filter(hs, lambda x, i: ~within(hs, x, i))) if most > 1 else hits
    pages = texts.sparkSession.createDataFrame([(r["alias"], r["source"], r["filename"]) for r in found], "alias string, source string, filename string")
    return own.withColumn("_hits", settled), pages


def mentions(texts: DataFrame, keys: list[str], aliases: DataFrame, text: str = "content", longest: int = 6, few: int = FEW_NAMES) -> DataFrame:
    """keys, sentence_no, sentence, _w, at, end, alias, source, filename: pages named in sentences, by runs of up to ``longest`` words; a mention within, or
    begun within, another goes.

    Only at words that some name begins with are runs put together, of no more words than the longest such name has.  Up to ``few`` names are
    looked up and settled sentence by sentence, without a shuffle, and sentences without a name end there.  More names than that meet the
    places (not the sentences) by joins: first words first, then the runs, and the hits fetch their sentence."""
    known = _settled(texts, keys, aliases, text, longest, few)
    if known is not None:
        settled, pages = known
        named = settled.select(*keys, "sentence_no", "sentence", "_w", F.explode_outer("_hits").alias("x")).filter("x is not null").select(*keys, "sentence_no", "sentence", "_w", "x.at", "x.end", "x.alias")
        return named.join(F.broadcast(pages), "alias").select(*keys, "sentence_no", "sentence", "_w", "at", "end", "alias", "source", "filename")
    own = _sentences(texts, keys, text)
    size = F.size(F.split("alias", " "))
    heads = aliases.groupBy(F.split_part("alias", F.lit(" "), F.lit(1)).alias("head")).agg(F.max(size).alias("most"))
    places = own.select(*keys, "sentence_no", F.posexplode("_w").alias("pos", "head")).join(heads, "head")
    back = lambda left: [F.col(f"{left}.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "sentence_no")]
    sized = F.explode(F.sequence(F.lit(1), F.least(F.col("p.most"), F.lit(longest), F.size("s._w") - F.col("p.pos"))))
    runs = places.alias("p").join(own.alias("s"), back("p")).select(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.sentence_no").alias("sentence_no"), (F.col("p.pos") + 1).alias("at"), F.col("s._w").alias("_w"), sized.alias("n"))
    named = runs.select(*keys, "sentence_no", "at", (F.col("at") + F.col("n") - 1).alias("end"), F.array_join(F.slice("_w", F.col("at"), F.col("n")), " ").alias("alias")).join(aliases, "alias")
    w = Window.partitionBy(*keys, "sentence_no").orderBy("at", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = named.withColumn("_far", F.max("end").over(w)).filter("_far is null or at > _far").drop("_far")
    return kept.alias("k").join(own.alias("s"), back("k")).select(*[F.col(f"k.{k}").alias(k) for k in keys], F.col("k.sentence_no").alias("sentence_no"), "s.sentence", "s._w", "k.at", "k.end", "k.alias", "k.source", "k.filename")


def bridged(texts: DataFrame, keys: list[str], aliases: DataFrame, text: str = "content", longest: int = 6, few: int = FEW_NAMES) -> DataFrame:
    """``bridges`` of the ``mentions`` in texts.  Up to ``few`` names are settled and paired sentence by sentence, and only pairs without their sentence's words are shuffled.
    There every name's first mention is a subject, of which a page has several: the first of these is among them."""
    known = _settled(texts, keys, aliases, text, longest, few)
    if known is None:
        return bridges(mentions(texts, keys, aliases, text, longest, few), keys)
    settled, pages = known
    connecting = lambda named: F.filter(F.transform("_w", lambda x, i: F.when(x.rlike("^[a-z]{3,}$") & ~x.isin(*GLUE) & ~F.array_contains(named, x), i + 1)), lambda at: at.isNotNull())
    subject = lambda name, places: let(F.get(F.filter("_hits", lambda x: x["alias"] == name), 0), lambda x: F.struct(x["at"].alias("at"), name.alias("alias"), F.get(F.filter(places, lambda p: p > x["end"]), 0).alias("after")))
    named = F.when(F.size("_hits") > 1, F.array_distinct(F.transform("_hits", lambda x: x["alias"])))
    subjects = let(named, lambda names: F.when(F.size(names) > 1, let(connecting(names), lambda places: F.transform(names, lambda n: subject(n, places)))))
    begun = settled.select(*keys, "sentence_no", "sentence", "_hits", F.explode_outer(subjects).alias("s")).filter("s.after is not null")
    later = F.filter("_hits", lambda x: (x["at"] > F.col("s.after")) & (x["alias"] != F.col("s.alias")))
    met = begun.select(*keys, "sentence_no", "sentence", "s", F.explode_outer(later).alias("b")).filter("b is not null").select(*keys, "sentence_no", F.left("sentence", F.lit(500)).alias("evidence"), F.col("s.at").alias("at"), F.col("b.at").alias("at_b"), F.col("s.alias").alias("subject_match"), F.col("b.alias").alias("object_match"))
    side = lambda k: F.broadcast(pages.select(F.col("alias").alias(f"{k}_match"), F.col("source").alias(f"{k}_source"), F.col("filename").alias(f"{k}_file")))
    pairs = met.join(side("subject"), "subject_match").join(side("object"), "object_match").filter((F.col("subject_file") != F.col("object_file")) | (F.col("subject_source") != F.col("object_source")))
    return _first_of_pairs(pairs, keys)


def bridges(found: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered pairs of different pages in a sentence with a connecting word between them, one for
    each pair and text: the first sentence.  A connecting word has three letters and is neither glue nor another mention of the sentence.

    Of a page that a sentence names again and again only the first mention can be a subject (what connects a later one connects it, too), and it meets
    what is named after the first connecting word behind it."""
    place = [*keys, "sentence_no"]
    named = found.groupBy(*place).agg(F.collect_set("alias").alias("_named"))  # names of one sentence
    subjects = found.groupBy(*place, "source", "filename").agg(F.min_by(F.struct("sentence", "_w", "at", "end", "alias"), "at").alias("f")).select(*place, "source", "filename", "f.*")
    same = lambda x, y, cols: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in cols]
    behind = F.slice(F.col("a._w"), F.col("a.end") + 1, F.size("a._w"))
    connects = F.transform(behind, lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin(*GLUE) & ~F.array_contains(F.col("n._named"), x))
    first = F.array_position(connects, True)  # 0: none
    begun = subjects.alias("a").join(named.alias("n"), same("a", "n", place)).select("a.*", F.when(first > 0, F.col("a.end") + first).alias("_after")).filter("_after is not null").drop("_w")
    later = found.select(*place, "at", "alias", "source", "filename")
    on = [*same("a", "b", place), F.col("b.at") > F.col("a._after")]
    pairs = begun.alias("a").join(later.alias("b"), on).filter((F.col("a.filename") != F.col("b.filename")) | (F.col("a.source") != F.col("b.source")))
    pairs = pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.sentence_no").alias("sentence_no"), F.col("a.sentence").alias("evidence"), F.col("a.at").alias("at"), F.col("b.at").alias("at_b"), F.col("a.source").alias("subject_source"), F.col("a.filename").alias("subject_file"), F.col("b.source").alias("object_source"), F.col("b.filename").alias("object_file"), F.col("a.alias").alias("subject_match"), F.col("b.alias").alias("object_match"))
    return _first_of_pairs(pairs, keys)


def _first_of_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    best = F.min_by(F.struct("evidence", "subject_match", "object_match"), F.struct("sentence_no", "at", "at_b"))
    return pairs.groupBy(*keys, "subject_source", "subject_file", "object_source", "object_file").agg(best.alias("f")).select(*keys, "subject_source", "subject_file", "object_source", "object_file", F.left("f.evidence", F.lit(500)).alias("evidence"), "f.subject_match", "f.object_match")


def mention_pattern(name: str) -> str:
    """A pattern (ignoring case) for whole-word mentions of a page's name; hyphens, underscores and spaces are one."""
    parts = [p for p in re.split(r"[-_\s]+", name.strip()) if p]
    return r"(?i)(?<!\w)" + r"[-_\s]+".join(re.escape(p) for p in parts) + r"(?!\w)" if parts else "(?!x)x"


def prose_edges(chunks: DataFrame, aliases: DataFrame, goals_in: DataFrame | None = None) -> DataFrame:
    """References of weight 0.5 from a chunk to the first chunk of a page that its own page is bridged with; that is among ``goals_in`` where
    ``chunks`` are some of all chunks."""
    keys = ["id", "own_source", "own_file"]
    own = chunks.select("id", F.col("source").alias("own_source"), F.col("filename").alias("own_file"), "content")
    found = bridged(own, keys, aliases)
    subject = (F.col("subject_file") == F.col("own_file")) & (F.col("subject_source") == F.col("own_source"))
    object_ = (F.col("object_file") == F.col("own_file")) & (F.col("object_source") == F.col("own_source"))
    other = F.when(subject, F.struct(F.col("object_source").alias("source"), F.col("object_file").alias("filename"))).when(object_, F.struct(F.col("subject_source").alias("source"), F.col("subject_file").alias("filename")))
    everything = chunks if goals_in is None else goals_in
    goals = found.withColumn("o", other).filter("o is not null").select("id", "o.source", "o.filename", "evidence")
    first = everything.groupBy("source", "filename").agg(F.min_by("id", "chunk_index").alias("dst"))
    out = goals.join(first, ["source", "filename"]).filter("id <> dst").groupBy("id", "dst").agg(F.min("evidence").alias("evidence"), F.min("filename").alias("target_file"))
    return out.select(F.col("id").alias("src"), "dst", F.lit("references").alias("edge_type"), F.lit(0.5).alias("weight"), "evidence", F.lit("prose").alias("link_kind"), "target_file")


def heading_edges(chunks: DataFrame, most_files: int = 3) -> DataFrame:
    """inter_file edges of weight 0.65 between chunks of different files under the same last heading, where 2 to
    ``most_files`` files have it; each unordered pair once, from the smaller id."""
    own = chunks.select("id", "filename", F.lower(leaf(F.col("heading"))).alias("h")).filter("h <> ''")
    few = own.groupBy("h").agg(F.countDistinct("filename").alias("n")).filter(F.col("n").between(2, most_files)).select("h")
    rows = own.join(few, "h")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.filename") != F.col("b.filename")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit("inter_file").alias("edge_type"), F.lit(0.65).alias("weight"), F.col("a.h").alias("evidence"))


def hierarchy_edges(chunks: DataFrame) -> DataFrame:
    """parent_child edges of weight 1 from the first chunk of the file whose heading holds a chunk's heading path less its
    last part.

    Sections are looked up once for each different upper path of a file, among those of its different headings that share the path's rarest run of
    characters (``resolve.holding``): two hits are enough, as only the chunk itself can be passed over."""
    file = ["source", "filename"]
    kids = chunks.select(F.col("id").alias("dst"), *file, F.lower(F.regexp_extract("heading", "^(.*) > ", 1)).alias("up")).filter("up <> ''")
    heads = chunks.select(F.col("id").alias("src"), *file, F.lower("heading").alias("h"), "chunk_index")
    first_two = lambda rows, by: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*file, by).orderBy("chunk_index", "src"))).filter("_n <= 2").drop("_n")
    pairs = holding(kids.select(*file, "up").distinct(), "up", first_two(heads, "h"), "h", tuple(file), sizes=(1, 2, 3, 8))
    met = kids.join(first_two(pairs, "up"), [*file, "up"]).filter(F.col("src") != F.col("dst"))
    return met.groupBy("dst").agg(F.min_by("src", F.struct("chunk_index", "src")).alias("src")).select("src", "dst", F.lit("parent_child").alias("edge_type"), F.lit(1.0).alias("weight"))
