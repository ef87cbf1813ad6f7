"""Resolving what a user or a text names: files, sections, entities; all as prioritized lookups in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import conversation_ref, leaf, query_of_file, slug, slug_of_file, slug_of_talk, token_count
from lorewell.functions.tokens import Encoder, slice_tokens
from lorewell.functions.vectors import cosine
from lorewell.operators.vector_search import search

ENTITY_SCHEMA = "chunk_id string, kind string, name string, other string, relation string"


def _grams(text: str, size: int) -> Column:
    """The different runs of ``size`` characters of a text; none of a shorter one."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(F.col(text), i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def meeting(asked: DataFrame, needle: str, rows: DataFrame, hay: str, by: tuple[str, ...] = (), sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Pairs of ``asked`` and ``rows``, of equal columns ``by``, that share the needle's rarest run of characters.  A needle has the runs of the greatest of ``sizes``
    that it is long enough for: each run's posting list is as long as the rows that hold it, and a needle meets only its shortest list.  An
    empty needle, and one with a run that no row holds, meet nothing."""
    own = F.array().cast("array<string>")
    for size in sorted(sizes):
        own = F.when(F.length("_needle") >= size, _grams("_needle", size)).otherwise(own)
    runs = asked.select(*by, F.col(needle).alias("_needle")).distinct().select(*by, "_needle", F.explode(own).alias("_g"))
    posted = rows.withColumn("_g", F.explode(F.concat(*[_grams(hay, size) for size in sizes])))
    sizes_of = posted.select(*by, "_g").join(runs.select(*by, "_g").distinct(), [*by, "_g"], "left_semi").groupBy(*by, "_g").agg(F.count("*").alias("_m"))
    rarest = runs.join(sizes_of, [*by, "_g"], "left").groupBy(*by, "_needle").agg(F.min(F.struct(F.coalesce("_m", F.lit(0)).alias("m"), "_g")).alias("r")).filter("r.m > 0").select(*by, "_needle", "r._g")
    return asked.withColumn("_needle", F.col(needle)).join(rarest, [*by, "_needle"]).drop("_needle").join(posted, [*by, "_g"]).drop("_g")


def holding(asked: DataFrame, needle: str, rows: DataFrame, hay: str, by: tuple[str, ...] = (), sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Pairs of ``asked`` and ``rows``, of equal columns ``by``, whose ``hay`` holds the ``needle``; an empty one is held by nothing."""
    return meeting(asked, needle, rows, hay, by, sizes).filter(F.col(hay).contains(F.col(needle)))


def resolve_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked (name) with source, filename and stage of the first stage that has candidates: 1 the canonical address,
    2 the path in knowledge, 3 in canon, 4 the path without its first folder, 5 the only one with the base name,
    6 the only one whose path holds the name.  Several candidates at stages 5 and 6: ambiguous, no file."""
    low = F.lower(F.trim("name"))
    own = asked.select("name").distinct().withColumn("_q", F.when(low.endswith(".md"), low).otherwise(F.concat(low, F.lit(".md"))))
    f = files.select("source", "filename", F.lower("filename").alias("_f"), F.lower(F.concat_ws(":", "source", "filename")).alias("_c"), F.lower(F.element_at(F.split("filename", "/"), -1)).alias("_b"))
    bare = own.withColumn("_s", F.regexp_replace("_q", "^[^/]+/", "")).withColumn("_base", F.element_at(F.split("_q", "/"), -1))
    hit = lambda on, stage: bare.join(f, on).select("name", "source", "filename", F.lit(stage).alias("stage"))
    found = hit(F.col("_q") == F.col("_c"), 1)
    found = found.unionByName(hit((F.col("_q") == F.col("_f")), 2).withColumn("stage", F.when(F.col("source") == "knowledge", 2).otherwise(3)))
    found = found.unionByName(hit((F.col("_s") == F.col("_f")) & (F.col("_s") != F.col("_q")), 4)).unionByName(hit(F.col("_base") == F.col("_b"), 5))
    text = F.regexp_replace("_q", r"\.md$", "")
    left = bare.join(found.select("name").distinct(), "name", "left_anti")  # of a stated set of names, the few without a file
    inside = holding(left.withColumn("_n", text).filter("_n <> ''"), "_n", f, "_f")
    found = found.unionByName(inside.select("name", "source", "filename", F.lit(6).alias("stage")))
    first = found.withColumn("_m", F.min("stage").over(Window.partitionBy("name"))).filter("stage = _m")
    one = first.groupBy("name", "stage").agg(F.countDistinct("source", "filename").alias("n"), F.min(F.struct(F.when(F.col("source") == "knowledge", 0).otherwise(1).alias("o"), "source", "filename")).alias("p"))
    clear = (F.col("n") == 1) | (F.col("stage") <= 4)
    return asked.select("name").distinct().join(one, "name", "left").select("name", F.when(clear, F.col("p.source")).alias("source"), F.when(clear, F.col("p.filename")).alias("filename"), "stage", F.coalesce("n", F.lit(0)).alias("n_candidates"))


def rank_candidates(candidates: DataFrame, wanted: str, source: str | None = None, query: list[float] | None = None) -> DataFrame:
    """Section candidates (id, source, heading, vector) in order: cosine to the query, exact last heading, the wanted
    source, an early match."""
    near = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])) if query else F.lit(0.0)
    at = F.instr(F.lower("heading"), F.lit(wanted.lower())) - 1
    exact = (F.lower(leaf(F.col("heading"))) == wanted.lower()).cast("int")
    local = F.lit(0) if source is None else (F.col("source") == source).cast("int")
    scored = candidates.withColumns({"cos": near, "exact": exact, "local": local, "early": F.when(at >= 0, 1 / (1 + at)).otherwise(0.0)})
    return scored.orderBy(F.desc("cos"), F.desc("exact"), F.desc("local"), F.desc("early"), "id")


def _pooled(met: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, n, ids: of answers (by, n, ids) their sum and the ``most`` smallest different ids, each array of which is sorted and as long at most."""
    ids = met.select(*by, F.explode("ids").alias("id")).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_n") <= most)
    return met.groupBy(*by).agg(F.sum("n").alias("n")).join(ids.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("ids")), by)


def _slugged(heads: DataFrame) -> DataFrame:
    """Headings (_t) once for each slug (_s) that they go by: of the whole path and of its last part."""
    return heads.withColumn("_s", F.explode(F.array_distinct(F.array(slug(F.col("_t")), slug(leaf(F.col("_t")))))))


def resolve_sections(asked: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """asked (address: ``file > heading`` or a heading) with outcome found, ambiguous, narrow (more than ``most``) or
    missing, and the chunk ids of the first stage that has any: exact heading in the file, heading that holds it in the
    file, then in any file.  A chunk's id is its own; equal rows count once.

    An address that names a file meets the different headings of that file, by any of the names the file goes by (its path and what follows a slash in it); what is looked
    for in any file meets the different headings of all.  Of a heading only the number of its chunks and the ``most`` smallest ids are passed on, and each different
    question is answered once, however many addresses ask it and chunks answer."""
    whole = F.col("address").contains(" > ") & F.lower(F.split_part("address", F.lit(" > "), F.lit(1))).rlike(r"\.md$|/|:")
    own = asked.select("address").distinct().withColumn("_file", F.when(whole, F.lower(F.regexp_replace(F.split_part("address", F.lit(" > "), F.lit(1)), "^(knowledge|canon):", "")))).withColumn("_head", F.when(whole, F.regexp_extract("address", "^.*? > (.*)$", 1)).otherwise(F.col("address")))
    own = own.select("address", "_file", slug(F.col("_head")).alias("_s"), F.lower("_head").alias("_low"))
    within = own.filter("_file is not null")
    c = chunks.select("id", F.lower("filename").alias("_f"), F.lower("heading").alias("_t")).filter("_t is not null").distinct().withColumns({"n": F.lit(1).cast("long"), "ids": F.array("id")})
    parts = F.split("_f", "/")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    inside = c.filter("_f is not null").withColumn("_file", F.explode(names)).join(within.select("_file").distinct(), "_file", "left_semi")
    inside = _pooled(inside, ["_file", "_t"], most)
    anywhere = _pooled(c.drop("_f").distinct(), ["_t"], most)
    stage = lambda rows, answers, by, no: rows.join(answers, by).select("address", F.lit(no).alias("stage"), "n", "ids")

    def held(rows: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
        found = holding(rows.select(*by, "_low").distinct(), "_low", heads.select(*by, "_t"), "_t", tuple(by)).select(*by, "_low", "_t")
        return _pooled(found.join(heads, [*by, "_t"]), [*by, "_low"], most)

    first = stage(within, _pooled(_slugged(inside), ["_file", "_s"], most), ["_file", "_s"], 1).unionByName(stage(within, held(within, inside, ["_file"]), ["_file", "_low"], 2))
    by_slug = _pooled(_slugged(anywhere), ["_s"], most)
    loose = own.filter("_file is null")
    rest = within.join(first.select("address").distinct(), "address", "left_anti")
    everywhere = held(loose.unionByName(rest), anywhere, [])
    found = first.unionByName(stage(loose, by_slug, ["_s"], 1)).unionByName(stage(loose, everywhere, ["_low"], 2)).unionByName(stage(rest, everywhere, ["_low"], 3))
    found = found.unionByName(stage(rest.filter("_low = ''"), by_slug, ["_s"], 3))  # an empty heading is the same as one without letters
    best = found.groupBy("address").agg(F.min(F.struct("stage", "n", "ids")).alias("b")).select("address", "b.n", "b.stage", "b.ids")
    outcome = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "found").when(F.col("n") > most, "narrow").otherwise("ambiguous")
    return asked.select("address").distinct().join(best, "address", "left").withColumn("outcome", outcome)


def extract_entities(chunks: DataFrame, extract: Callable[[str], list[tuple[str, str, str | None, str | None]]] | None = None, most: int = 200) -> DataFrame:
    """Entities and relationships of the first ``most`` chunks (the feature's own limit): rows of ENTITY_SCHEMA.  The default
    takes capitalised runs of words as entities and neighbours in a sentence as related."""
    call = extract or capitalised

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *row) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in call(text or "")]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["chunk_id", "kind", "name", "other", "relation"])

    first = chunks.orderBy("source", "filename", "chunk_index").limit(most)
    return first.select(F.col("id").cast("string"), "content").mapInArrow(run, ENTITY_SCHEMA)


def capitalised(text: str) -> list[tuple[str, str, str | None, str | None]]:
    import re

    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][\w-]+(?: [A-Z][\w-]+)*", sentence)))
        out += [("entity", n, None, None) for n in names]
        out += [("relationship", a, b, "mentioned with") for a, b in zip(names, names[1:])]
    return out


def entity_edges(found: DataFrame) -> DataFrame:
    """references edges of weight 0.9 from entities to their chunks, relates_to edges of 0.7 between entities; an
    endpoint that no entity has by name, or by a name one of which holds the other, makes a loop of 0.3 at the other end."""
    entity = lambda name: F.concat(F.lit("entity:"), F.lower(name))
    own = found.filter("kind = 'entity'")
    to_chunks = own.select(entity(F.col("name")).alias("src"), F.col("chunk_id").alias("dst"), F.lit("references").alias("edge_type"), F.lit(0.9).alias("weight")).distinct()
    names = own.select(F.lower("name").alias("e")).distinct()
    related = found.filter("kind = 'relationship'").select(F.lower("name").alias("a"), F.lower("other").alias("b"), "relation").distinct()
    ends = related.select(F.explode(F.array("a", "b")).alias("end")).filter("end is not null").distinct()
    exact = ends.join(names, F.col("end") == F.col("e"))
    rest = ends.join(names, F.col("end") == F.col("e"), "left_anti")
    loose = holding(rest, "end", names, "e").unionByName(holding(names, "e", rest, "end"))
    known = exact.unionByName(loose).groupBy("end").agg(F.min("e").alias("e"))
    side = lambda k: known.select(F.col("end").alias(k), F.col("e").alias(f"e_{k}"))
    joined = related.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("e_a is not null or e_b is not null")
    whole = F.col("e_a").isNotNull() & F.col("e_b").isNotNull()
    out = joined.select(entity(F.coalesce("e_a", "e_b")).alias("src"), entity(F.coalesce("e_b", "e_a")).alias("dst"), F.lit("relates_to").alias("edge_type"), F.when(whole, 0.7).otherwise(0.3).alias("weight"))
    return to_chunks.unionByName(out.groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight")))


def load_slice(sections: DataFrame, offset: int = 0, most: int = 8000, text: str = "section", encoder: Encoder | None = None) -> DataFrame:
    """Tokens offset to offset + most of each section, with the state and the next offset; without an encoder a token is four
    characters, the last one what is left over."""
    if encoder is not None:
        cut = sections.withColumn("_s", slice_tokens(F.col(text), offset, most, encoder))
        return cut.withColumns({"content": F.col("_s.content"), "state": F.when(F.col("_s.more"), "TRUNCATED").otherwise("COMPLETE"), "next_offset": F.when(F.col("_s.more"), F.lit(offset + most))}).drop("_s")
    done = token_count(F.col(text)) <= offset + most
    begins = F.lit(4 * offset + 1)
    part = F.when(F.lit(offset) >= token_count(F.col(text)), "").when(done, F.substring(text, begins, F.length(text))).otherwise(F.substring(text, begins, F.lit(4 * most)))
    return sections.withColumns({"content": part, "state": F.when(done, "COMPLETE").otherwise("TRUNCATED"), "next_offset": F.when(~done, F.lit(offset + most))})


def tree_lines(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Headings (keys, ord, level, title, tokens, subtree_tokens) as printed lines: inner nodes show their subtree."""
    inner = F.col("subtree_tokens") > F.col("tokens")
    shown = F.when(inner, F.col("subtree_tokens")).otherwise(F.col("tokens"))
    return tree.select(*keys, "ord", F.format_string("%s%s %s (%,d tokens)", F.repeat(F.lit("  "), F.col("level") - 1), F.repeat(F.lit("#"), F.col("level")), "title", shown).alias("line"))


def heading_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The heading tree of markdown texts as printed lines."""
    from lorewell.operators.markdown import heading_tree, markdown_lines, subtree_sums

    rows = markdown_lines(docs, keys, text)
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("ord", F.max(F.when(F.col("level").isNotNull(), F.col("line_no"))).over(w)).filter("ord is not null")
    own = placed.groupBy(*keys, "ord").agg(F.max("level").alias("level"), F.max("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x.line), "\n").alias("body"))
    heads = own.select(*keys, "ord", "level", "title", token_count(F.col("body")).alias("tokens"))
    return tree_lines(subtree_sums(heading_tree(heads, keys), keys, "tokens"), keys)


def plan_compilation(chunks: DataFrame, hits: DataFrame, source: str, filename: str, top: int = 8) -> DataFrame:
    """Hits (id, weighted) of other files, the best of each, by tier: what to read before writing about a file."""
    meta = chunks.select("id", "source", "filename", "heading", "tier")
    own = hits.join(meta, "id").filter((F.col("filename") != filename) | (F.col("source") != source))
    best = own.withColumn("_n", F.row_number().over(Window.partitionBy("source", "filename").orderBy(F.desc("weighted"), "id"))).filter("_n = 1")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("weighted"), "id")))
    return ranked.filter(F.col("rank") <= top).select("tier", "rank", "source", "filename", "heading", "weighted")


def compile_plan(chunks: DataFrame, hits: DataFrame, own_file: str | None = None, top: int = 8) -> DataFrame:
    """What to read before a page is written: of search hits (id, weighted) the best of every wiki and canon file other than ``own_file``,
    by tier."""
    meta = chunks.select("id", "source", "filename", "heading", "summary", "tier")
    own = hits.select("id", "weighted").join(meta, "id").filter(F.col("tier").isin("wiki", "canon"))
    if own_file is not None:
        own = own.filter(F.col("filename") != own_file)
    best = own.withColumn("_n", F.row_number().over(Window.partitionBy("tier", "filename").orderBy(F.desc("weighted"), "id"))).filter("_n = 1")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("weighted"), "id")))
    return ranked.filter(F.col("rank") <= top).select("tier", "rank", "source", "filename", "heading", "summary", "weighted")


def compile_from_file(chunks: DataFrame, files: DataFrame, name: str, embed: Callable[[list[str]], list], query: str = "", top: int = 8) -> tuple[dict, DataFrame]:
    """({source, filename, query, slug}, plan) for a page to be written about a file (files: source, filename, text); an unknown or
    ambiguous name is an error."""
    found = resolve_files(files.sparkSession.createDataFrame([(name,)], "name string"), files).first()
    if found["filename"] is None:
        raise ValueError(f"no file for '{name}'" if not found["n_candidates"] else f"'{name}' means {found['n_candidates']} files")
    own = files.filter((F.col("source") == found["source"]) & (F.col("filename") == found["filename"]))
    row = own.select(query_of_file(F.col("filename"), F.col("text")).alias("query"), slug_of_file(F.col("filename")).alias("slug")).first()
    asked = query.strip() or row["query"]
    hits = search(chunks, list(embed([asked])[0]), 20)
    return {"source": found["source"], "filename": found["filename"], "query": asked, "slug": row["slug"]}, compile_plan(chunks, hits, found["filename"], top)


def compile_from_conversation(chunks: DataFrame, turns: DataFrame, ref: str, embed: Callable[[list[str]], list], query: str = "", top: int = 8) -> tuple[dict, DataFrame]:
    """({conv_id, query, slug, body}, plan) for a page to be written about turns of a conversation, named as by ``conversation_ref``; a bad
    reference, an unknown conversation or an empty range is an error."""
    from lorewell.operators.conversations import query_of_talk, rendered

    spark = turns.sparkSession
    r = spark.createDataFrame([(ref,)], "ref string").select(conversation_ref(F.col("ref")).alias("r")).first()["r"]
    if r["kind"] == "invalid":
        raise ValueError(f"bad reference '{ref}'")
    own = turns.filter(F.col("conv_id").cast("string") == r["id"])
    total = own.count()
    first, last = {"all": (0, total - 1), "last": (max(0, total - (r["first"] or 0)), total - 1), "range": (r["first"], r["last"])}[r["kind"]]
    if not total or first >= total:
        raise ValueError(f"conversation '{r['id']}' has {total} turns")
    text = rendered(own, first, last)
    row = text.select("body", query_of_talk(F.col("first_user"), F.col("body")).alias("query"), slug_of_talk(F.col("first_text"), F.lit(r["id"])).alias("slug")).first()
    asked = query.strip() or row["query"]
    return {"conv_id": r["id"], "query": asked, "slug": row["slug"], "body": row["body"]}, compile_plan(chunks, search(chunks, list(embed([asked])[0]), 20), None, top)


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
