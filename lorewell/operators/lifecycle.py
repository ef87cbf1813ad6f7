"""A chunk index with its graph, kept in a folder: built, brought up to date, and read, each as one call.

Four tables are dealt into parts by file: the chunks, the pages (titles), the k nearest neighbours of each chunk, and the edges, each with the rule it came
from; beside them the links as they were parsed.  A build writes the parts that changed into a folder of its own and then commits one entry to a numbered log
(``sources.commits``) that names the folder of each part of every table: chunks and graph change together or not at all, and a build that
fails or is killed leaves the state as it was.  Rows of a file are replaced only if all its chunks were embedded.

What a change touches is worked out, and only that is computed again:

- neighbours: the changed chunks, and the old ones that had a changed or removed chunk among their k, are searched for among all; the other old chunks meet the changed
  ones alone, and change where one of these is nearer than their k-th;
- headings: the headings of the changed files, before and after;
- hierarchy: within the changed files;
- links: those of the changed files, and those that name one of them;
- mentions: the changed chunks, and those with the words of a name that has come, gone or moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import canonical, leaf
from lorewell.operators import graph, index, links, vector_search
from lorewell.operators.index import KEYS
from lorewell.sources import files as S
from lorewell.sources.commits import Busy, CommitLog, Conflict

__all__ = ["Busy", "Conflict", "KnowledgeIndex", "save_page", "write_raw"]

CHUNKS = f"{S.CHUNK_SCHEMA}, content string, embedded boolean"
TABLES = {
    "chunks": CHUNKS,
    "pages": "source string, filename string, title string, mtime long",
    "knn": "src string, dst string, cos double, rank int",
    "links": "id string, start int, kind string, raw string, target string, anchor string, display string",
    "raw": index.RAW_EDGE,
    "edges": ", ".join(c for c in index.RAW_EDGE.split(", ") if not c.startswith("seq ")),
}
#: Files that are read by name, and names whose mentions are looked for one by one; beyond these, everything is read.
FEW_FILES, FEW_NAMES = 500, 200


class KnowledgeIndex:
    """``roots``: folder by source (canon, knowledge).  ``embed``: texts to vectors.  ``summarize``: a model's summary of a text.  ``k``: neighbours kept
    for each chunk.  ``keep_s``: how long a version that was followed by another can still be read; ``lease_s``: how long a writer that
    gives no sign is waited for.  ``by_cells``: whole builds find neighbours by a ``NeighbourIndex``."""

    def __init__(self, spark: SparkSession, path: str, roots: dict[str, str], embed: Callable | index.Embedder, dim: int = 768, parts: int = 64, summarize: Callable[[str], str] | None = None, max_tokens: int = 8000, k: int = 12, keep_s: float = 3600, lease_s: float = 3600, by_cells: bool = False, **limits: float):
        self.spark, self.path, self.roots, self.embed, self.dim, self.parts = spark, path.rstrip("/"), roots, embed, dim, parts
        self.summarize, self.max_tokens, self.k, self.keep_s, self.by_cells, self.limits = summarize, max_tokens, k, keep_s, by_cells, limits
        self.log = CommitLog(spark, f"{self.path}/state", lease_s)
        self.touched: dict[str, int] = {}

    # --- state ---

    def manifest(self, version: int | None = None) -> dict:
        return self.log.state(version) or {"tables": {}, "entities": None, "last_indexed_at": None}

    def table(self, name: str, state: dict | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of a state (the last one if none is given), with the column ``part``; of some parts if ``only`` names them."""
        held = (state or self.manifest())["tables"].get(name, {})
        schema = TABLES[name]
        out = self.spark.createDataFrame([], f"{schema}, part int")
        by_gen: dict[str, list[str]] = {}
        for part, gen in held.items():
            if only is None or int(part) in only:
                by_gen.setdefault(gen, []).append(f"{self.path}/{name}/{gen}/part={part}")
        for gen, paths in by_gen.items():
            out = out.unionByName(self.spark.read.schema(f"{schema}, part int").option("basePath", f"{self.path}/{name}/{gen}").parquet(*paths))
        return out

    def chunks(self, state: dict | None = None) -> DataFrame:
        return self.table("chunks", state).drop("part")

    def graph(self, state: dict | None = None) -> tuple[DataFrame, DataFrame] | None:
        """(nodes, edges); null before the first build."""
        state = state or self.manifest()
        if not state["last_indexed_at"]:
            return None
        chunks = self.chunks(state)
        nodes, structure = index.structure_nodes(chunks, chunks.select(*KEYS).distinct())
        edges = self.table("edges", state).drop("part").unionByName(index.raw_edges(0, structure).drop("seq"))
        if state["entities"]:
            more, found = S.read_graph(self.spark, f"{self.path}/entities/{state['entities']}")
            nodes, edges = nodes.unionByName(more), edges.unionByName(found)
        return nodes, edges

    def statistics(self) -> DataFrame:
        return index.statistics(self.chunks(), *self.graph())

    @contextmanager
    def reading(self) -> Iterator[dict]:
        """A state that stays readable to the end of the block, for ``chunks`` and ``graph``."""
        with self.log.held() as version:
            yield self.manifest(version)

    # --- changes ---

    def build(self, force: bool = False, entities: bool = False) -> int:
        """Brings the index up to date with the files, or makes it anew if ``force``; the number of files that were read again."""
        with self.log.lease():
            version = self.log.last()
            state = self.manifest(version)
            listed = S.list_markdown(self.spark, self.roots)
            known = self.table("pages", state).select(*KEYS, "mtime")
            todo = listed if force else listed.join(known, [*KEYS, "mtime"], "left_anti")
            names = [tuple(r) for r in todo.select(*KEYS).limit(FEW_FILES + 1).collect()]
            files = S.read_some(self.spark, self.roots, names) if len(names) <= FEW_FILES else S.read_markdown(self.spark, self.roots).join(todo.select(*KEYS), KEYS, "left_semi")
            gone = known.select(*KEYS).join(listed.select(*KEYS), KEYS, "left_anti")
            return self._bring(version, state, files, gone, force, entities)

    def reindex_file(self, path: str) -> int:
        """One changed file; its source is the root it lies in.  Files elsewhere, missing ones and others than markdown are ignored."""
        for source, root in sorted(self.roots.items()):
            inside = path[len(root.rstrip("/")) + 1 :] if path.startswith(root.rstrip("/") + "/") else None
            if inside and path.endswith(".md") and S.exists(self.spark, path):
                return self.reindex([(source, inside)])
        return 0

    def reindex(self, files: list[tuple[str, str]]) -> int:
        """Some changed files, as a micro-batch of a change feed has them (source, filename); those that are gone leave the index."""
        with self.log.lease():
            version = self.log.last()
            asked = self.spark.createDataFrame(files, "source string, filename string").distinct()
            found = S.read_some(self.spark, self.roots, sorted(set(files)))
            state = self.manifest(version)
            gone = asked.join(found.select(*KEYS), KEYS, "left_anti").join(self.table("pages", state).select(*KEYS), KEYS, "left_semi")
            return self._bring(version, state, found, gone, False, False)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*KEYS), F.lit(self.parts)).cast("int")

    def _replace(self, state: dict, name: str, gen: str, rows: DataFrame, parts: list[int]) -> dict:
        """The state with these parts of a table made of ``rows`` (which have the column part)."""
        if not parts:
            return state
        out = f"{self.path}/{name}/{gen}"
        rows.repartition("part").write.partitionBy("part").parquet(out)
        rest = {k: g for k, g in state["tables"].get(name, {}).items() if int(k) not in parts}
        here = {str(k): gen for k in parts if S.exists(self.spark, f"{out}/part={k}")}
        return {**state, "tables": {**state["tables"], name: {**rest, **here}}}

    def _bring(self, version: int, state: dict, files: DataFrame, gone: DataFrame, force: bool, entities: bool) -> int:
        gen = uuid.uuid4().hex[:12]
        work = f"{self.path}/work/{gen}"
        keep = lambda df, name: S.stored(df, f"{work}/{name}")
        files = keep(files, "files")
        old = self.table("chunks", state, [r[0] for r in files.select(self._part()).distinct().collect()])  # at most ``parts`` rows
        fresh = keep(index.build_chunks(files, old, self.embed, self.max_tokens, self.dim, self.summarize), "fresh")
        failed = fresh.filter("not embedded").select(*KEYS).distinct()
        good = fresh.join(failed, KEYS, "left_anti").withColumn("part", self._part())
        read = files.join(failed, KEYS, "left_anti")  # a file may have no chunks now
        changed = keep(read.select(*KEYS).unionByName(gone.select(*KEYS)).distinct().withColumn("part", self._part()), "changed")
        touched = sorted(r[0] for r in changed.select("part").distinct().collect())  # at most ``parts`` rows
        n = read.count()
        if touched:
            before = keep(self.table("chunks", state, touched).join(changed.select(*KEYS), KEYS, "left_semi"), "before")
            now = state
            for name, own in (("chunks", good), ("pages", index.page_table(read).join(read.select(*KEYS, "mtime"), KEYS).withColumn("part", self._part()))):
                kept = self.table(name, state, touched).join(changed.select(*KEYS), KEYS, "left_anti")
                now = self._replace(now, name, gen, kept.unionByName(own, allowMissingColumns=True), touched)
            whole = force or not state["tables"].get("chunks")
            near = self._neighbours(state, now, before, good, whole, keep)
            now = self._edges(state, now, changed, before, good, near, whole, gen, keep)
        else:
            now = state
        if entities:
            now = {**now, "entities": self._entities(now, gen)}
        if touched or entities or not state["last_indexed_at"]:
            self.log.commit({**now, "last_indexed_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}, version)
        S.remove(self.spark, work)
        self.sweep()
        return n

    def _neighbours(self, state: dict, now: dict, before: DataFrame, good: DataFrame, whole: bool, keep: Callable) -> DataFrame:
        """The neighbours (src, dst, cos, rank) of the chunks whose neighbours change."""
        rows = self.table("chunks", now).select("id", "vector")
        if whole and self.by_cells:
            from lorewell.operators.neighbour_index import NeighbourIndex

            return keep(NeighbourIndex(self.spark, S.work_folder(self.spark, "cells")).build(rows).nearest(self.k)[0], "near")
        if whole:
            return keep(vector_search.nearest(rows, self.k), "near")
        known = self.table("knn", state).drop("part")
        gone, new = before.select(F.col("id").alias("gone")), good.select("id", "vector")
        losers = known.join(gone, known.dst == F.col("gone"), "left_semi").select(F.col("src").alias("id")).distinct()
        asked = keep(new.unionByName(rows.join(losers, "id", "left_semi").join(new.select("id"), "id", "left_anti")), "asked")
        found = vector_search.nearest(rows, self.k, asked=asked)
        # what is new to the others: their old neighbours stay, as none of them is gone
        others = rows.join(asked.select("id"), "id", "left_anti")
        nearer = vector_search.nearest(new, self.k, asked=others).drop("rank")
        held = known.groupBy("src").agg(F.count("*").alias("n"), F.min("cos").alias("least"))
        better = keep(nearer.join(held, "src", "left").filter((F.coalesce("n", F.lit(0)) < self.k) | (F.round("cos", 9) >= F.round("least", 9))).select("src", "dst", "cos"), "nearer")
        own = known.join(better.select("src").distinct(), "src", "left_semi").select("src", "dst", "cos")
        return keep(found.unionByName(vector_search.ranked(own.unionByName(better), self.k)), "near")

    def _edges(self, state: dict, now: dict, changed: DataFrame, before: DataFrame, good: DataFrame, near: DataFrame, whole: bool, gen: str, keep: Callable) -> dict:
        """The state with neighbours, links and edges of what was touched."""
        chunks = self.table("chunks", now)
        pages, was = self.table("pages", now).select(*KEYS, "title"), self.table("pages", state).select(*KEYS, "title")
        part_of = chunks.select(F.col("id").alias("src"), "part")
        parted = lambda edges: edges.join(part_of, "src")
        heading = lambda df: df.select(F.lower(leaf(F.col("heading"))).alias("h")).filter("h <> ''")
        gone = before.select(F.col("id").alias("src"))
        parsed = keep(links.parse_links(good, ["id", "part"], "content"), "parsed")
        touched = [r[0] for r in changed.select("part").distinct().collect()]  # at most ``parts`` rows
        old_links = self.table("links", state)
        kept_links = self.table("links", state, touched).join(before.select("id"), "id", "left_anti")
        now = self._replace(now, "links", gen, kept_links.unionByName(parsed.select(*kept_links.columns)), touched)
        if whole:
            similar, heads, linking, telling = near, chunks, self.table("links", now), chunks
            sets = {}
        else:
            names = changed.select(F.lower("filename").alias("path"), F.element_at(F.split(F.lower("filename"), "/"), -1).alias("base"))
            named = old_links.withColumn("_n", links.link_names(F.col("target")))
            naming = named.join(names.select(F.col("path").alias("_p")).distinct(), F.col("_n.path") == F.col("_p"), "left_semi").unionByName(named.join(names.select(F.col("base").alias("_b")).distinct(), F.col("_n.base") == F.col("_b"), "left_semi"))
            link_ids = keep(naming.select("id").unionByName(parsed.select("id")).distinct(), "link-ids")
            linking = self.table("links", now).join(link_ids, "id", "left_semi")
            titles = keep(heading(before).unionByName(heading(good)).distinct(), "headings")
            heads = chunks.withColumn("_h", F.lower(leaf(F.col("heading")))).join(titles, F.col("_h") == F.col("h"), "left_semi").drop("_h")
            told_now, told_before = links.page_aliases(pages), links.page_aliases(was)
            moved = [r[0] for r in told_now.exceptAll(told_before).unionByName(told_before.exceptAll(told_now)).select("alias").distinct().limit(FEW_NAMES + 1).collect()]
            words = F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", " ")
            mentioning = chunks if len(moved) > FEW_NAMES else chunks.filter(F.exists(F.array(*[F.lit(a) for a in moved]), lambda a: words.contains(a))) if moved else chunks.limit(0)
            tell_ids = keep(mentioning.select("id").unionByName(good.select("id")).distinct(), "tell-ids")
            telling, similar = chunks.join(tell_ids, "id", "left_semi"), near
            sets = {1: near.select("src").distinct(), 4: link_ids.select(F.col("id").alias("src")), 5: tell_ids.select(F.col("id").alias("src"))}
        made = index.raw_edges(1, vector_search.similarity_edges(chunks, self.k, near=similar, **self.limits))
        made = made.unionByName(index.raw_edges(2, links.heading_edges(heads))).unionByName(index.raw_edges(3, links.hierarchy_edges(good)))
        made = made.unionByName(index.raw_edges(4, links.link_edges(chunks.drop("content"), pages, linking.drop("part")))).unionByName(index.raw_edges(5, links.prose_edges(telling, links.page_aliases(pages), chunks)))
        made = keep(parted(made), "made")
        near = keep(parted(near), "near-parts")
        if whole:
            parts = sorted({r[0] for r in chunks.select("part").distinct().collect()} | {int(p) for t in ("raw", "edges", "knn") for p in state["tables"].get(t, {})})
            rest, knn = self.table("raw", state).limit(0), self.table("knn", state).limit(0)
        else:
            every = self.table("raw", state)
            out = every.join(gone, "src", "left_semi").unionByName(every.filter("seq = 2").join(titles.withColumnRenamed("h", "evidence"), "evidence", "left_semi").select(*every.columns))
            for seq, ids in sets.items():
                out = out.unionByName(every.filter(F.col("seq") == seq).join(ids, "src", "left_semi"))
            moved_parts = changed.select("part").unionByName(made.select("part")).unionByName(out.select("part")).unionByName(near.select("part"))
            parts = sorted(r[0] for r in moved_parts.distinct().collect())  # at most ``parts`` rows
            rest = self.table("raw", state, parts).join(gone, "src", "left_anti")
            rest = rest.filter("seq <> 2").unionByName(rest.filter("seq = 2").join(titles.withColumnRenamed("h", "evidence"), "evidence", "left_anti").select(*rest.columns))
            for seq, ids in sets.items():
                rest = rest.filter(F.col("seq") != seq).unionByName(rest.filter(F.col("seq") == seq).join(ids, "src", "left_anti"))
            knn = self.table("knn", state, parts).join(gone, "src", "left_anti").join(near.select("src").distinct(), "src", "left_anti")
        self.touched = {"neighbours": near.select("src").distinct().count(), "links": linking.count(), "mentions": telling.count(), "parts": len(parts)}
        now = self._replace(now, "knn", gen, knn.unionByName(near.select(*knn.columns)), parts)
        now = self._replace(now, "raw", gen, rest.unionByName(made.select(*rest.columns)), parts)
        merged = graph.merge_edges(self.table("raw", now, parts)).drop("seq")
        return self._replace(now, "edges", gen, merged, parts)

    def _entities(self, state: dict, gen: str) -> str:
        from lorewell.operators import resolve

        found = resolve.extract_entities(self.chunks(state))
        edges = index.raw_edges(6, resolve.entity_edges(found)).drop("seq")
        names = found.filter("kind = 'entity'").groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"), F.min("chunk_id").alias("source_chunk_id"))
        nodes = names.select(F.concat(F.lit("entity:"), "low").alias("id"), F.lit("entity").alias("node_type"), "name", F.array().cast("array<string>").alias("tags"), "source_chunk_id")
        S.write_graph(nodes, edges, f"{self.path}/entities/{gen}")
        return gen

    def sweep(self) -> None:
        """Removes what only versions refer to that nobody may read any more, and what writers left that never committed (the lease shows that none is at work)."""
        kept = self.log.kept_versions(self.keep_s)
        states = [self.log.state(v) for v in kept]
        for name in TABLES:
            S.sweep(self.spark, f"{self.path}/{name}", {g for s in states for g in s["tables"].get(name, {}).values()})
        S.sweep(self.spark, f"{self.path}/entities", {s["entities"] for s in states if s["entities"]})
        S.sweep(self.spark, f"{self.path}/work", set())
        self.log.forget(set(self.log.versions()) - set(kept))


def save_page(spark: SparkSession, index_: KnowledgeIndex, filename: str, content: str, tags: list[str], today: str, related: DataFrame | None = None) -> str:
    """Writes a page of wiki or memory: checked, put together, logged and indexed.  The canonical name of the page; an error for a
    bad path, bad tags, a placeholder URL, or a name that canon has."""
    from lorewell.operators import pages as P

    known = S.read_markdown(spark, index_.roots)
    asked = spark.createDataFrame([(filename, content, tags)], "filename string, content string, tags array<string>")
    plan = P.plan_writes(asked, known.filter("source = 'canon'").select("filename")).first()
    if plan["error"]:
        raise ValueError(plan["error"])
    bad = [r["url"] for r in P.bad_urls(asked).collect()]  # of one page
    if bad:
        raise ValueError(f"placeholder URLs: {', '.join(bad)}")
    old = known.filter((F.col("source") == "knowledge") & (F.col("filename") == plan["path"])).select(P.front_matter_of(F.col("text")).alias("f")).first()
    meta = old["f"]["meta"] if old else {}
    have = {k: F.array(*[F.lit(x) for x in meta[k]]).cast("array<string>") if k in ("tags", "aliases") else F.lit(meta[k][0]) for k in ("created", "tags", "aliases", "source", "tier", "project") if meta.get(k)}
    front = P.merged_front(F.lit(today), P.clean_tags(F.col("tags")), None, have, tier=F.when(F.lit(plan["path"]).startswith("memory/"), "memory").otherwise("wiki"))
    title = F.initcap(F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.lit(plan["path"]), "/"), -1), r"\.md$", ""), "[-_]", " "))
    text = P.assemble(front, title, P.wiki_links(F.col("content")))
    block = None if related is None else P.related_block(related.filter((F.col("node_source") == "knowledge") & (F.col("node_file") == plan["path"]))).first()
    body = asked.select(P.with_related(text, F.lit(block["block"] if block else None).cast("string")).alias("t")).first()["t"]
    S.write_small(spark, f"{index_.roots['knowledge'].rstrip('/')}/{plan['path']}", body)
    index_.reindex([("knowledge", plan["path"])])
    return spark.range(1).select(canonical(F.lit("knowledge"), F.lit(plan["path"]))).first()[0]


def write_raw(spark: SparkSession, roots: dict[str, str], path: str, content: str) -> str:
    """Writes a file below knowledge as it is; refused if canon has the path, or if the path climbs out."""
    rel = path.replace("\\", "/").lstrip("/")
    if not rel or ".." in rel.split("/"):
        raise ValueError(f"bad path '{path}'")
    if S.exists(spark, f"{roots['canon'].rstrip('/')}/{rel}"):
        raise PermissionError(f"canon has '{rel}'")
    S.write_small(spark, f"{roots['knowledge'].rstrip('/')}/{rel}", content)
    return rel
