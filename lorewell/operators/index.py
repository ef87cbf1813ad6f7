"""Building and keeping a chunk index: incremental files, summaries, folders, embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as X
from lorewell.operators import graph, links, markdown, vector_search

KEYS = ["source", "filename"]


def changed_files(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """Files for which no row with the same modification second is stored."""
    return disk.join(stored.select(*KEYS, "mtime").distinct(), [*KEYS, "mtime"], "left_anti")


def orphan_rows(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Stored rows whose file is gone."""
    return stored.join(disk.select(*KEYS), KEYS, "left_anti")


def replace_files(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored rows with those of the fresh files replaced."""
    return stored.join(fresh.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(fresh)


def best_summary(fresh: Column, prior: Column, mechanical: Column) -> Column:
    """A fresh summary, else an earlier one that was written by hand, else the mechanical one."""
    return F.coalesce(fresh, F.when((prior != mechanical) & (prior != "(no summary)") & (prior != ""), prior), mechanical)


def heading_summaries(chunks: DataFrame) -> DataFrame:
    """(source, filename, summaries): heading to summary, the last of equal headings, empty ones left out."""
    own = chunks.filter(F.coalesce("summary", F.lit("")) != "").groupBy(*KEYS, "heading").agg(F.max_by("summary", "chunk_index").alias("summary"))
    return own.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("heading", "summary")))).alias("summaries"))


def folder_of(filename: Column) -> Column:
    return F.when(filename.contains("/"), F.regexp_replace(filename, "/[^/]*$", "")).otherwise(".")


def folders(files: DataFrame) -> DataFrame:
    """source, folder, parent: every folder above a file, and '.' where files lie in the root."""
    parts = F.split("filename", "/")
    above = files.select("source", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array(F.lit(".")))).alias("folder")).distinct()
    return above.withColumn("parent", F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")))


def folder_rollup(files: DataFrame, most: int = 20) -> DataFrame:
    """source, folder, file_count, files, about: the files directly in a folder, the first ``most`` by name; with a column text, also what the
    folder's README.md, else index.md, else _index.md begins with (300 characters of its first line that is no heading or rule)."""
    own = files.select("source", "filename", folder_of(F.col("filename")).alias("folder")).distinct()
    counts = own.groupBy("source", "folder").agg(F.count("*").alias("file_count"))
    rank = F.row_number().over(Window.partitionBy("source", "folder").orderBy("filename"))  # tasks keep the first of a folder before they meet
    first = own.withColumn("_n", rank).filter(F.col("_n") <= most).groupBy("source", "folder").agg(F.array_sort(F.collect_list("filename")).alias("files"))
    out = counts.join(first, ["source", "folder"])
    if "text" not in files.columns:
        return out
    base = F.element_at(F.split("filename", "/"), -1)
    order = F.array_position(F.array(F.lit("README.md"), F.lit("index.md"), F.lit("_index.md")), base)
    line = F.get(F.filter(F.transform(F.split("text", "\n"), X.strip), lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("---")), 0)
    about = files.filter(order > 0).groupBy("source", folder_of(F.col("filename")).alias("folder")).agg(F.min_by(F.coalesce(F.left(line, F.lit(300)), F.lit("")), order).alias("about"))
    return out.join(about, ["source", "folder"], "left").withColumn("about", F.coalesce("about", F.lit("")))


def folder_tree(files: DataFrame, root: str | None = None) -> DataFrame:
    """Folders in the order of a tree, with depth and a line to print; of one subtree if ``root`` is given."""
    counts = files.select("source", "filename", folder_of(F.col("filename")).alias("folder")).distinct().groupBy("source", "folder").agg(F.count("*").alias("file_count"))
    tree = folders(files).join(counts, ["source", "folder"], "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))
    if root:
        tree = tree.filter((F.col("folder") == root) | F.col("folder").startswith(root + "/"))
    depth = F.size(F.split("folder", "/")) - 1
    line = F.concat(F.repeat(F.lit("│   "), depth), F.element_at(F.split("folder", "/"), -1), F.lit("/ ("), F.col("file_count").cast("string"), F.lit(")"))
    return tree.withColumn("depth", depth).withColumn("line", line).orderBy(F.when(F.col("source") == "canon", 0).otherwise(1), "source", F.split("folder", "/"))


def hash_embedding(dim: int = 768) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding model: unit vectors drawn with a seed from the text's SHA-256."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big")).standard_normal(dim)
            out[i] = v / np.linalg.norm(v)
        return out

    return embed


class Embedder:
    """What an embedding function is called and how it is set up, besides the call: a list of texts to as many vectors."""

    def __init__(self, call: Callable[[list[str]], np.ndarray], name: str = "hash", dim: int = 768, batch: int = 100, most_chars: int = 8000):
        self.call, self._name, self.dim, self.batch, self.most_chars = call, name, dim, batch, most_chars

    def name(self) -> str:
        return self._name

    def get_config(self) -> dict:
        return {"name": self._name, "dim": self.dim, "batch": self.batch, "most_chars": self.most_chars}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        """Vectors of texts cut to ``most_chars``, in batches; a batch that fails is done one by one, a text that fails is the zero vector."""
        return [v for v, _ in self.vectors(texts)]

    def vectors(self, texts: list[str]) -> list[tuple[list[float], bool]]:
        """The same, each with whether it is a vector of the model."""
        own, out = [(t or "")[: self.most_chars] for t in texts], []
        for lo in range(0, len(own), self.batch):
            some = own[lo : lo + self.batch]
            try:
                out += [(v, True) for v in np.asarray(self.call(some), np.float32).tolist()]
            except Exception:  # noqa: BLE001  the model's own failures, whatever they are
                for t in some:
                    try:
                        out.append((np.asarray(self.call([t]), np.float32)[0].tolist(), True))
                    except Exception:  # noqa: BLE001
                        out.append(([0.0] * self.dim, False))
        return out


def embed_column(column: Column, embed: Callable[[list[str]], np.ndarray] | Embedder, batch: int = 100, most_chars: int = 8000, dim: int = 768) -> Column:
    """Vectors by an ``Embedder``; a text that fails is the zero vector."""
    return embed_checked(column, embed, batch, most_chars, dim)["vector"]


def embed_checked(column: Column, embed: Callable[[list[str]], np.ndarray] | Embedder, batch: int = 100, most_chars: int = 8000, dim: int = 768) -> Column:
    """struct<vector, embedded>: ``embedded`` is false where the model failed and the vector is zero."""
    own = embed if isinstance(embed, Embedder) else Embedder(embed, "custom", dim, batch, most_chars)

    @F.pandas_udf("vector array<float>, embedded boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame(own.vectors([t if isinstance(t, str) else "" for t in texts]), columns=["vector", "embedded"])

    return run(column)


def summarized(text: Column, call: Callable[[str], str]) -> Column:
    """A model's summaries, cleaned; null where the model fails or has nothing to say."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str | None:
            try:
                return call(t) if t else None
            except Exception:  # noqa: BLE001  the model's own failures, whatever they are
                return None

        for texts in parts:
            yield pd.Series([one(t if isinstance(t, str) else None) for t in texts], dtype=object)

    return F.nullif(X.clean_summary(run(text)), F.lit(""))


def overviews(files: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """A chunk 'Document Overview' for each file that the model can summarise: source, filename, heading, content."""
    own = files.select("source", "filename", F.lit("Document Overview").alias("heading"), summarized(F.col("text"), call).alias("content"))
    return own.filter("content is not null")


def build_chunks(files: DataFrame, prior: DataFrame | None = None, embed: Callable[[list[str]], np.ndarray] | None = None, max_tokens: int = markdown.MAX_TOKENS, dim: int = 768, summarize: Callable[[str], str] | None = None) -> DataFrame:
    """The chunk table of files (source, filename, text, mtime): chunks with deterministic ids, tier, folder, summaries (fresh ones of
    ``summarize``, else those of ``prior`` carried over), file rollups, context header and vector."""
    chunks = markdown.chunk_files(files, max_tokens)
    mechanical = X.summary(F.col("content"))
    chunks = chunks.withColumn("mechanical", mechanical)
    if prior is not None:
        old = prior.groupBy(*KEYS, "heading").agg(F.max_by("summary", "chunk_index").alias("prior"))
        chunks = chunks.join(old, [*KEYS, "heading"], "left")
    else:
        chunks = chunks.withColumn("prior", F.lit(None).cast("string"))
    rolled = markdown.outline(chunks)
    header = markdown.context_header(F.col("filename"), F.col("chunk_index"), F.col("total_chunks"), F.col("heading"), F.col("doc_summary"))
    rows = chunks.join(rolled, KEYS).join(files.select(*KEYS, "mtime"), KEYS)
    rows = rows.select(
        F.sha2(F.concat_ws("\u0001", "source", "filename", F.col("chunk_index").cast("string")), 256).alias("id"), F.concat_ws("\n\n", header, "content").alias("document"), "content", "filename", "source", "heading", "chunk_index",
        best_summary(summarized(F.col("content"), summarize) if summarize else F.lit(None).cast("string"), F.col("prior"), F.col("mechanical")).alias("summary"), "token_count", "mtime", "file_tokens", "section_count", "file_outline", F.concat_ws(":", "source", "filename").alias("path"),
        folder_of(F.col("filename")).alias("folder"), F.lit("section").alias("type"), X.tier(F.col("source"), F.col("filename")).alias("tier"),
    )
    if not embed:
        return rows
    made = rows.withColumn("_e", embed_checked(F.col("document"), embed, dim=dim))
    return made.select("*", "_e.vector", "_e.embedded").drop("_e")


def structure_nodes(chunks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node per chunk and folder; parent_child edges from folders to chunks and subfolders."""
    chunk_nodes = chunks.select("id", F.lit("chunk").alias("node_type"), F.concat_ws("#", "filename", "heading").alias("name"), X.tags(F.col("source"), F.col("folder"), F.col("tier")).alias("tags"), F.col("id").alias("source_chunk_id"))
    tree = folders(files)
    fid = lambda s, f: F.concat(F.lit("folder:"), s, F.lit(":"), f)
    folder_nodes = tree.select(fid(F.col("source"), F.col("folder")).alias("id"), F.lit("folder").alias("node_type"), F.col("folder").alias("name"), F.array("source").alias("tags"), F.lit(None).cast("string").alias("source_chunk_id"))
    inside = chunks.select(fid(F.col("source"), F.col("folder")).alias("src"), F.col("id").alias("dst"))
    below = tree.filter("parent is not null").select(fid(F.col("source"), F.col("parent")).alias("src"), fid(F.col("source"), F.col("folder")).alias("dst"))
    edges = inside.unionByName(below).select("src", "dst", F.lit("parent_child").alias("edge_type"), F.lit(1.0).alias("weight"))
    return chunk_nodes.unionByName(folder_nodes), edges


def page_table(files: DataFrame) -> DataFrame:
    """source, filename, title: what links and mentions look pages up by."""
    title = F.regexp_extract("text", r"(?m)^#\s+(.+?)\s*$", 1)
    return files.select("source", "filename", (title if "text" in files.columns else F.lit("")).alias("title"))


#: Columns of an edge with what it came from; ``seq`` tells the rules apart: 0 structure, 1 similarity, 2 headings, 3 hierarchy, 4 links, 5 prose.
RAW_EDGE = "src string, dst string, edge_type string, weight double, cos double, intra_rank int, intra_total int, evidence string, link_text string, link_kind string, target_file string, target_anchor string, seq int"


def raw_edges(seq: int, edges: DataFrame) -> DataFrame:
    """Edges of one rule with all columns of RAW_EDGE."""
    wanted = [c.split(" ") for c in RAW_EDGE.split(", ")]
    return edges.select(*[(F.lit(seq) if c == "seq" else F.col(c) if c in edges.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted])


def build_graph(chunks: DataFrame, files: DataFrame, k: int = 12, similar: DataFrame | None = None, **limits: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a chunk table and its files (source, filename, text): structure, similarity, shared headings, hierarchy, links and
    prose bridges, one edge for each pair and type.  ``similar``: similarity edges, if they are made otherwise."""
    pages = page_table(files)
    nodes, structure = structure_nodes(chunks, files)
    parts = [structure, vector_search.similarity_edges(chunks, k, **limits) if similar is None else similar, links.heading_edges(chunks), links.hierarchy_edges(chunks), links.link_edges(chunks, pages), links.prose_edges(chunks, links.page_aliases(pages))]
    every = raw_edges(0, parts[0])
    for i, part in enumerate(parts[1:], 1):
        every = every.unionByName(raw_edges(i, part))
    return nodes, graph.merge_edges(every).drop("seq")


def statistics(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files and vectors of the index, nodes, edges, orphans and average degree of the graph."""
    own = chunks.agg(F.countDistinct(F.struct("source", "filename")).alias("n_files"), F.count("*").alias("n_vectors"))
    return own.join(F.broadcast(graph.graph_stats(nodes, edges)))


def file_list(files: DataFrame, source: str) -> DataFrame:
    """name, path, folder, last_modified_by of a source's files, by path."""
    own = files.filter(F.col("source") == source)
    return own.select(F.element_at(F.split("filename", "/"), -1).alias("name"), F.col("filename").alias("path"), folder_of(F.col("filename")).alias("folder"), X.front_matter_value(F.col("text"), "last_modified_by").alias("last_modified_by")).orderBy("path")


def catalog(chunks: DataFrame) -> DataFrame:
    """File, tags, first summary and day of change, by path, without the catalog and the log themselves."""
    own = chunks.filter(~F.element_at(F.split("filename", "/"), -1).isin("index.md", "log.md"))
    first = own.groupBy("source", "filename").agg(F.min_by("summary", "chunk_index").alias("summary"), F.max("mtime").alias("mtime"), F.first("tier").alias("tier"))
    return first.select("source", "filename", F.left("summary", F.lit(120)).alias("summary"), F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd").alias("modified"), "tier").orderBy("source", "filename")


def list_sections(chunks: DataFrame) -> DataFrame:
    """The sections of each file, in order."""
    return chunks.filter("type = 'section'").select("source", "filename", "chunk_index", "heading", "summary", "token_count").orderBy("source", "filename", "chunk_index")


def indexed_files(chunks: DataFrame) -> DataFrame:
    """Files that are indexed, with their tier, tiers in order."""
    files = chunks.groupBy("source", "filename").agg(F.min_by("tier", "chunk_index").alias("tier"))
    return files.withColumn("rank", X.tier_rank(F.col("tier"))).orderBy("rank", "source", "filename")
