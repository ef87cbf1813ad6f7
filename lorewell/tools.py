"""The library's operators as named tools over a ``KnowledgeIndex``: a registry with the tools' parameters, and dispatch by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators import conversations, graph, index, lifecycle, lint, links, markdown, resolve, vector_search
from lorewell.sources import files as S


class Tools:
    """Every public method is a tool; its parameters and the first line of its docstring are its schema.  ``turns``: conversation turns
    (conv_id, turn, role, text, vector), if there are any."""

    def __init__(self, index_: lifecycle.KnowledgeIndex, today: str, turns: DataFrame | None = None):
        self._index, self._spark, self._today, self._turns = index_, index_.spark, today, turns

    def _embed(self, text: str) -> list[float]:
        return list(self._index.embed([text])[0])

    def _files(self) -> DataFrame:
        return S.read_markdown(self._spark, self._index.roots)

    def _file(self, name: str) -> DataFrame:
        asked = self._spark.createDataFrame([(name,)], "name string")
        files = self._files()
        found = resolve.resolve_files(asked, files).first()
        if found["filename"] is None:
            raise ValueError(f"no file for '{name}'" if not found["n_candidates"] else f"'{name}' means {found['n_candidates']} files")
        return files.filter((F.col("source") == found["source"]) & (F.col("filename") == found["filename"]))

    def _starts(self, filename: str, heading: str = "") -> DataFrame:
        file = self._file(filename).select("source", "filename")
        own = self._index.chunks().join(F.broadcast(file), ["source", "filename"], "left_semi")
        return graph.starts_of(own.filter(F.lower("heading").contains(heading.lower())) if heading else own, ["chunk_index", "id"])

    def list_knowledge(self) -> DataFrame:
        """Indexed files by tier."""
        return index.indexed_files(self._index.chunks())

    def folder_tree(self, root: str = "") -> DataFrame:
        """Folders as a printed tree."""
        return index.folder_tree(self._files(), root or None)

    def read_knowledge(self, filename: str) -> DataFrame:
        """The headings of a file with their tokens."""
        return resolve.heading_lines(self._file(filename), ["source", "filename"]).orderBy("ord")

    def read_knowledge_section(self, filename: str, heading: str, offset: int = 0, most: int = 8000) -> DataFrame:
        """A section of a file, a slice at a time."""
        file = self._file(filename)
        chunks = self._index.chunks().select("source", "filename", "heading", "content", "chunk_index")
        own = chunks.join(F.broadcast(file.select("source", "filename")), ["source", "filename"], "left_semi")
        return resolve.load_slice(markdown.find_section(own, file, ["source", "filename"], heading), int(offset), int(most))

    def search_knowledge(self, query: str, k: int = 10) -> DataFrame:
        """The best sections for a query, with a header for each file; all files for a blank one."""
        if not query.strip():
            return self.list_knowledge()
        hits = vector_search.search(self._index.chunks(), self._embed(query), int(k))
        return vector_search.with_file_headers(hits, [F.desc("weighted"), F.desc("score"), F.col("id")]).select("rank", "header", "heading", "summary", "score", "weighted")

    def graph_neighbors(self, filename: str, heading: str = "", edge_type: str = "", min_weight: float = 0.0, offset: int = 0, limit: int = 50) -> DataFrame:
        """Neighbours of a file's sections, a page at a time."""
        nodes, edges = self._index.graph()
        near = graph.neighbors(edges, nodes, edge_type or None, float(min_weight))
        own = near.join(F.broadcast(self._starts(filename, heading).withColumnRenamed("start", "node")), "node", "left_semi")
        return graph.next_page(own, ["node", F.desc("weight"), "edge_type", "neighbor"], int(offset), int(limit))

    def graph_traverse(self, filename: str, heading: str = "", depth: int = 2, exclude_edge_types: str = "", min_weight: float = 0.0) -> DataFrame:
        """What is within reach of a file's sections; a search where there is nothing."""
        _, edges = self._index.graph()
        starts, chunks = self._starts(filename, heading), self._index.chunks()
        exclude, _ = graph.parse_edge_types(exclude_edge_types)
        reached = graph.traverse(edges, starts, int(depth), (*exclude, "parent_child"), float(min_weight))
        named = starts.join(chunks.select(F.col("id").alias("start"), "heading"), "start")
        return graph.with_fallback(reached, named, lambda q: vector_search.search(chunks, self._embed(q), 3))

    def graph_search(self, query: str, k: int = 5) -> DataFrame:
        """The best sections for a query and their neighbours."""
        nodes, edges = self._index.graph()
        chunks = self._index.chunks()
        hits = graph.hits_to_nodes(vector_search.search(chunks, self._embed(query), int(k)), chunks.select("id", "filename", "source", "heading"))
        near = graph.neighbors(edges.filter("edge_type <> 'parent_child'"), nodes)
        return hits.select(F.col("node").alias("hit"), "weighted").join(near, F.col("hit") == near.node, "left").select("hit", "weighted", "neighbor", "edge_type", "weight")

    def graph_stats(self) -> DataFrame:
        """Size of the index and its graph."""
        return self._index.statistics()

    def describe_node(self, filename: str, heading: str = "", min_weight: float = 0.0) -> DataFrame:
        """Degrees and links of a file's sections (three at most)."""
        _, edges = self._index.graph()
        own = self._starts(filename, heading).limit(3).withColumnRenamed("start", "node")
        return graph.node_profile(edges, float(min_weight)).join(F.broadcast(own), "node", "left_semi")

    def lint_knowledge(self) -> DataFrame:
        """Findings about the knowledge base, the first of each kind."""
        chunks, (_, edges) = self._index.chunks(), self._index.graph()
        pages = self._files().select("source", "filename")
        return lint.shown(lint.findings(chunks, edges, links.parse_links(chunks, ["id"], "content"), pages))

    def save_knowledge(self, filename: str, content: str, tags: str = "") -> DataFrame:
        """Writes a page and indexes it."""
        name = lifecycle.save_page(self._spark, self._index, filename, content, [tags], self._today)
        return self._spark.createDataFrame([(name,)], "saved string")

    def compile_knowledge(self, source: str, query: str = "") -> DataFrame:
        """What to read before a page about a file, or about turns of a conversation, is written."""
        embed = lambda texts: [self._embed(t) for t in texts]
        if source.startswith("conversation:"):
            return resolve.compile_from_conversation(self._index.chunks(), self._turns, source.split(":", 1)[1], embed, query)[1]
        return resolve.compile_from_file(self._index.chunks(), self._files(), source, embed, query)[1]

    def search_conversations(self, query: str, limit: int = 5) -> DataFrame:
        """Turns of conversations for a query."""
        return conversations.search_turns(self._turns, self._embed(query), int(limit))

    def read_conversation(self, conv_id: str, budget: int = 6000) -> DataFrame:
        """A conversation from its beginning, within a budget."""
        return conversations.read_within_budget(self._turns.filter(F.col("conv_id").cast("string") == conv_id), int(budget))


def registry(tools: Tools) -> dict[str, Callable[..., DataFrame]]:
    """The tools by name; those of conversations only where there are any."""
    talk = {"search_conversations", "read_conversation"}
    found = {n: f for n, f in inspect.getmembers(tools, inspect.ismethod) if not n.startswith("_")}
    return {n: f for n, f in found.items() if n not in talk or tools._turns is not None}


def schema(tool: Callable) -> dict:
    """A tool's name, what it is for, and its parameters with their types and defaults."""
    own = inspect.signature(tool).parameters.values()
    kinds = {"str": "string", "int": "integer", "float": "number"}
    parameters = {p.name: {"type": kinds[str(p.annotation)], **({} if p.default is p.empty else {"default": p.default})} for p in own}
    return {"name": tool.__name__, "description": (tool.__doc__ or "").split("\n")[0], "parameters": parameters, "required": [p.name for p in own if p.default is p.empty]}


def execute(tools: dict[str, Callable[..., DataFrame]], name: str, args: dict) -> DataFrame | str:
    """A tool's result; what goes wrong is told as text.  Arguments may be named by their place ('0', '1', ...)."""
    if name not in tools:
        return f"unknown tool '{name}'; known: {', '.join(sorted(tools))}"
    names = list(inspect.signature(tools[name]).parameters)
    try:
        return tools[name](**{names[int(k)] if str(k).isdigit() and int(k) < len(names) else k: v for k, v in args.items()})
    except Exception as e:  # noqa: BLE001  whatever it is, the caller gets it as text
        return f"{name} failed: {e}"
