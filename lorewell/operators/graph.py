"""Graph operators over edge tables (src, dst, edge_type, weight, ...) and node tables (id, node_type, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import canonical, leaf, strip, tier

EDGE_TYPES = ("similar", "cross_domain", "parent_child", "references", "relates_to", "inter_file")
#: Edge types that make a chunk no orphan.
SEMANTIC = ("similar", "inter_file", "cross_domain", "references", "relates_to")


def merge_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge for each (src, dst, edge_type): the heaviest, the earliest of equally heavy ones."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "edge_type")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("weight"), -F.col(seq)))
    return edges.groupBy("src", "dst", "edge_type").agg(best.alias("e")).select("src", "dst", "edge_type", *[F.col(f"e.{c}") for c in rest])


def merge_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """Entities and concepts of equal type and name (ignoring case) are one node with all tags and
    chunks; of other nodes with the same id the first stays."""
    named = nodes.filter(F.col("node_type").isin("entity", "concept"))
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags"))))
    chunks = F.array_sort(F.collect_set("source_chunk_id"))
    merged = named.groupBy("node_type", F.lower("name").alias("low")).agg(F.min_by("id", seq).alias("id"), F.min_by("name", seq).alias("name"), tags.alias("tags"), chunks.alias("chunk_ids"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(seq))
    other = nodes.filter(~F.col("node_type").isin("entity", "concept")).withColumn("_n", first).filter("_n = 1")
    other = other.select("node_type", "id", "name", "tags", F.array_compact(F.array("source_chunk_id")).alias("chunk_ids"))
    return merged.select("node_type", "id", "name", "tags", "chunk_ids").unionByName(other)


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: node, neighbor, direction; a loop once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), F.lit("out").alias("direction"), *rest)
    back = edges.filter("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), F.lit("in").alias("direction"), *rest)
    return out.unionByName(back)


def neighbors(edges: DataFrame, nodes: DataFrame | None = None, edge_type: str | None = None, min_weight: float = 0.0) -> DataFrame:
    """One row per node, neighbor and edge type: the heaviest edge; ties to the outgoing one, then the smaller end."""
    if edge_type:
        edges = edges.filter(F.col("edge_type") == edge_type)
    near = adjacency(edges.filter(F.col("weight") >= max(0.0, min_weight)))
    if nodes is not None:
        near = near.join(nodes.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    return heaviest(near)


def heaviest(near: DataFrame, *by: str) -> DataFrame:
    """Of rows of ``adjacency`` the heaviest for each of ``by``, node, neighbor and edge type; ties to the outgoing one."""
    own = [*by, "node", "neighbor", "edge_type"]
    best = F.max(F.struct("weight", F.when(F.col("direction") == "out", 1).otherwise(0).alias("o"), "direction"))
    return near.groupBy(*own).agg(best.alias("b")).select(*own, F.col("b.weight").alias("weight"), F.col("b.direction").alias("direction"))


def parse_edge_types(text: str, known: tuple[str, ...] = EDGE_TYPES) -> tuple[tuple[str, ...], bool]:
    """The edge types of a comma list, and whether parent_child, which is never shown, was among them; an unknown one is an error."""
    asked = [t for t in (x.strip().lower() for x in (text or "").split(",")) if t]
    unknown = sorted(set(asked) - set(known))
    if unknown:
        raise ValueError(f"unknown edge types: {', '.join(unknown)}; known: {', '.join(sorted(set(known) - {'parent_child'}))}")
    return tuple(dict.fromkeys(t for t in asked if t != "parent_child")), "parent_child" in asked


def other_types(allowed: tuple[str, ...], known: tuple[str, ...] = EDGE_TYPES) -> tuple[str, ...]:
    """The edge types that are not allowed."""
    return tuple(t for t in known if t not in allowed)


def starts_of(candidates: DataFrame, order: list, most: int = 5) -> DataFrame:
    """The first ``most`` resolved nodes (column id) from which a graph query starts."""
    return candidates.orderBy(*order).limit(most).select(F.col("id").alias("start"))


def next_page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a totally ordered result, with the number of all rows and the offset of the next page (null on the last)."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    after = max(0, offset) + max(0, limit)
    return page(rows, order, offset, limit).join(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > after, F.lit(after)))


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a totally ordered result."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def check_walk(depth: int, exclude: tuple[str, ...] = ()) -> None:
    """Raises an error for what no traversal takes."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1, 2 or 3")
    unknown = set(exclude) - set(EDGE_TYPES)
    if unknown:
        raise ValueError(f"unknown edge types: {sorted(unknown)}")


def walk(step: Callable[[DataFrame], DataFrame], starts: DataFrame, id_type: str, depth: int, min_weight: float = 0.0, keep: Callable[[DataFrame], DataFrame] = lambda front: front) -> DataFrame:
    """Breadth-first search by ``step``, which gives the neighbours (start, node, p, edge_type, weight) of a frontier (start, node);
    ``keep`` may write a frontier."""
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast(id_type).alias("parent"), F.lit(None).cast("double").alias("weight"))
    front = seen = keep(seen)
    for d in range(1, depth + 1):
        found = step(front).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        best = F.min(F.struct((-F.col("weight")).alias("w"), "edge_type", F.col("p").alias("parent")))
        found = found.groupBy("start", "node").agg(best.alias("b"))
        front = keep(found.select("start", "node", F.lit(d).alias("depth"), F.col("b.edge_type").alias("edge_type"), F.col("b.parent").alias("parent"), (-F.col("b.w")).alias("weight")))
        seen = seen.unionByName(front)
    return seen.filter(f"depth > 0 and weight >= {float(min_weight)}")


def traverse(edges: DataFrame, starts: DataFrame, depth: int = 2, exclude: tuple[str, ...] = (), min_weight: float = 0.0) -> DataFrame:
    """Breadth-first search: (start, node, depth, edge_type, parent, weight), every node once for each start,
    by the discovering edge (heaviest, then smallest type and parent).  ``min_weight`` holds back
    rows of the result, not the expansion.  ``starts``: column start.

    Shuffles the edges at every step; ``adjacency.AdjacencyIndex`` keeps them in place."""
    check_walk(depth, exclude)
    near = neighbors(edges.filter(~F.col("edge_type").isin(*exclude)) if exclude else edges)
    step = lambda front: front.select("start", F.col("node").alias("p")).join(near, F.col("p") == near.node).select("start", F.col("neighbor").alias("node"), "p", "edge_type", "weight")
    return walk(step, starts, dict(edges.dtypes)["src"], depth, min_weight)


def check_subgraph(depth: int, allowed: tuple[str, ...], max_nodes: int, max_edges: int) -> None:
    """Raises an error for what no subgraph takes."""
    if not (1 <= depth <= 3 and 1 <= max_nodes <= 250 and 1 <= max_edges <= 800):
        raise ValueError("depth 1 to 3, max_nodes 1 to 250, max_edges 1 to 800")
    unknown = set(allowed) - set(EDGE_TYPES)
    if unknown:
        raise ValueError(f"unknown edge types: {sorted(unknown)}")


def first_nodes(reached: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """id, depth, capped: the seeds (five at most), and what was reached from them in order of discovery up to ``most``."""
    reach = reached.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"), F.max("weight").alias("w"))
    reach = reach.join(seeds, "id", "left_anti").unionByName(seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast("double").alias("w")))
    # one row more than the cap shows whether it bites; these windows see so many rows at most
    order = ("depth", F.desc("w"), "id")
    first = reach.orderBy(*order).limit(most + 6).withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_all", F.count("*").over(Window.partitionBy()))
    return first.filter(f"_n <= {most} or depth = 0").select("id", "depth", (F.col("_all") > most).alias("capped"))


def first_edges(within: DataFrame, most: int) -> DataFrame:
    """The heaviest edges up to ``most``, and whether there are more (capped)."""
    order = (F.desc("weight"), "edge_type", "src", "dst")
    first = within.orderBy(*order).limit(most + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_all", F.count("*").over(Window.partitionBy()))
    return first.filter(f"_n <= {most}").withColumn("capped", F.col("_all") > most).drop("_n", "_all")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 2, allowed: tuple[str, ...] = EDGE_TYPES, max_nodes: int = 120, max_edges: int = 400) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within reach of the seeds (column id, five at most).  Nodes are taken in order of discovery up to the cap,
    seeds always; edges between taken nodes by weight up to their cap; column capped says that a cap bit."""
    check_subgraph(depth, allowed, max_nodes, max_edges)
    seeds = seeds.orderBy("id").limit(5)
    own = edges.filter(F.col("edge_type").isin(*allowed))
    nodes = first_nodes(traverse(own, seeds.select(F.col("id").alias("start")), depth), seeds, max_nodes)
    within = own.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, first_edges(within, max_edges)


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of edges at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes at no edge (of the given types)."""
    own = edges if types is None else edges.filter(F.col("edge_type").isin(*types))
    return nodes.join(own.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def edge_shares(edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("edge_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("edge_type", "n", F.round(F.col("n") / F.col("total"), 4).alias("edge_share"))


def hubs(edges: DataFrame, top: int = 5) -> DataFrame:
    """The nodes with most edges other than parent_child, and their share of these edges."""
    own = edges.filter("edge_type <> 'parent_child'")
    total = own.agg(F.count("*").alias("total"))  # one row
    best = degrees(own).orderBy(F.desc("degree"), "id").limit(min(50, max(1, top)))
    return best.join(F.broadcast(total)).select("id", "degree", F.round(F.col("degree") / F.col("total"), 4).alias("share_non_pc"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, orphans and average degree."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"))
    o = orphans(nodes, edges).agg(F.count("*").alias("n_orphans"))
    avg = F.when(F.col("n_nodes") > 0, F.round(2 * F.col("n_edges") / F.col("n_nodes"), 1)).otherwise(0.0)
    return n.join(F.broadcast(e)).join(F.broadcast(o)).select("n_nodes", "n_edges", "n_orphans", avg.alias("avg_degree"))


def provenance_class(edge_type, link_kind):
    return (
        F.when((edge_type == "references") & (link_kind == "prose"), "prose").when(edge_type == "references", "explicit").when(edge_type.isin("similar", "inter_file", "cross_domain"), "similarity")
        .when(edge_type == "parent_child", "hierarchy").otherwise("entity")
    )


def provenance_shares(edges: DataFrame) -> DataFrame:
    """Edges by the way they came about, with their share in per cent."""
    own = edges.select(provenance_class(F.col("edge_type"), F.coalesce("link_kind", F.lit("other")) if "link_kind" in edges.columns else F.lit("other")).alias("provenance"))
    counts = own.groupBy("provenance").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("provenance", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))


def reference_kinds(edges: DataFrame) -> DataFrame:
    """references edges by the kind of link, with their share in per cent."""
    own = edges.filter("edge_type = 'references'").groupBy(F.coalesce("link_kind", F.lit("other")).alias("link_kind")).agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total"))  # one row
    return own.join(F.broadcast(total)).select("link_kind", "n", F.round(100 * F.col("n") / F.col("total")).cast("int").alias("percent"))


def node_profile(edges: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Per node: edges out and in, distinct neighbours, and edges below the weight limit; with a column link_kind also
    references by kind, as a map."""
    near = adjacency(edges)
    shown = F.col("weight") >= min_weight
    out = near.groupBy("node").agg(
        F.count(F.when(shown & (F.col("direction") == "out"), 1)).alias("n_out"), F.count(F.when(shown & (F.col("direction") == "in"), 1)).alias("n_in"),
        F.countDistinct(F.when(shown, F.col("neighbor"))).alias("n_neighbors"), F.count(F.when(~shown, 1)).alias("n_suppressed"),
    )
    if "link_kind" not in edges.columns:
        return out
    kinds = near.filter(shown & (F.col("edge_type") == "references")).groupBy("node", F.coalesce("link_kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))
    by_node = kinds.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("references_by_kind"))  # a few kinds
    return out.join(by_node, "node", "left").withColumn("references_by_kind", F.coalesce("references_by_kind", F.create_map().cast("map<string,bigint>")))


def top_edges(edges: DataFrame, most: int = 12) -> DataFrame:
    """Per node and edge type the heaviest ``most`` edges, and how many more there are."""
    near = adjacency(edges)
    counts = near.groupBy("node", "edge_type").agg(F.greatest(F.count("*") - most, F.lit(0)).cast("long").alias("n_more"))
    order = Window.partitionBy("node", "edge_type").orderBy(F.desc("weight"), "neighbor", "direction")
    first = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)  # tasks keep the first of a hub before they meet
    return first.join(counts, ["node", "edge_type"])


def related_files(edges: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """Per file the other files by the summed weight of the edges to them."""
    meta = lambda p: chunks.select(F.col("id").alias(p), F.col("source").alias(f"{p}_source"), F.col("filename").alias(f"{p}_file"))
    pairs = adjacency(edges.filter("edge_type <> 'parent_child'")).join(meta("node"), "node").join(meta("neighbor"), "neighbor")
    pairs = pairs.filter((F.col("node_file") != F.col("neighbor_file")) | (F.col("node_source") != F.col("neighbor_source")))
    sums = pairs.groupBy("node_source", "node_file", "neighbor_source", "neighbor_file").agg(F.round(F.sum("weight"), 6).alias("weight"))
    w = Window.partitionBy("node_source", "node_file").orderBy(F.desc("weight"), "neighbor_source", "neighbor_file")
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def flat_clusters(edges: DataFrame, chunks: DataFrame, least: int = 20, spread: float = 0.05) -> DataFrame:
    """Files whose similar edges are many and almost equally heavy."""
    own = edges.filter("edge_type = 'similar'").join(chunks.select(F.col("id").alias("src"), "source", "filename"), "src")
    out = own.groupBy("source", "filename").agg(F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high"))
    return out.filter((F.col("n") >= least) & (F.round(F.col("high") - F.col("low"), 6) <= spread))


def spread_heat(edges: DataFrame, heat: DataFrame, conductance: dict[str, float], most: float = 12.0, decay: float = 0.982) -> DataFrame:
    """One step of heat from nodes to neighbours along weighted edges, then decay: (id, heat)."""
    rate = F.create_map(*[F.lit(x) for kv in conductance.items() for x in kv])
    near = adjacency(edges).withColumn("c", F.coalesce(F.try_element_at(rate, F.col("edge_type")), F.lit(0.0)) * F.col("weight"))
    gained = heat.join(near, heat.id == near.node).groupBy(F.col("neighbor").alias("id")).agg(F.sum(F.col("heat") * F.col("c")).alias("gain"))
    return heat.join(gained, "id", "full").select("id", (F.least(F.coalesce("heat", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)), F.lit(most)) * decay).alias("heat"))


def search_entities(nodes: DataFrame, query: str, top: int = 10) -> DataFrame:
    """Nodes other than chunks whose name holds the query, by number of tags."""
    return nodes.filter((F.col("node_type") != "chunk") & F.lower("name").contains(query.lower())).orderBy(F.desc(F.size("tags")), "id").limit(top)


def find_chunk(chunks: DataFrame, filename: str, heading: str) -> DataFrame:
    """The first chunk of a file whose heading holds ``heading``, ignoring case."""
    return chunks.filter((F.col("filename") == filename) & F.lower("heading").contains(heading.lower())).orderBy("chunk_index", "id").limit(1)


def node_by_id(nodes: DataFrame, node_id) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def with_key(edges: DataFrame) -> DataFrame:
    """Edges with a key: source, target and type."""
    return edges.withColumn("key", F.concat_ws(":", F.col("src").cast("string"), F.col("dst").cast("string"), "edge_type"))


def node_records(nodes: DataFrame) -> DataFrame:
    """What a viewer shows of nodes: the last part of the heading, the canonical file, the tier."""
    head = F.coalesce("heading", F.lit(""))
    label = F.when(leaf(head) != "", leaf(head)).otherwise(F.coalesce("name", F.lit("")))
    file = F.coalesce(canonical(F.col("source"), F.col("filename")), F.col("filename"))
    return nodes.select(
        F.concat(F.lit("node:"), F.col("id").cast("string")).alias("id"), label.alias("label"), F.coalesce("name", F.lit("")).alias("name"), file.alias("file"), head.alias("heading"), tier(F.col("source"), F.col("filename")).alias("tier"), "source",
        F.coalesce("summary", F.lit("")).alias("summary"), "tags", "node_type",
    )


def edge_records(edges: DataFrame, shown: int = 140) -> DataFrame:
    """What a viewer shows of edges: ends, type, weight to three digits, the head of the evidence, the link."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in edges.columns else F.lit("")
    name = lambda c: F.concat(F.lit("node:"), F.col(c).cast("string"))
    key = F.concat_ws(":", F.lit("edge"), F.col("src").cast("string"), F.col("dst").cast("string"), "edge_type")
    return edges.select(key.alias("id"), name("src").alias("source"), name("dst").alias("target"), F.col("edge_type").alias("type"), F.round("weight", 3).alias("weight"), F.left(text("evidence"), F.lit(shown)).alias("evidence"), text("link_kind").alias("link_kind"), text("link_text").alias("link_text"))


def merge_client(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A viewer's graph with more loaded: new nodes replace those of the same id, new edges come in once.  Of several new rows with one id, or of one edge,
    the last in order of their column ``seq`` stands (without that column, the greatest by their values), whatever the partitions."""

    def last_of(rows: DataFrame, by: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in by]
        comparable = [F.to_json(F.struct(c)) if rows.schema[c].dataType.typeName() == "map" else F.col(c) for c in rest]
        order = F.struct(*[F.col("seq")] * ("seq" in rest), *comparable) if rest else F.lit(0)
        return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*by, *[F.col(f"_l.{c}") for c in rest]) if rest else rows.distinct()

    kept = nodes.join(new_nodes.select("id").distinct(), "id", "left_anti")
    last = last_of(new_nodes, ["id"])
    fresh = last_of(new_edges, ["src", "dst", "edge_type"]).join(edges.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")
    every = edges.unionByName(fresh, allowMissingColumns=True)
    counts = degrees(every)
    return kept.unionByName(last, allowMissingColumns=True).drop("degree").join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))), every


def with_fallback(reached: DataFrame, starts: DataFrame, search: Callable[[str], DataFrame], most: int = 3) -> DataFrame:
    """start, node, depth, edge_type, score: what a traversal reached, and for starts (start, heading; five at most) without a neighbour
    the ``most`` best of a search for the last part of their heading."""
    none = F.lit(None)
    out = reached.select("start", "node", "depth", "edge_type", F.col("weight").alias("score"))
    for row in starts.join(reached.select("start").distinct(), "start", "left_anti").limit(5).collect():  # the start nodes' own limit
        found = search((row["heading"] or "").split(" > ")[-1]).limit(most)
        out = out.unionByName(found.select(F.lit(row["start"]).cast(dict(reached.dtypes)["start"]).alias("start"), F.col("id").alias("node"), none.cast("int").alias("depth"), F.lit("search").alias("edge_type"), F.col("score")))
    return out


def hits_to_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Search hits (filename, source, heading) with the id of their chunk node, the first one whose heading is the same but for case and
    spacing; hits without a node stay, with a null node."""
    norm = lambda c: strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    own = nodes.groupBy("filename", "source", norm(F.col("heading")).alias("_h")).agg(F.min("id").alias("node"))
    return hits.withColumn("_h", norm(F.col("heading"))).join(own, ["filename", "source", "_h"], "left").drop("_h")
