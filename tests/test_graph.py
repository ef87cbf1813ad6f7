from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lorewell.operators import graph as G
from lorewell.operators import vector_search as V

EDGES = [("c1", "c2", "similar", 0.85), ("c1", "c3", "cross_domain", 0.65), ("e1", "c1", "references", 0.9), ("c1", "c2", "parent_child", 1.0)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src string, dst string, edge_type string, weight double")


def nodes(spark, ids=("c1", "c2", "c3", "e1", "e2")):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_stats(spark):
    assert tuple(G.graph_stats(nodes(spark), edges(spark)).first()) == (5, 4, 1, 1.6)
    assert {r["edge_share"] for r in G.edge_shares(edges(spark)).collect()} == {0.25}
    hubs = G.hubs(edges(spark)).collect()
    assert (hubs[0]["id"], hubs[0]["degree"], hubs[0]["share_non_pc"]) == ("c1", 3, 1.0)
    assert {(r["degree"], r["share_non_pc"]) for r in hubs[1:]} == {(1, 0.3333)}


def test_traverse(spark):
    start = spark.createDataFrame([("c1",)], "start string")
    got = {(r["node"], r["depth"]) for r in G.traverse(edges(spark), start, 2, exclude=("parent_child",)).collect()}
    assert got == {("c2", 1), ("c3", 1), ("e1", 1)}


def test_min_weight_holds_back_rows_only(spark):
    chain = edges(spark, [("a", "b", "similar", 0.1), ("b", "c", "similar", 0.9)])
    start = spark.createDataFrame([("a",)], "start string")
    assert [r["node"] for r in G.traverse(chain, start, 2, min_weight=0.5).collect()] == ["c"]


def test_merge_keeps_the_heaviest_then_the_earliest(spark):
    rows = spark.createDataFrame([("a", "b", "similar", 0.5, 0), ("a", "b", "similar", 0.7, 1), ("a", "b", "similar", 0.7, 2)], "src string, dst string, edge_type string, weight double, seq int")
    assert [(r["weight"], r["seq"]) for r in G.merge_edges(rows).collect()] == [(0.7, 1)]


def test_entities_merge_by_name(spark):
    rows = spark.createDataFrame([("e1", "entity", "Ollama", ["x"], "c1", 0), ("e2", "entity", "ollama", ["y"], "c2", 1), ("c1", "chunk", "n", [], "c1", 2)], "id string, node_type string, name string, tags array<string>, source_chunk_id string, seq int")
    got = {r["id"]: (r["tags"], r["chunk_ids"]) for r in G.merge_nodes(rows).collect()}
    assert got == {"e1": (["x", "y"], ["c1", "c2"]), "c1": ([], ["c1"])}


def test_subgraph_caps(spark):
    star = edges(spark, [("a", f"n{i}", "similar", 1 - i / 100) for i in range(10)])
    found, within = G.subgraph(star, spark.createDataFrame([("a",)], "id string"), 1, max_nodes=4, max_edges=2)
    assert {r["id"] for r in found.collect()} == {"a", "n0", "n1", "n2"} and all(r["capped"] for r in found.collect())
    assert within.count() == 2 and all(r["capped"] for r in within.collect())


def test_similarity_edges(spark):
    rows = [(1, "ai.md", "knowledge", [1.0, 0.0, 0.0]), (2, "ai.md", "knowledge", [0.8, 0.6, 0.0]), (3, "math.md", "canon", [0.5, 0.5, 0.5]), (4, "ai.md", "knowledge", [0.9, 0.3, 0.0])]
    chunks = spark.createDataFrame(rows, "id long, filename string, source string, vector array<double>")
    got = V.similarity_edges(chunks).collect()
    similar = {(r["src"], r["dst"]): (r["intra_rank"], r["intra_total"], r["weight"]) for r in got if r["edge_type"] == "similar"}
    assert set(similar) == {(a, b) for a in (1, 2, 4) for b in (1, 2, 4) if a != b}
    assert similar[4, 1] == (1, 2, 0.949) and similar[4, 2] == (2, 2, 0.949)  # a tie goes to the smaller id
    assert {(r["src"], r["dst"]) for r in got if r["edge_type"] == "cross_domain"} == {(2, 3), (3, 2), (3, 4), (4, 3)}
    assert not [r for r in got if r["edge_type"] == "inter_file"]


def test_search_weighs_tiers(spark):
    rows = [(1, "canon", "a"), (2, "wiki", "b"), (3, "raw", "c")]
    chunks = spark.createDataFrame(rows, "id long, tier string, filename string").selectExpr("*", "'s' source", "'h' heading", "array(1D, 1D) vector")
    got = V.search(chunks, [1.0, 1.0], 3).collect()
    assert [(r["id"], round(r["weighted"], 2)) for r in got] == [(1, 1.15), (2, 1.0), (3, 0.75)]
    assert V.search(chunks, [], 3).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_traverse_reaches_what_a_plain_search_reaches(spark, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start = pairs[0][0]
    depth, front = {start: 0}, [start]
    for d in (1, 2):
        front = [x for n in front for x in near[n] if x not in depth and not depth.update({x: d})]
    e = spark.createDataFrame([(a, b, "similar", 1.0) for a, b in pairs], "src long, dst long, edge_type string, weight double")
    got = {r["node"]: r["depth"] for r in G.traverse(e, spark.createDataFrame([(start,)], "start long"), 2).collect()}
    assert got == {k: v for k, v in depth.items() if v}
