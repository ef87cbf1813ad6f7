import pytest
from pyspark.sql import functions as F

from lorewell.operators import graph as G
from lorewell.operators import index, links, pages, policy, resolve
from lorewell.operators import vector_search as V
from lorewell.operators.lifecycle import Busy, Conflict, KnowledgeIndex, save_page, write_raw
from lorewell.sources.commits import CommitLog
from lorewell.sources import files as S
from lorewell.streaming import changes as ST

DIM = 16
EMBED = index.hash_embedding(DIM)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def vault(spark, tmp_path):
    write(tmp_path / "k/wiki/cortisol.md", "# Cortisol\nIt is a hormone, see [[stress]].")
    write(tmp_path / "k/wiki/stress.md", "# Stress\nA state.")
    write(tmp_path / "c/law.md", "# Law\nRules.")
    roots = {"knowledge": str(tmp_path / "k"), "canon": str(tmp_path / "c")}
    return tmp_path, roots, KnowledgeIndex(spark, str(tmp_path / "index"), roots, index.Embedder(EMBED, dim=DIM), dim=DIM, parts=4)


def headings(own):
    return sorted((r["filename"], r["heading"]) for r in own.chunks().collect())


def test_a_failing_model_loses_no_rows(spark, vault):
    path, roots, own = vault
    assert own.build() == 3
    before = headings(own)
    write(path / "k/wiki/cortisol.md", "# Other\nNew text.")

    def failing(texts):
        raise ValueError("no model")

    broken = KnowledgeIndex(spark, own.path, roots, index.Embedder(failing, dim=DIM), dim=DIM, parts=4)
    assert broken.reindex_file(f"{roots['knowledge']}/wiki/cortisol.md") == 0
    assert headings(own) == before
    assert own.reindex_file(f"{roots['knowledge']}/wiki/cortisol.md") == 1
    assert headings(own) == [("law.md", "Law"), ("wiki/cortisol.md", "Other"), ("wiki/stress.md", "Stress")]
    assert own.manifest()["last_indexed_at"]
    row = own.statistics().first()
    assert (row["n_files"], row["n_vectors"]) == (3, 3) and row["n_nodes"] == 3 + 2


def test_neighbours_after_a_build(spark, vault):
    _, _, own = vault
    own.build()
    _, edges = own.graph()
    name = {r["id"]: r["filename"] for r in own.chunks().collect()}
    found = {(name[r["node"]], name[r["neighbor"]]) for r in G.neighbors(edges.filter("edge_type = 'references'")).collect()}
    assert ("wiki/cortisol.md", "wiki/stress.md") in found


def test_writers_take_turns(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "x"), lease_s=1000)
    with log.lease():
        with pytest.raises(Busy):
            with log.lease():
                pass
    short = CommitLog(spark, log.path, lease_s=-1)  # a writer that crashed: its lease has run out
    gone = short.lease()
    gone.__enter__()
    with log.lease():
        assert log.commit({"a": 1}, 0) == 1
    with pytest.raises(Conflict):  # the one that was taken for dead goes on
        short.commit({"a": 2}, 0)
    assert log.state() == {"a": 1} and log.versions() == [1]


class Killed(BaseException):
    pass


def files_of(own):
    return sorted({r["filename"] for r in own.chunks().collect()})


@pytest.mark.parametrize("step", ["chunks", "links", "edges", "commit"])
def test_a_killed_build_changes_nothing(spark, vault, monkeypatch, step):
    path, roots, own = vault
    own.build()
    before, edges = files_of(own), own.graph()[1].count()
    write(path / "k/wiki/late.md", "# Late\nSee [[stress]].")

    def replace(self, state, name, *rest, f=KnowledgeIndex._replace):
        out = f(self, state, name, *rest)
        if name == step:
            raise Killed
        return out

    def commit(self, *rest, f=CommitLog.commit):
        if step == "commit":
            raise Killed
        return f(self, *rest)

    with monkeypatch.context() as m:
        m.setattr(KnowledgeIndex, "_replace", replace)
        m.setattr(CommitLog, "commit", commit)
        with pytest.raises(Killed):
            own.build()
    assert files_of(own) == before and own.graph()[1].count() == edges
    assert own.build() == 1 and "wiki/late.md" in files_of(own) and own.graph()[1].count() > edges
    left = {p.name for p in (path / "index/chunks").iterdir() if not p.name.startswith(".")}
    assert left <= {g for v in own.log.versions() for g in own.log.state(v)["tables"]["chunks"].values()}  # nothing of the killed one


def test_readers_keep_their_version(spark, vault):
    path, roots, first = vault
    first.build()
    own = KnowledgeIndex(spark, first.path, roots, first.embed, dim=DIM, parts=4, keep_s=0)
    with own.reading() as state:
        chunks, (_, edges) = own.chunks(state), own.graph(state)
        n = edges.count()
        write(path / "k/wiki/stress.md", "# Stress\nNow with [[cortisol]].")
        own.build(force=True)
        assert chunks.filter("content like '%cortisol%'").count() == 0 and edges.count() == n
        assert own.chunks().filter("content like '%Now with%'").count() == 1
    own.build(force=True)
    assert own.log.versions() == [3]
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|FILE_NOT_EXIST"):
        chunks.collect()


def comparable(own):
    edges = own.graph()[1]
    return (
        sorted(tuple(str(v) for v in r) for r in edges.select("src", "dst", "edge_type", F.round("weight", 6), F.round("cos", 6), "intra_rank", "intra_total", "evidence", "link_text", "link_kind", "target_file", "target_anchor").collect()),
        sorted((r["src"], r["dst"], round(r["cos"], 6), r["rank"]) for r in own.table("knn").collect()),
        sorted(r["id"] for r in own.graph()[0].collect()),
    )


def test_deltas_equal_a_new_build(spark, tmp_path):
    """One file edited, one new, one gone, one with another title; then the graph is that of a build from nothing."""
    topics = "sleep stress cortisol memory attention mood diet exercise light breath vagus rhythm".split()
    for i, t in enumerate(topics):
        other, third = topics[(i + 1) % 12], topics[(i + 5) % 12]
        write(tmp_path / f"{'c' if i % 4 == 0 else 'k'}/{'wiki/' if i % 2 else ''}{t}.md", f"# {t.title()}\n{t.title()} strongly shapes {third} in adults. See [[{other}#Notes]] and [x](wiki/{third}.md).\n## Notes\n{t} notes.\n### Deep\nmore {i}.\n## Shared {i % 5}\ntext")
    roots, limits = {"knowledge": str(tmp_path / "k"), "canon": str(tmp_path / "c")}, {"similar": 0.1, "inter": 0.1, "cross": 0.1}
    make = lambda name: KnowledgeIndex(spark, str(tmp_path / name), roots, index.Embedder(EMBED, dim=DIM), dim=DIM, parts=8, k=4, **limits)
    own = make("index")
    assert own.build() == 12
    write(tmp_path / "k/wiki/stress.md", "# Strain\nStrain strongly shapes mood in adults. See [[diet#Deep]].\n## Shared 1\nother")
    write(tmp_path / "k/wiki/new-page.md", "# New Page\nNew page gently changes breath too. See [[sleep]].\n## Notes\nx")
    (tmp_path / "k/wiki/memory.md").unlink()
    assert own.build() == 2
    again = make("again")
    again.build()
    assert comparable(own) == comparable(again)
    assert {t for t in (r["edge_type"] for r in own.graph()[1].collect())} >= {"inter_file", "cross_domain", "parent_child", "references"}
    # an edit that touches little
    write(tmp_path / "k/wiki/light.md", (tmp_path / "k/diet.md").read_text() if (tmp_path / "k/diet.md").exists() else "# Light\nLight.\n")
    assert own.reindex([("knowledge", "wiki/light.md")]) == 1
    assert own.touched["neighbours"] < own.chunks().count() and own.touched["mentions"] < own.chunks().count()
    third = make("third")
    third.build()
    assert comparable(own) == comparable(third)


def test_changes_are_indexed_by_a_stream(spark, vault):
    path, roots, own = vault
    own.build()
    write(path / "k/wiki/new.md", "# New\nMore.")
    q = ST.reindex_stream(ST.change_feed(spark, roots["knowledge"]), own, "knowledge", str(path / "cp"))
    q.awaitTermination(120)
    assert ("wiki/new.md", "New") in headings(own)


def test_pages_are_saved(spark, vault):
    path, roots, own = vault
    own.build()
    assert save_page(spark, own, "sleep.md", "Sleep helps, see [stress](wiki/stress.md).\n\n## Why\nrest", ["health", "Health"], "2024-05-06") == "knowledge:wiki/sleep.md"
    text = (path / "k/wiki/sleep.md").read_text()
    assert "tags:\n  - health\ncreated: 2024-05-06" in text and "[[wiki/stress|stress]]" in text and "# Sleep" in text
    save_page(spark, own, "sleep.md", "Again.", ["rest"], "2024-06-07")
    text = (path / "k/wiki/sleep.md").read_text()
    assert "created: 2024-05-06\nupdated: 2024-06-07" in text and "  - rest\n  - health" in text
    assert ("wiki/sleep.md", "Sleep") in headings(own)
    for name, content, error in (("law.md", "x", "canon"), ("a.md", "https://example.com/x", "placeholder"), ("../x.md", "x", "climbs")):
        with pytest.raises(ValueError, match=error):
            save_page(spark, own, name, content, ["t"], "2024-05-06")
    with pytest.raises(PermissionError):
        write_raw(spark, roots, "law.md", "x")
    assert write_raw(spark, roots, "raw/n.md", "x") == "raw/n.md" and (path / "k/raw/n.md").read_text() == "x"


def test_compile_plans(spark, vault):
    _, roots, own = vault
    own.build()
    files = S.read_markdown(spark, roots)
    about, plan = resolve.compile_from_file(own.chunks(), files, "stress", EMBED)
    assert about["slug"] == "stress" and about["query"].startswith("stress ") and {r["filename"] for r in plan.collect()} == {"law.md", "wiki/cortisol.md"}
    with pytest.raises(ValueError, match="no file"):
        resolve.compile_from_file(own.chunks(), files, "nothing", EMBED)
    turns = spark.createDataFrame([("c1", 0, "user", "How does stress work?"), ("c1", 1, "assistant", "Well."), ("c1", 2, "user", "Thanks")], "conv_id string, turn long, role string, text string")
    about, plan = resolve.compile_from_conversation(own.chunks(), turns, "c1:turn:1-9", EMBED)
    assert about["body"] == "### turn[1] assistant\nWell.\n\n### turn[2] user\nThanks" and about["query"] == "Thanks" and about["slug"] == "well"
    assert plan.count() == 3
    assert resolve.compile_from_conversation(own.chunks(), turns, "c1:last:1", EMBED)[0]["body"] == "### turn[2] user\nThanks"
    for ref in ("c1:turn:7", "c2", "c1:bad"):
        with pytest.raises(ValueError):
            resolve.compile_from_conversation(own.chunks(), turns, ref, EMBED)


def test_tools(spark, vault):
    from lorewell import tools

    _, _, own = vault
    own.build()
    turns = spark.createDataFrame([("c1", 0, "user", "stress", EMBED(["stress"])[0].tolist())], "conv_id string, turn long, role string, text string, vector array<float>")
    known = tools.registry(tools.Tools(own, "2024-05-06", turns))
    assert len(known) == 15 and "search_conversations" not in tools.registry(tools.Tools(own, "2024-05-06"))
    assert tools.schema(known["search_knowledge"])["required"] == ["query"] and tools.schema(known["graph_traverse"])["parameters"]["depth"] == {"type": "integer", "default": 2}
    run = lambda name, **args: tools.execute(known, name, args)
    assert run("list_knowledge").count() == 3 and run("search_knowledge", query=" ").count() == 3
    assert tools.execute(known, "search_knowledge", {"0": "stress", "k": "2"}).count() == 2
    assert [r["line"] for r in run("read_knowledge", filename="stress").collect()] == ["# Stress (2 tokens)"]
    assert run("read_knowledge_section", filename="stress", heading="stress").first()["content"].startswith("# Stress")
    assert {r["edge_type"] for r in run("graph_neighbors", filename="cortisol", edge_type="references").collect()} == {"references"}
    assert run("graph_traverse", filename="law").count() >= 1 and run("graph_search", query="stress").count() >= 3
    assert run("describe_node", filename="cortisol").count() == 1 and run("graph_stats").first()["n_files"] == 3
    assert run("lint_knowledge").count() >= 0 and run("folder_tree").count() == 2
    assert run("compile_knowledge", source="stress").count() == 2 and run("compile_knowledge", source="conversation:c1").count() == 3
    assert run("search_conversations", query="stress").count() == 1 and run("read_conversation", conv_id="c1").count() == 1
    assert "unknown tool" in run("nothing") and "no file" in run("read_knowledge", filename="nothing") and "failed" in run("graph_traverse", filename="law", exclude_edge_types="bad")


def test_a_start_without_neighbours_is_searched_for(spark):
    edges = spark.createDataFrame([(1, 2, "similar", 0.5)], "src long, dst long, edge_type string, weight double")
    starts = spark.createDataFrame([(1, "A"), (9, "X > Leaf")], "start long, heading string")
    chunks = spark.createDataFrame([(i, EMBED([t])[0].tolist(), "wiki") for i, t in ((1, "A"), (2, "B"), (3, "Leaf"))], "id long, vector array<float>, tier string")
    found = G.with_fallback(G.traverse(edges, starts, 1), starts, lambda q: V.search(chunks, EMBED([q])[0].tolist(), 3), 1)
    assert {(r["start"], r["node"], r["edge_type"]) for r in found.collect()} == {(1, 2, "similar"), (9, 3, "search")}


def test_edge_type_lists():
    assert G.parse_edge_types(" similar, parent_child,SIMILAR,references ") == (("similar", "references"), True)
    assert G.parse_edge_types("") == ((), False)
    with pytest.raises(ValueError, match="bad"):
        G.parse_edge_types("similar,bad")
    assert G.other_types(("similar", "inter_file")) == ("cross_domain", "parent_child", "references", "relates_to")


def test_unknown_types_are_refused(spark):
    edges = spark.createDataFrame([(1, 2, "similar", 0.5)], "src long, dst long, edge_type string, weight double")
    with pytest.raises(ValueError):
        G.subgraph(edges, spark.createDataFrame([(1,)], "id long"), 1, allowed=("similar", "bad"))


def test_budget():
    b = policy.Budget()
    b.set_window(10)
    b.set_available(-5)
    assert b.state()["context_window"] == 1024 and b.state()["available_tokens"] == 0 and b.state()["tool_token_cap"] == 512
    b.charge(100)
    assert b.state()["kb_loads"] == 1 and b.state()["tool_tokens_used"] == 100
    b.reset()
    assert b.state()["available_tokens"] == 999_999 and b.state()["kb_loads"] == 0


def test_embedder_protocol():
    def odd(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return EMBED(texts)

    e = index.Embedder(odd, "odd", DIM, batch=2, most_chars=4)
    assert e.name() == "odd" and e.get_config()["dim"] == DIM
    got = e.vectors(["abcdefgh", "bad", "x"])
    assert [ok for _, ok in got] == [True, False, True] and got[0][0] == EMBED(["abcd"])[0].tolist() and e([])== []


def test_nearest_in_cells_finds_what_the_exact_join_finds(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    centres = draw.standard_normal((40, 24))
    rows = [(f"k{i:05}", (centres[i % 40] + 0.4 * draw.standard_normal(24)).tolist()) for i in range(2000)] + [("zero", [0.0] * 24), ("none", None)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    want = {(r["src"], r["dst"]) for r in V.nearest(df, 5).filter("src not in ('zero', 'none')").collect()}
    got = {(r["src"], r["dst"]) for r in V.nearest_in_cells(df, 5, probes=6).filter("src not in ('zero', 'none')").collect()}
    assert len(want) == 10_000 and len(want & got) / len(want) > 0.9
    assert {(r["src"], r["dst"]) for r in V.nearest_in_cells(df, 5, cells=4, probes=4).filter("src not in ('zero', 'none')").collect()} == want


def test_summaries_and_overviews(spark):
    def call(text):
        if "bad" in text:
            raise ValueError
        return f"Plan:\n{text[:5]}"

    df = spark.createDataFrame([("k", "a.md", "hello world"), ("k", "b.md", "bad"), ("k", "c.md", None)], "source string, filename string, text string")
    assert [r["s"] for r in df.select(index.summarized(F.col("text"), call).alias("s")).collect()] == ["hello", None, None]
    assert [(r["filename"], r["content"]) for r in index.overviews(df, call).collect()] == [("a.md", "hello")]


def test_mention_patterns():
    import re

    p = re.compile(links.mention_pattern("marcus-aurelius"))
    assert p.search("by Marcus  Aurelius.") and p.search("MARCUS_aurelius") and not p.search("marcus aureliusx")
    assert not re.search(links.mention_pattern(" - "), "anything")


@pytest.mark.parametrize(("text", "meta", "body"), [
    ("---\na: 1\nb: [x, \"y, z\", 'it''s']\nc:\n  - p\n  - \"q \\\" r\"\n---\n\nBody", {"a": "1", "b": ["x", "y, z", "it's"], "c": ["p", 'q " r']}, "Body"),
    ("no front", {}, "no front"), ("---\nopen", {}, "---\nopen"), ("---\n: bad\n---\nx", {}, "---\n: bad\n---\nx"), ("", {}, ""), (None, {}, ""),
])
def test_front_matter(text, meta, body):
    assert pages.parse_front_matter(text) == (meta, body)


def test_heartbeats_of_a_stream(spark, tmp_path):
    import time

    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:01")], "user_id string, ts string")
    rows.write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ST.heartbeat_stream(stream, 500).writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("beats").count() < 2:
            time.sleep(1)
        assert {(r["user_id"], r["last_ms"] % 100_000) for r in spark.table("beats").collect()} == {("a", 67_205_000 % 100_000), ("b", 67_201_000 % 100_000)}
    finally:
        q.stop()


def test_block_ratios_are_difflibs(spark):
    from difflib import SequenceMatcher

    from lorewell.operators import fuzzy

    names = ["cold widget", "Part > warm gadget", "a/b/cold-bracket", "xyz", "", "cold widgets and more"]
    asked = ["cold widget", "gadgets", "bracket"]
    q, n = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((asked, "query"), (names, "name")))
    want = set()
    for a in asked:
        best = []
        for name in names:
            low = name.lower()
            r = max(SequenceMatcher(None, a, x, autojunk=False).ratio() for x in (low, low.rsplit(" > ", 1)[-1], low.rsplit("/", 1)[-1])) + (0.2 if a in low else 0)
            if r >= 0.45:
                best.append((-round(r, 9), name))
        want |= {(a, name, -r) for r, name in sorted(best)[:3]}
    assert {(r["query"], r["name"], round(r["ratio"], 9)) for r in fuzzy.suggest(q, n).collect()} == want
