from lorewell.operators import markdown as M
from lorewell.operators import resolve as R


def test_files(spark):
    files = spark.createDataFrame([("knowledge", "wiki/a.md"), ("canon", "a.md"), ("knowledge", "b/x.md"), ("canon", "c/x.md"), ("canon", "deep/only.md")], "source string, filename string")
    asked = spark.createDataFrame([(n,) for n in ("canon:a.md", "wiki/a", "a", "x", "only", "knowledge/b/x.md", "deep/on", "zzz")], "name string")
    got = {r["name"]: (r["source"], r["filename"], r["stage"]) for r in R.resolve_files(asked, files).collect()}
    assert got == {
        "canon:a.md": ("canon", "a.md", 1), "wiki/a": ("knowledge", "wiki/a.md", 2), "a": ("canon", "a.md", 3), "x": (None, None, 5), "only": ("canon", "deep/only.md", 5),
        "knowledge/b/x.md": ("knowledge", "b/x.md", 4), "deep/on": ("canon", "deep/only.md", 6), "zzz": (None, None, None),
    }


def test_sections(spark):
    rows = [("1", "k", "a.md", "Intro"), ("2", "k", "a.md", "Intro > Methods"), ("3", "k", "b.md", "Intro to B")]
    chunks = spark.createDataFrame(rows, "id string, source string, filename string, heading string")
    asked = spark.createDataFrame([(x,) for x in ("a.md > Intro", "intro to", "b.md > methods", "nothing", "Methods")], "address string")
    got = {r["address"]: (r["outcome"], r["ids"]) for r in R.resolve_sections(asked, chunks).collect()}
    assert got == {"a.md > Intro": ("found", ["1"]), "intro to": ("found", ["3"]), "b.md > methods": ("found", ["2"]), "nothing": ("missing", None), "Methods": ("found", ["2"])}


def test_ranking(spark):
    rows = [("1", "k", "Setup notes", [1.0, 0.0]), ("2", "c", "A > Setup", [1.0, 0.0]), ("3", "k", "My setup", [0.0, 1.0])]
    c = spark.createDataFrame(rows, "id string, source string, heading string, vector array<double>")
    assert [r["id"] for r in R.rank_candidates(c, "setup").collect()] == ["2", "1", "3"]
    assert [r["id"] for r in R.rank_candidates(c, "setup", query=[0.0, 1.0]).collect()][0] == "3"


def test_entities(spark):
    chunks = spark.createDataFrame([("c1", "s", "f", 0, "We met Marcus Aurelius with Stoics there.")], "id string, source string, filename string, chunk_index long, content string")
    found = R.extract_entities(chunks)
    assert {r["name"] for r in found.filter("kind = 'entity'").collect()} == {"We", "Marcus Aurelius", "Stoics"}
    edges = {(r["src"], r["dst"], r["weight"]) for r in R.entity_edges(found).filter("edge_type = 'relates_to'").collect()}
    assert ("entity:marcus aurelius", "entity:stoics", 0.7) in edges
    lone = spark.createDataFrame([("c", "entity", "A", None, None), ("c", "relationship", "A", "Zed", "r")], R.ENTITY_SCHEMA)
    assert {(r["src"], r["dst"], r["weight"]) for r in R.entity_edges(lone).filter("edge_type = 'relates_to'").collect()} == {("entity:a", "entity:a", 0.3)}


def test_trees_and_slices(spark):
    docs = spark.createDataFrame([(1, "# A\naaaa\n## B\n" + "b" * 40 + "\n# C\n")], "d int, text string")
    lines = [r["line"] for r in R.heading_lines(docs, ["d"]).orderBy("ord").collect()]
    assert lines == ["# A (11 tokens)", "  ## B (10 tokens)", "# C (0 tokens)"]
    s = M.section_text(docs, ["d"], "b")
    assert s.first()["heading"] == "B" and s.first()["section"].startswith("## B")

    class Words:
        def encode(self, text):
            import re

            return re.findall(r"\S+\s*", text)

        def decode(self, tokens):
            return "".join(tokens)

    sections = spark.createDataFrame([("one two  three",)], "section string")
    part = R.load_slice(sections, 1, 1, encoder=Words()).first()
    assert (part["content"], part["state"], part["next_offset"]) == ("two  ", "TRUNCATED", 2)
    part = R.load_slice(sections, 1, 5).first()
    assert (part["content"], part["state"], part["next_offset"]) == ("two  three", "COMPLETE", None)


def test_a_needle_meets_its_rarest_run_only(spark):
    names = [f"the chapter {i:04}" for i in range(1500)] + ["x", "ab", "the end"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, hay string")
    needles = ["the chapter 0777", "chapter 14", "the ", "the chapters", "zzz", "ab", "x", ""]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = {(r["needle"], r["hay"]) for r in R.holding(asked, "needle", rows, "hay").collect()}
    assert got == {(n, h) for n in needles if n for h in names if n in h}
    met = {r["needle"]: r["n"] for r in R.meeting(asked, "needle", rows, "hay").groupBy("needle").count().withColumnRenamed("count", "n").collect()}
    assert met["the chapter 0777"] <= 60 and met["chapter 14"] <= 150 and "the chapters" not in met and "zzz" not in met


def test_addresses_of_sections_meet_their_file_and_not_all_equal_headings(spark):
    """Many files under one heading: the rows of the plan grow with the addresses, not with their square; odd addresses are answered as before."""
    n = 1500
    rows = [(f"{i:05}", f"deep/d{i}.md", "Top > Part 1") for i in range(n)] + [("x1", "q/x.md", "Alpha"), ("x2", "x.md", "alpha beta"), ("x2", "x.md", "alpha beta"), ("x3", "x.md", "!!"), ("x4", None, "Gamma")]
    chunks = spark.createDataFrame(rows, "id string, filename string, heading string")
    odd = {"x.md > ALPHA": ("ambiguous", 1, ["x1"]), "x.md > beta": ("found", 2, ["x2"]), "q/x.md > beta": ("found", 3, ["x2"]), "x.md > gamma": ("found", 3, ["x4"]), "part 1": ("narrow", 1, [f"{i:05}" for i in range(10)]), "top": ("narrow", 2, [f"{i:05}" for i in range(10)]),
           "x.md > part": ("narrow", 3, [f"{i:05}" for i in range(10)]), "a": ("narrow", 2, [f"{i:05}" for i in range(10)]), "q/x.md > !": ("found", 3, ["x3"]), "q/x.md > ": ("found", 3, ["x3"]), "y.md > zz": ("missing", None, None), "d7.md > part-1": ("found", 1, ["00007"])}
    odd["x.md > ALPHA"] = ("found", 1, ["x1"])
    asked = spark.createDataFrame([(f"d{i}.md > part-1",) for i in range(n)] + [(a,) for a in odd] + [(None,)], "address string")
    out = R.resolve_sections(asked, chunks)
    got = {r["address"]: (r["outcome"], r["stage"], r["ids"]) for r in out.collect()}
    assert {a: got[a] for a in odd} == odd and got[None][0] == "missing"
    assert all(got[f"d{i}.md > part-1"] == ("found", 1, [f"{i:05}"]) for i in range(n))
    met = []
    plan = [out._jdf.queryExecution().executedPlan()]
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if "Join" in node.nodeName():
            met.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    assert met and max(met) < 100 * n
