import re

import pytest
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import conversations as C, resolve
from lorewell.operators import fuzzy, index, links, markdown, pages, policy


def one(spark, expr, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("source", "path", "want"), [("canon", "law.md", "canon"), ("knowledge", "raw/notes.md", "raw"), ("knowledge", "wiki/concept.md", "wiki"), ("knowledge", "rootpage.md", "wiki"), ("knowledge", "raw-notes.md", "wiki"), ("knowledge", "rawmaterial/page.md", "wiki"), ("knowledge", "\\memory\\x.md", "memory")])
def test_tier(spark, source, path, want):
    assert one(spark, T.tier, source, path) == want


def test_paths_and_slugs(spark):
    assert one(spark, T.slug, "  A -- B's c! ") == "a-b-s-c"
    assert one(spark, T.anchor, "_Regulation  of__X-") == "regulation-of-x"
    assert one(spark, lambda s, p: T.canonical(s, p), "canon", "./a//b.md") == "canon:a/b.md"
    assert one(spark, lambda s, p: T.canonical(s, p), "canon", "../a.md") is None
    assert one(spark, T.wiki_path, "knowledge/x")["path"] == "wiki/x.md"
    assert one(spark, T.wiki_path, "canon/x.md")["error"] == "canon is read-only"
    assert one(spark, T.link_target, "https://a.b/c") == "" and one(spark, T.link_target, "./a#b") == "a.md"


@pytest.mark.parametrize(("ref", "kind", "first", "last"), [("abc", "all", None, None), ("abc:last:5", "last", 5, None), ("abc:turn:7", "range", 7, 7), ("abc:turn:0-3", "range", 0, 3), ("abc:turn:3-1", "invalid", None, None), ("abc:last:0", "invalid", None, None), ("abc:foo", "invalid", None, None), ("", "invalid", None, None), ("abc:turn:", "invalid", None, None)])
def test_conversation_refs(spark, ref, kind, first, last):
    got = one(spark, T.conversation_ref, ref)
    assert got["kind"] == kind
    if kind != "invalid":
        assert (got["id"], got["first"], got["last"]) == ("abc", first, last)


def test_small_text_functions(spark):
    assert one(spark, T.summary, "# T\n\n---\n| a |\nFirst line.\nmore") == "First line."
    assert one(spark, T.summary, "# T\n") == "(no summary)"
    assert one(spark, lambda x: T.summary(x, 5), "abcdefgh") == "abcde..."
    assert one(spark, T.sentences, "A b. C d! E") == ["A b.", "C d!", "E"]
    assert one(spark, T.decode_escapes, "a\\nb") == "a\nb"
    assert one(spark, T.distinct_ignoring_case, ["a", "A", " b ", ""]) == ["a", "b"]
    assert pages.cut_at_sentence("One two. Three four five", 15) == "One two."


def chunks(text, name="f.md", **kw):
    return markdown.chunk_text(text, name, **kw)


def test_chunker():
    assert chunks("") == []
    assert chunks("just text", "d/plain.md") == [("plain", "just text")]
    assert [h for h, _ in chunks("# First\na\n# Second\nb")] == ["First", "Second"]
    assert [h for h, _ in chunks("# Parent\nx\n## Child\ny\n## Another\nz")] == ["Parent"]
    big = chunks("# Big Section\n" + "Word " * 200, max_tokens=100)
    assert len(big) > 1 and big[0][0] == f"Big Section (part 1/{len(big)})"
    assert [h for h, _ in chunks("---\ntitle: x\n---\n# Section\nbody")] == ["Section"]
    assert chunks("# Section\nContent\n---\n# Next\nx")[0][1].endswith("Content")
    assert [h for h, _ in chunks("```\n# no\n```\n# Yes\nx")] == ["(preamble)", "Yes"]
    deep = chunks("# A\nintro\n## B\n" + "w " * 300 + "\n## C\nc", max_tokens=60)
    assert deep[0][0] == "A" and any(h.startswith("A > B (part 1/") for h, _ in deep) and deep[-1][0] == "A > C"


class Words:
    """An encoder whose tokens are words."""

    def encode(self, text):
        return re.findall(r"\S+\s*", text)

    def decode(self, tokens):
        return "".join(tokens)


def test_hard_split_covers_every_word():
    words = [f"w{i}" for i in range(503)]
    parts = markdown.hard_split(" ".join(words), 100, 10, Words())
    assert all(len(p.split()) <= 100 for p in parts) and markdown.hard_split("abcdefghij", 1, 0) == ["abcd", "efghij"]
    seen = [w for p in parts for w in p.split()]
    assert set(seen) == set(words) and parts[0].split()[0] == "w0" and parts[-1].split()[-1] == "w502"


def corpus(spark):
    files = [("knowledge", "wiki/cortisol.md", "# Cortisol\nIt is a hormone.\n## Regulation\nx"), ("knowledge", "wiki/stress.md", "# Stress\nSee [[cortisol]] and [[cortisol#regulation|HPA axis]] and [the dopamine page](dopamine.md#reward).\n![[img]] `[[code]]` [x](https://a.b)"), ("knowledge", "wiki/dopamine.md", "# Dopamine\nCortisol regulates the dopamine response in mammals.")]
    f = spark.createDataFrame([(*x, 1) for x in files], "source string, filename string, text string, mtime long")
    return f, index.build_chunks(f)


def test_links(spark):
    files, rows = corpus(spark)
    edges = {(r["link_text"], r["link_kind"], r["target_file"], r["target_anchor"]) for r in links.link_edges(rows, files.select("source", "filename")).collect()}
    assert edges == {("cortisol", "wiki", "wiki/cortisol.md", ""), ("the dopamine page", "markdown", "wiki/dopamine.md", "reward")}
    pages_ = spark.createDataFrame([("k", "a/x.md"), ("k", "b/x.md"), ("k", "c/y.md")], "source string, filename string")
    asked = spark.createDataFrame([("a/x.md",), ("x.md",), ("Y.md",), ("q/y.md",), ("z.md",)], "target string")
    assert {r["target"]: r["to_filename"] for r in links.resolve(asked, pages_).collect()} == {"a/x.md": "a/x.md", "x.md": None, "Y.md": "c/y.md", "q/y.md": "c/y.md", "z.md": None}


def test_bridges(spark):
    names = links.page_aliases(spark.createDataFrame([("k", f"wiki/{n}.md") for n in ("cortisol", "stress", "dopamine", "serotonin", "stoicism", "marcus-aurelius")], "source string, filename string"))
    texts = ["Cortisol regulates the stress response in mammals.", "Hormones to study: cortisol, dopamine, serotonin.", "Stoicism deeply influenced Marcus Aurelius throughout his reign."]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {(r["id"], r["subject_file"], r["object_file"]) for r in links.bridges(links.mentions(docs, ["id"], names), ["id"]).collect()}
    assert got == {(0, "wiki/cortisol.md", "wiki/stress.md"), (2, "wiki/stoicism.md", "wiki/marcus-aurelius.md")}
    files, rows = corpus(spark)
    edges = links.prose_edges(rows, links.page_aliases(files.select("source", "filename"))).collect()
    assert {(r["target_file"], r["weight"]) for r in edges} == {("wiki/cortisol.md", 0.5)}


def test_bridges_within_sentences_are_those_of_the_joins(spark):
    """Pairs made sentence by sentence, and by joins; no word of a sentence is shuffled."""
    names = spark.createDataFrame([("alpha", "k", "a.md"), ("first alpha", "k", "a.md"), ("beta", "k", "b.md"), ("gamma ray", "c", "b.md"), ("delta", "k", "d.md")], "alias string, source string, filename string")
    texts = ["Alpha meets beta and alpha sees beta.", "First alpha or beta. Beta of `alpha` with delta near [[beta]] alpha.", "Gamma ray burns beta then alpha, first alpha met delta.", "beta", "alpha beta delta", "Delta, alpha then delta.", "Gamma-ray lights first-alpha lights gamma ray.", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    found = links.bridged(docs, ["id"], names)
    want = rows(links.bridges(links.mentions(docs, ["id"], names), ["id"]))
    assert rows(found) == want == rows(links.bridged(docs, ["id"], names, few=2)) and len(want) >= 6
    plan = found.select("id", "subject_file", "object_file")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_structure_and_hierarchy(spark):
    files, rows = corpus(spark)
    nodes, edges = index.structure_nodes(rows, files)
    assert {r["node_type"]: r["n"] for r in nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()} == {"chunk": 3, "folder": 1}
    assert edges.count() == 3
    heads = spark.createDataFrame([("p", "s", "f", "A", 0), ("q", "s", "f", "A > B", 1), ("r", "s", "g", "A > B", 0)], "id string, source string, filename string, heading string, chunk_index long")
    assert [(r["src"], r["dst"]) for r in links.hierarchy_edges(heads).collect()] == [("p", "q")]


def test_hierarchy_of_a_long_file(spark):
    """A file of 20,020 sections: each path meets few headings; one that holds a path in its middle and comes before is its parent."""
    parts = [(f"guide > part {i}" + (f" > step {j}" if j else ""), 100 + 20 * i + j) for i in range(1000) for j in range(20)]
    rows = [(f"c{n}", "s", "f", h, n) for h, n in [("x > Guide > Part 5", 0), ("a > z", 1), *parts, *((f"guide > part 7 > step {k}", 90_000 + k) for k in range(100, 118))]]
    heads = spark.createDataFrame(rows, "id string, source string, filename string, heading string, chunk_index long")
    got = {r["dst"]: r["src"] for r in links.hierarchy_edges(heads).collect()}
    at = lambda i: "c0" if i == 5 else f"c{100 + 20 * i}"
    want = {f"c{n}": at((n - 100) // 20) for h, n in parts if " > step" in h} | {f"c{90_000 + k}": at(7) for k in range(100, 118)}
    # the path "guide" of the parts, and the path "a", are held by the first chunk; "x > guide" by no other chunk
    want |= {f"c{n}": "c0" for h, n in parts if " > step" not in h} | {"c1": "c0"}
    assert got == want
    ups = heads.select(F.lower(F.regexp_extract("heading", "^(.*) > ", 1)).alias("up")).filter("up like '%part%'").distinct()
    assert resolve.meeting(ups, "up", heads.select(F.lower("heading").alias("h")), "h", sizes=(1, 2, 3, 8)).count() < 100_000


def test_embedding_failures_are_zero_vectors(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return index.hash_embedding(8)(texts)

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "t string").coalesce(1)
    got = [r["v"] for r in df.select(index.embed_column(F.col("t"), embed, dim=8).alias("v")).collect()]
    assert got[1] == [0.0] * 8 and abs(sum(x * x for x in got[0]) - 1) < 1e-5


def test_history(spark):
    turns = spark.createDataFrame([("c", i, "user", f"{i}: " + "word " * 500) for i in range(6)], "conv_id string, turn long, role string, text string")
    kept = [r["turn"] for r in C.history_within_budget(turns, 200, 2).orderBy("turn").collect()]
    assert kept == [4, 5]
    short = spark.createDataFrame([("c", i, "user", "hi") for i in range(5)], "conv_id string, turn long, role string, text string")
    assert C.history_within_budget(short, 10_000).count() == 5
    assert [r["state"] for r in C.read_within_budget(turns, 100, 10).orderBy("turn").collect()] == ["head", "stop"]


def test_admission_order(spark):
    rows = [("t", i, "write", s) for i, s in enumerate(["a", "a", "b", "c", "a"])]
    calls = spark.createDataFrame(rows, "turn_id string, seq long, class string, signature string")
    got = [r["decision"] for r in policy.admit(calls).orderBy("seq").collect()]
    assert got == ["EXECUTED", "SKIPPED", "EXECUTED", "REFUSED", "REFUSED"]


def test_pages(spark):
    block = one(spark, lambda b, r: pages.with_related(b, r), "body", "- [[x]]")
    assert one(spark, lambda b, r: pages.with_related(b, r), block, "- [[x]]") == block
    assert one(spark, pages.wiki_links, "see [a](wiki/b.md#c), ![i](wiki/i.md), [e](https://x.y) `[a](wiki/b.md)`") == "see [[wiki/b#c|a]], ![i](wiki/i.md), [e](https://x.y) `[a](wiki/b.md)`"
    p = spark.createDataFrame([("a.md", "x\n## Sources\nconversation:abc:turn:1-2\n## Next\nconversation:no:turn:1")], "filename string, content string")
    assert [tuple(r) for r in pages.citations(p).collect()] == [("a.md", "abc", 1, 2)]
    w = spark.createDataFrame([("law.md", "x", ["a"]), ("wiki/law.md", "x", ["a"]), ("ok", "x", [""])], "filename string, content string, tags array<string>")
    canon = spark.createDataFrame([("Law.md",)], "filename string")
    assert {r["filename"]: r["error"] for r in pages.plan_writes(w, canon).collect()} == {"law.md": "canon has a page of this name", "wiki/law.md": None, "ok": "no tags"}


def test_fuzzy(spark):
    q, n = spark.createDataFrame([("regulaton",)], "query string"), spark.createDataFrame([("A > Regulation",), ("Other",)], "name string")
    assert [r["name"] for r in fuzzy.suggest(q, n).collect()] == ["A > Regulation"]


def test_table_functions(spark):
    from lorewell.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([("f.md", "# A\nx\n# B\ny")], "filename string, text string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT heading, chunk_index FROM some_files, LATERAL chunk_markdown(text, filename, 100)").collect()
    assert [tuple(r) for r in got] == [("A", 0), ("B", 1)]
    assert [tuple(r) for r in spark.sql("SELECT level, title FROM some_files, LATERAL markdown_headings(text)").collect()] == [(1, "A"), (1, "B")]


def test_context_windows(spark):
    assert one(spark, lambda m: policy.context_window(m, {"a": 1, "b-x": 2}), "a-7b") == 1
    assert one(spark, lambda m: policy.context_window(m, {"a": 1, "b-x": 2}), "b-x") == 2
    assert one(spark, lambda m: policy.context_window(m, {"a": 1}), "zzz") == 32_000


@pytest.mark.parametrize(("given", "want"), [
    ("<|start|>actual summary content<|end|>", ""), ("**Plan:**\nThe summary about cortisol regulation.", "The summary about cortisol regulation."),
    ("Cortisol is regulated by the HPA axis. Vagal tone modulates this.", "Cortisol is regulated by the HPA axis. Vagal tone modulates this."), ("", ""),
    ("<think>no<think> It is", "It is"), ("<|start|>kept", "kept"), ("a <b> c", "a <b> c"), ("1 < 2 and <x> y", "1 < 2 and <x> y"), ("<a> x < y <b> z", "<a> x < y <b> z"), ("<|a|>x<b", "x<b"), ("<a>x<|b|>y<|c|>z", "yz"),
    ("Plan: first\nthen", "first\nthen"), ("1. first step\nKept.", "Kept."), ("1. one. two. three. four.", "two. three. four."), ("12) no step\nx", "12) no step\nx"), ("  PLAN\n\nb", "b"),
])
def test_summaries_are_cleaned(spark, given, want):
    assert one(spark, T.clean_summary, given) == want


@pytest.mark.parametrize(("body", "want"), [
    ("---\ntitle: x\n---\n# Heading of it. Body  here", "my page . Body here"), ("plain", "my page plain"), ("# " + "t" * 100, "my page " + "t" * 19), ("--- open", "my page --- open"), ("## Two\nx", "my page ## Two x"),
])
def test_query_of_a_file(spark, body, want):
    assert one(spark, lambda x: T.query_of_file(F.lit("w/my-page.md"), x), body) == want
