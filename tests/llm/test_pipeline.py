import corpus_pipeline

from .conftest import prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    english, german = "the and house street water light", "der und haus straße wasser öffnung"
    rows = [(i, "Terms of use apply.\n" + prose(i, 60, (english if i % 2 else german).split()), "en" if i % 2 else "de", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[1][1], "en", "s1", 0) for i in range(5)] + [(200, "12 34 !!", "en", "s0", 8), (201, None, None, None, None), (202, "Terms of use apply.", "en", "s1", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        if name != "packing":
            assert docs.columns == COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "language_id":
            assert not docs.filter("doc_id in (200, 201)").count() and docs.count() == 66
        if name == "line_dedup":
            assert not docs.filter("text like '%Terms of use%'").count() and docs.filter("doc_id < 60").count() == 60
        if name == "near_duplicates":
            assert docs.filter("doc_id = 1").count() == 1 and not docs.filter("doc_id between 100 and 104").count()
        if name == "source_mixing":
            assert docs.select("doc_id").distinct().count() == counts[2]
    assert docs.select("doc_id").distinct().count() == counts[2]
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 4096


def test_near_duplicates_with_repeated_and_null_ids(spark):
    base, other = prose(1, 200), prose(2, 200)
    rows = [(1, base), (2, base + " end"), (2, other), (3, other + " end"), (3, other + " more"), (None, prose(3, 80)), (None, prose(3, 80) + " end"), (None, prose(4, 80)), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, None)
    assert kept.columns == COLUMNS
    texts = [r["text"] for r in kept.collect()]
    groups = [sum(t is not None and t.startswith(x) for t in texts) for x in (base, other, prose(3, 80), prose(4, 80))]
    assert groups == [1, 1, 1, 1] and texts.count(None) == 2


def test_copies_are_no_boilerplate(spark):
    copy, near = prose(1, 30) + "\n" + prose(2, 30), [prose(3, 30), prose(4, 30), prose(5, 30)]
    rows = [(i, "menu\n" + copy, "en", "small", 0) for i in (7, 5, None)] + [(20, "menu", "en", "small", 4)] + [(30 + i, f"menu\n{prose(i, 9)}", "en", "small", 0) for i in range(10, 13)]
    rows += [(40 + i, "\n".join([*near, f"edited {i}"]), "en", "near", 0) for i in range(9)] + [(60, None, "en", "small", None), (61, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as host")
    got = corpus_pipeline.line_dedup(spark, docs, None)
    assert got.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=repr)
    want = [(i, copy, len(copy)) for i in (7, 5, None)] + [(30 + i, prose(i, 9), len(prose(i, 9))) for i in range(10, 13)] + [(r[0], r[1], 0) for r in rows if r[3] == "near"] + [(60, None, None), (61, "", 0)]
    assert found == sorted(want, key=repr)


def test_menus_of_short_pages_go_and_near_copies_stay(spark):
    """40 pages with a two-line menu and one own line each; copies of a text of four lines, another word changed in each."""
    own = [f"{prose(i, 5)} own {i}" for i in range(40)]
    rows = [(i, f"Home | Products | About us | Contact\nTerms of use and privacy policy apply\n{own[i]}", "en", "pages", 0) for i in range(40)]
    base = [prose(900 + k, 30).split() for k in range(4)]
    for i in range(30):
        lines = [list(x) for x in base]
        lines[i % 4][i % 29] = f"changed{i}"
        rows.append((100 + i, "\n".join(map(" ".join, lines)), "en", "copies", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, None).collect()}
    assert got == {i: own[i] for i in range(40)} | {r[0]: r[1] for r in rows if r[3] == "copies"}


def test_stages_take_empty_tables_and_clashing_columns(spark):
    full = spark.createDataFrame([(1, prose(1, 50), "en", "s", 0), (1, prose(1, 50), "en", "s", 0), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as n", "'x' as key", "2 as block", "3 as copies", "4 as n_tokens", "5 as score")
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, None)
            assert out.count() >= 0 and (name == "packing" or set(COLUMNS) <= set(out.columns))


def test_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(names, key=str)[-1] == "pipeline" and len(names) == 14


def test_packing_holds_little_of_texts_of_ever_new_words():
    """The stage's workers share an executor whose heap has grown: words and what a group needs stay below 64 MB (36; 166 with 2 MB of text and 200,000 words)."""
    import tracemalloc

    from lorewell.llm.packing import WordTokens

    had = WordTokens.of(corpus_pipeline.tokenizer_path(), corpus_pipeline.PACKING_MEMORY["cache_words"])
    had.forget()
    tracemalloc.start()
    try:
        size = corpus_pipeline.PACKING_MEMORY["group_chars"]
        for group in range(-(-(8 << 20) // size)):
            had.encode([" ".join(f"w{group}x{i}" for i in range(size // 10))])
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
        had.forget()
