"""The registered queries of the subpackage against their SQL, on the smallest tables, and the pipeline against a brute-force version."""

import re
from collections import Counter
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from lorewell.llm import queries
from lorewell.llm.langid import train
from lorewell.llm.packing import WordTokens

from ..test_queries import SF, TABLES, table
from .conftest import prose
from .test_joins import classes

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.SQL[name])
    want = table([c[0] for c in found.description], found.fetchall())
    assert table(df.columns, df.collect()) == want


def boilerplate_dropped(rows):
    """Line dedup by brute force: different texts of a source are counted; a text of which most would go, and that has little of its own, stays."""
    sites = {}
    for r in rows:
        if r["text"] is not None:
            sites.setdefault(r["source"] or "", set()).add(r["text"])
    bad = {}
    for site, texts in sites.items():
        n = Counter(line for t in texts for line in {x.strip(" \t\r") for x in t.split("\n")} - {""})
        bad[site] = {line for line, k in n.items() if k > 1 and k > 0.05 * len(texts)}

    def pairs(lines):
        return [p for x in lines for w in [[y for y in re.split("[ \t\r]+", x) if y]] for p in zip(w, [*w[1:], None])]

    cut = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\r") not in bad.get(r["source"] or "", ())]
        cut.append((r, lines, kept, len(lines) - len(kept) > 1 and 2 * len("\n".join(kept)) <= len(r["text"] or "")))
    known = {}
    for r, lines, kept, suspect in cut:
        if suspect:
            known.setdefault(r["source"] or "", set()).update(pairs([x for x in lines if x not in kept]))
    out = []
    for r, lines, kept, suspect in cut:
        text = "\n".join(kept)
        if r["text"] is None or len(kept) == len(lines) or suspect and 9 * len(set(pairs(kept)) - known[r["source"] or ""]) <= len(pairs(lines)):
            out.append(r)
        elif text.strip():
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


def mixed(spark, rows):
    """Copies by the SQL of the mixing operator."""
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows))
    copies = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({queries.SQL['op3_source_mixing']})").fetchall()}
    return [r for r in rows for _ in range(copies[r["doc_id"]])]


def test_pipeline_against_brute_force(spark, tmp_path):
    vocab = {"en": "the and house street water light".split(), "de": "der und haus strasse wasser licht".split()}
    rows = []
    for i in range(90):
        lang = "en" if i % 2 else "de"
        rows.append({"doc_id": i, "text": f"Terms of use apply.\n{prose(i, 40 + i % 30, vocab[lang])}\n{prose(1000 + i, 12, vocab[lang])}", "lang": lang, "source": f"s{i % 3}", "n_chars": 1})
    rows += [{**rows[7], "doc_id": 100 + i} for i in range(4)] + [{**rows[9], "doc_id": 110, "text": rows[9]["text"] + " end"}, {**rows[1], "doc_id": 111, "text": "12 !!"}, {**rows[1], "doc_id": 112, "text": "Terms of use apply."}, {**rows[1], "doc_id": 113, "text": ""}]
    order = FIELDS.replace(" long", "").replace(" string", "").split(", ")
    docs = spark.createDataFrame([tuple(r[c] for c in order) for r in rows], FIELDS)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    model = train(docs)
    want = [r for r in rows if (p := model.predict(r["text"]))[0] != "und" and p[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    assert len(want) >= 94
    want = boilerplate_dropped(want)
    groups = classes([(r["doc_id"], r["text"]) for r in want], 5, 80)
    want = [r for r, (doc_id, _, component) in zip(want, groups) if doc_id == component]
    assert {100, 101, 102, 103, 110} & {r["doc_id"] for r in want} == set()
    want = mixed(spark, want)
    tokens = WordTokens.of(queries.tokenizer_path()).tokenizer
    ids = Counter()
    for r in want:
        one = [*tokens.encode(r["text"], add_special_tokens=False).ids, 1]
        ids.update((r["doc_id"], p // 4096, len(one[p : p + 4096])) for p in range(0, len(one), 4096))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert Counter(zip(got.doc_id, got.piece, got.length)) == ids
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
