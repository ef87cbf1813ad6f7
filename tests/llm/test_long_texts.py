"""Texts beyond a mebibyte and blocks beyond two megabytes, and rows that repeat."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lorewell.llm import fingerprint as FP
from lorewell.llm.lm_score import score_documents
from lorewell.llm.mixing import mix_sources
from lorewell.llm.packed import word_hashes
from lorewell.llm.suffix_dedup import _window_hashes, kept_digest, repeated_spans

from .conftest import prose
from .test_corpus import removed


def test_words_across_chunks_of_hashing():
    text = prose(1, 500_000)
    assert len(text) > 3 << 20
    hashes, at = word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([len(text)]))
    words = re.findall(r"\S+", text)
    assert at.tolist() == [0, len(words)]
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for w, h in zip(words, hashes.tolist())) and len(set(by_word.values())) == len(by_word)


def test_windows_across_chunks_of_hashing():
    one = np.frombuffer(prose(2, 160_000).encode()[: (1 << 20) + 5000], np.uint8)
    both = np.concatenate([one, one])
    h = _window_hashes(both, np.arange(len(both) - 199), 200)
    assert (h[: len(one) - 199] == h[len(one) :]).all() and len(np.unique(h[: len(one) - 199])) == len(one) - 199


def test_long_and_periodic_texts_lose_what_repeats(make_docs):
    long = prose(3, 190_000)
    assert len(long) > 1 << 20
    bits = [0]
    for _ in range(11):
        bits += [1 - b for b in bits]
    thue = "".join("ab"[b] for b in bits)  # has no cube, but long factors that come again
    texts = [long[:900_000] + prose(4, 100) + long[900_000:], long[400_000:1_000_000], "ab" * 700, thue, "é" * 300, prose(5, 400_000)]
    got = {r["doc_id"]: tuple(r)[1:] for r in kept_digest(repeated_spans(make_docs(list(enumerate(texts))))).collect()}
    assert got[2] == removed(texts[2:5], 200)[0] and got[3] == removed(texts[2:5], 200)[1] and got[4] == removed(texts[2:5], 200)[2]
    assert got[1][1] == got[1][0] == 600_000 and got[1][2] == 1
    assert got[0][1] == 600_000 and got[0][2] == 2 and got[5][1] == 0


def test_scores_of_a_long_text(make_docs):
    text = prose(6, 250_000)
    got = {r["doc_id"]: r for r in score_documents(make_docs([(1, text), (2, text), (3, None)])).collect()}
    assert got[1]["n_words"] == 250_000 and got[1]["n_seen"] == 249_998 and got[1]["score"] == got[2]["score"] and got[3]["score"] is None
    c = Counter(text.split(" "))
    assert abs(got[1]["score"]) < np.log10(250_000) and len(c) < 1000


def test_fingerprints_of_long_texts():
    text = prose(7, 300_000)
    half = text[: len(text) // 2] + prose(8, 160_000)
    assert len(text) > 1 << 20 and 0.4 < FP.likeness(FP.fingerprint(text), FP.fingerprint(half)) < 0.6
    a, b = ("x" * 9_000_000 + " " + w for w in ("one", "two"))
    assert 0.999 < FP.likeness(FP.fingerprint(a), FP.fingerprint(b)) < 1
    assert FP.likeness(FP.fingerprint("x" * 9_000_000), FP.fingerprint("y" * 9_000_000)) == 0


def test_mixing_with_repeated_ids_ties_and_a_long_text(spark):
    rows = [(1, "a", "w " * 10)] * 5 + [(2, "a", "w " * 10), (3, "b", "w " * 400_000), (4, "b", "w"), (None, "a", "w w"), (None, "a", "w w")]
    got = [(r["doc_id"], r["source"], r["n_tokens"], r["copies"]) for r in mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()]
    assert len(got) == len(rows) and all(g[3] >= 1 for g in got)
    assert len({g[3] for g in got if g[0] == 1}) == 1 and len({g[3] for g in got if g[0] is None}) == 1
    assert {g[2] for g in got if g[0] == 3} == {400_000}
    cut = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), budget=1000).agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert cut <= 1000
