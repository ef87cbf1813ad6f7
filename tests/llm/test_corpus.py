import hashlib
import random
import re
from collections import Counter
from math import log, log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.llm import fingerprint as FP
from lorewell.llm.chat import format_chats
from lorewell.llm.langid import feature_counts, identify, predict_languages, train
from lorewell.llm.line_dedup import drop_boilerplate
from lorewell.llm.lm_score import score_documents
from lorewell.llm.mixing import mix_sources
from lorewell.llm.suffix_dedup import COVER, PERIOD, kept_digest, repeated_spans

from .conftest import prose


def test_the_cover_covers():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(make_docs):
    p = prose(1, 60)
    texts = [p + " " + prose(2, 30), prose(3, 40) + p[7:] + "é" * 30, p, p, None, "", "short", "ab" * 400, prose(4, 50) + p[:199], prose(5, 30) + "ü" + p[20:230] + prose(6, 20) + p[100:320], prose(7, 300)]
    got = kept_digest(repeated_spans(make_docs(list(enumerate(texts))))).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(removed(texts, 200)))
    assert kept_digest(repeated_spans(make_docs([]))).count() == 0


def test_suffix_dedup_takes_bucket_ranges(make_docs):
    p = prose(11, 400)
    texts = [p + prose(i, 20) for i in range(8)] + [None]
    rows = [(None, t) for t in texts]
    got = kept_digest(repeated_spans(make_docs(rows), 160, range_share=0.05)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(removed(texts, 160))


def test_lm_scores(make_docs):
    rows = [(1, "the cat sat on the mat"), (2, "the cat sat on the dog"), (3, "A dog"), (4, None), (5, "  "), (6, "the cat sat on the mat"), (7, "Zebra zebra zebra"), (7, "dog")]
    words = [re.findall(r"\S+", (t or "").lower()) for _, t in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in words]
    total, n_all = sum(grams, Counter()), sum(map(len, words))
    want = []
    for (i, _), w, own in zip(rows, words, grams):
        c = lambda g: total[g] - own[g]  # noqa: E731,B023

        def s(ctx, x, c=c, w=w):
            if not ctx:
                return (c((x,)) or 0.5) / max(1, n_all - len(w))
            return c((*ctx, x)) / c(ctx) if c((*ctx, x)) else 0.4 * s(ctx[1:], x)

        want.append((i, len(w), sum(1 for k in range(2, len(w)) if c(tuple(w[k - 2 : k + 1]))), round(sum(log10(s(tuple(w[max(0, k - 2) : k]), x)) for k, x in enumerate(w)) / len(w), 5) if w else None))
    got = [(r["doc_id"], r["n_words"], r["n_seen"], None if r["score"] is None else round(r["score"], 5)) for r in score_documents(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert score_documents(make_docs([])).count() == 0


def test_line_dedup(spark):
    rows = [(i, "a" if i < 10 else None, f"menu\nown line {i}\n\n  menu \nrare {i % 5}") for i in range(20)] + [(20, "a", None), (21, "b", "menu\nx"), (22, "b", "")]
    pages = spark.createDataFrame(rows, "doc_id long, host string, text string").withColumn("lines", F.lit(1)).withColumn("n_lines", F.lit(9))
    got = {r["doc_id"]: r for r in drop_boilerplate(pages, F.col("host"), ratio=0.5).collect()}
    assert len(got) == 23 and got[0]["lines"] == 1
    assert all(got[i]["text"] == f"own line {i}\n\nrare {i % 5}" and (got[i]["n_lines"], got[i]["n_dropped"]) == (5, 2) for i in range(20))
    assert got[20]["text"] is None and got[21]["text"] == "menu\nx" and got[22]["text"] == ""
    assert drop_boilerplate(pages.limit(0), F.col("host")).count() == 0


def test_line_dedup_counts_every_page(spark):
    long = "\n".join(f"line {k} of a long page" for k in range(60_000))
    rows = [(i, "small", f"menu\npage {i}") for i in range(4)] + [(10 + i, "copies", "one\ntwo") for i in range(9)] + [(30, "alone", "one\ntwo"), (31, "long", long), (32, "long", f"line 7 of a long page\n{prose(1, 9)}")]
    rows += [(40 + i, "even", "at the ratio" if i < 2 else f"other {i}") for i in range(40)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, host string, text string"), F.col("host")).collect()}
    assert all(got[i] == (f"page {i}", 1) for i in range(4))
    assert all(got[10 + i] == ("", 2) for i in range(9)) and got[30] == ("one\ntwo", 0)
    assert got[31] == (long.replace("line 7 of a long page\n", ""), 1) and got[32] == (prose(1, 9), 1)
    assert got[40] == ("at the ratio", 0)


def test_mixing(spark):
    rows = [(i, "big", "w " * (5 + i % 7)) for i in range(300)] + [(1000 + i, "mid", "w " * 6) for i in range(60)] + [(2000 + i, None, "w w w") for i in range(10)] + [(3000, "mid", None), (3001, "none", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit(1)).withColumn("copies", F.lit(7))
    got = mix_sources(docs, entropy_share=0.8, max_epochs=4.0).collect()
    assert len(got) == len(rows) and all(r["copies"] >= 1 for r in got)
    by = {}
    for r in got:
        t, m = by.get(r["source"], (0, 0))
        by[r["source"]] = (t + r["n_tokens"], m + r["n_tokens"] * r["copies"])
    epochs = {s: m / t for s, (t, m) in by.items() if t}
    assert epochs["big"] == 1.0 and 1.0 < epochs["mid"] < epochs[None] <= 4.0
    total = sum(m for _, m in by.values())
    entropy = -sum(m / total * log(m / total) for _, m in by.values() if m)
    natural = [t / sum(x for x, _ in by.values()) for t, _ in by.values() if t]
    assert entropy > -sum(p * log(p) for p in natural)
    half = mix_sources(docs, max_epochs=4.0, budget=1000).collect()
    assert 900 < sum(r["n_tokens"] * r["copies"] for r in half) <= 1000
    assert mix_sources(docs.limit(0)).count() == 0


def chats(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, set()).add((-1 if t is None else t, role or "", text or ""))
    convs = {c: sorted(v) for c, v in convs.items()}
    keep = [c for c, v in convs.items() if not any((len(w) > len(v) and w[: len(v)] == v and w[len(v)][0] > v[-1][0]) or (w == v and d < c) for d, w in convs.items() if d != c)]
    return {c: "".join(f"<|{r}|>\n{x}\n<|end|>\n" for _, r, x in convs[c]) for c in keep}


def test_chat_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "ok")]
    rows = [(c, i, r, x) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for i, (r, x) in enumerate(talk[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, None, None, None), (8, 0, "user", "hi"), (8, 0, "user", "hi"), (None, 0, "user", "x"), (9, 3, "user", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    for chunk in (256, 2):
        got = {}
        for r in sorted(format_chats(df, chunk=chunk).collect(), key=lambda r: (r["conv_id"], r["part"])):
            got[r["conv_id"]] = got.get(r["conv_id"], "") + r["text"]
        assert got == chats(rows)
    assert format_chats(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.text(max_size=300))
def test_fingerprints_tell_texts_apart(a, b):
    a, b = (x.encode("utf-8", "ignore").decode() for x in (a, b))
    x, y = FP.fingerprint(a), FP.fingerprint(b)
    assert (x == y) == (a == b) and 0 <= FP.likeness(x, y) <= 1 and FP.likeness(x, x) == 1.0


def test_edits_are_located():
    text = "one two three.\nfour five\n\nsix seven\neight"
    assert FP.edit_spans(FP.fingerprint(text), FP.fingerprint(text.replace("eight", "nine"))) == [(1, 1)]


def test_fingerprints(make_docs):
    rows = [(5, prose(1, 120)), (2, None), (9, "é" * 7), (7, prose(2, 80) + ".\n" + prose(3, 40)), (11, "a"), (12, "")]
    got = {r["doc_id"]: r for r in FP.fingerprint_documents(make_docs(rows)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == FP.fingerprint(t) and r["edited_fingerprint"] == FP.fingerprint(changed)
        assert r["near_edited"] == FP.likeness(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == FP.likeness(r["fingerprint"], FP.fingerprint(after))
    assert FP.fingerprint_documents(make_docs([])).count() == 0
    assert FP.fingerprint_documents(make_docs([(1, "x"), (1, "x"), (None, "y"), (1, "z")])).count() == 4
    assert FP.fingerprint_documents(make_docs([(1, "alone")])).first()["near_next"] == 1.0


LINES = st.lists(st.sampled_from(["one line of it", "another, longer line that stands here", "", "x", prose(1, 30), prose(2, 30)]), max_size=12)


@settings(max_examples=80, deadline=None)
@given(LINES, LINES)
def test_likeness_lies_between_common_lines_and_common_bytes(a, b):
    """Brute force on the texts: whole lines in common are alike, and nothing is that isn't in both."""
    x, y = "\n".join(a), "\n".join(b)
    got = FP.likeness(FP.fingerprint(x), FP.fingerprint(y))
    if x == y:
        assert got == 1.0
        return
    most = max(sum(map(len, a)), sum(map(len, b)))
    lines = sum(len(line) * n for line, n in (Counter(a) & Counter(b)).items())
    chars = sum((Counter("".join(a)) & Counter("".join(b))).values())
    assert (lines / most if most else 0) <= got + 1e-12 and got <= (chars / most if most else 0) + 1e-12


def test_branches_that_an_edit_changed():
    text = "a b c\nd e\n\nf g\nh"
    assert FP.edit_spans(FP.fingerprint(text), FP.fingerprint(text + " i\nj")) == [(1, 1), (1, 2)]
    assert FP.edit_spans(FP.fingerprint(text), FP.fingerprint(text)) == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 30])
def test_ranges_of_ids(spark, n):
    cuts = sorted({7 * i % 101 for i in range(n)})
    got = spark.range(-2, 110).select("id", FP._ranked(cuts, F.col("id")).alias("r")).collect()
    assert all(r["r"] == sum(c <= r["id"] for c in cuts) for r in got)


def test_likeness_without_spaces_or_stops():
    def like(a, b):
        return FP.likeness(FP.fingerprint(a), FP.fingerprint(b))

    r = random.Random(5)
    chinese, other = ("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(2000)) for _ in range(2))
    assert 0.45 < like(chinese, chinese[:1000] + other[:1000]) < 0.55
    long, new = (r.randbytes(5_000_000).hex() for _ in range(2))  # 10 MB without a space
    assert 0.49 < like(long, long[:5_000_000] + new[:5_000_000]) < 0.51
    line = prose(4, 2000)
    assert like(line, line[:40] + " inserted" + line[40:]) > 0.98
    mixed = long[:6000] + " " + prose(6, 100)  # a long stretch counts by its length
    assert like(mixed, long[:6000] + " " + prose(7, 100)) > 0.8


def test_grains_are_whole_and_keep_to_their_lines():
    texts = ["", "\n", "a", "x" * 3000, "\n\n" + prose(1, 300) + "\n" + prose(2, 3) + "\n\n", prose(3, 40_000) + "\n" + prose(4, 260_000), "ab\n" * 5000]
    for text in texts:
        grains, line = FP._grains(np.frombuffer(text.encode(), np.uint8))
        lengths = np.bincount(line, grains[:, 4], minlength=text.count("\n") + 1)
        assert lengths.tolist() == [len(x) for x in text.split("\n")]
    marks = [FP.fingerprint(x + prose(5, 30) + y).split("|", 2)[2] for x, y in (("", ""), (prose(6, 90) + "\n", "\n" + prose(7, 9)))]
    assert marks[1].split(";")[1] == marks[0]


@pytest.fixture(scope="module")
def labelled(spark):
    vocab = {"en": "the and house street water light".split(), "de": "der und haus straße wasser öffnung".split(), "fr": "le et maison été lumière français".split()}
    rows = [(i, prose(i, 25, vocab[lang]).translate({ord(c): None for c in "0123456789"}), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "the house", None), (None, "das haus und der", "de"), (903, "", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark, labelled):
    got = {r["doc_id"]: r for r in predict_languages(labelled).collect()}
    want = {r["doc_id"]: r["lang"] for r in labelled.collect()}
    from zlib import crc32

    assert all(r["held_out"] == (k is not None and crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [k for k, r in got.items() if r["held_out"] and k < 900]
    assert held and sum(got[k]["lang_pred"] == want[k] for k in held) / len(held) > 0.95
    assert {got[k]["lang_pred"] for k in (900, 901, 903)} == {"und"} and got[902]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert predict_languages(labelled.limit(0)).count() == 0
    model = train(labelled.filter("lang is null"))
    assert {r["lang_pred"] for r in identify(labelled.withColumn("score", F.lit("x")), model).collect()} == {"und"}
    learnt = train(labelled)
    assert (learnt.weights == 0).mean() > 0.5 and learnt.temperature > 0  # the penalty leaves most weights out


@pytest.mark.parametrize("max_n", [1, 2, 3, 4])
def test_long_texts_are_counted_in_pieces(monkeypatch, max_n):
    texts = [prose(5, 3000), "  a" * 2000 + "  ", "", "é1!" * 1500, "\U00010400x " * 900]
    for text in texts:
        whole = dict(zip(*map(list, feature_counts(text, 16, max_n))))
        for size in (1, 2, 7, 1000):
            if size >= 1000 or len(text) < 7000:
                with monkeypatch.context() as m:
                    m.setattr("lorewell.llm.langid.PIECE_CHARS", size)
                    assert dict(zip(*map(list, feature_counts(text, 16, max_n)))) == whole


def test_a_rare_language_is_learned(spark):
    vocab = {"en": "the and house street water light".split(), "de": "der und haus straße wasser öffnung".split()}
    text = lambda i, lang: prose(i, 15, vocab[lang]).translate({ord(c): None for c in "0123456789"})
    rows = [(i, text(i, "en"), "en") for i in range(3000)] + [(5000 + i, text(i, "de"), "de") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["p"] for r in identify(docs, train(docs, max_train=500), "text", "p").collect()}
    assert sum(got[5000 + i] == "de" for i in range(4)) >= 3 and sum(got[i] == "en" for i in range(3000)) > 2950


def test_a_conversation_without_turns_is_rendered_in_parts(spark):
    df = spark.range(700).selectExpr("1 as conv_id", "cast(null as long) as turn", "'user' as role", "concat('x', lpad(id, 4, '0')) as text").unionByName(spark.sql("select 2 as conv_id, cast(5 as long) as turn, 'a' as role, 'b' as text"))
    got = sorted((r["conv_id"], r["part"], r["n_turns"], r["text"]) for r in format_chats(df).collect())
    assert [g[:3] for g in got] == [(1, 0, 256), (1, 1, 256), (1, 2, 188), (2, 0, 1)]
    assert "".join(g[3] for g in got[:3]) == "".join(f"<|user|>\nx{i:04}\n<|end|>\n" for i in range(700))


def test_counts_beyond_32_bits(monkeypatch, make_docs):
    from lorewell.llm import lm_score

    totals, real = [], lm_score.exchange

    def exchange(emitted, reduce):
        keys, most = np.array([5], np.uint64), np.array([2**32 - 1], np.uint32).tobytes()
        totals.append(int(np.frombuffer(lm_score.unsqueeze(reduce([keys] * 3, [most] * 3)[0]), "<u8")[0]))
        return real(emitted, reduce)

    monkeypatch.setattr(lm_score, "exchange", exchange)
    assert lm_score.score_documents(make_docs([(1, "a a"), (2, "a")])).count() == 2
    assert set(totals) == {3 * (2**32 - 1)}
