"""Quality rules, phrases and spelling variants against brute force, with nulls, ties, repeated rows and empty tables."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from lorewell.llm import collocations, quality_rules as Q, spelling

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a a a a", "x y z", "# * $ %\n# * $ %\n\n \n#", "Éa éa Éa éa Éa éa", prose(1, 60), prose(2, 60) + "\n" + prose(2, 60), "same line here\n" * 40, prose(3, 30_000), "long" * 200_000, "- item one two\n- item three", "wait...\nand so...", "one\x0btwo\x0cthree\rfour"]


def test_ledger(spark, make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)] + [(9, TEXTS[9]), (None, "null id")])
    got = Q.judge_documents(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measured(text), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert {r["doc_id"] for r in got if r["kept"]} == {9, 12}
    assert Q.judge_documents(docs.limit(0)).count() == 0


def test_policies_and_ablations_from_the_bits_alone(spark, make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)])
    book = Q.ledger(docs, carry=("doc_id", "lang", "n_words")).cache()
    assert "n_words" in book.columns and book.columns.count("n_words") == 1
    rows = book.collect()
    for p in Q.POLICIES:
        assert {r["doc_id"] for r in book.filter(Q.kept_by(p)).collect()} == {r["doc_id"] for r in rows if not r["fails"] & p.mask()}
    bits = {r.name: 1 << r.bit for r in Q.RULES}
    for by in ((), ("lang",)):
        for r in Q.ablations(book, by=by).collect():
            mask = next(p for p in Q.POLICIES if p.version == r["version"]).mask()
            own = [x["fails"] & mask for x in rows]
            without = mask & ~bits[r["rule"]]
            assert (r["n_docs"], r["n_kept"], r["n_kept_without"]) == (len(rows), own.count(0), sum(not x["fails"] & without for x in rows))
            assert (r["n_failed"], r["n_failed_alone"]) == (sum(1 for x in own if x & bits[r["rule"]]), own.count(bits[r["rule"]]))
    assert len({r.bit for r in Q.RULES}) == len(Q.RULES)


def phrases(docs, least, top, longest=5):
    """(text, lang) rows to the expected report."""
    counts, words = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        own = {g: n for g, n in c.items() if n >= least}
        inside = defaultdict(int)
        for g, n in own.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    inside[g[i : i + size]] = max(inside[g[i : i + size]], n)
        found = []
        for g, a in own.items():
            if len(g) > 1 and not (g in inside and 100 * inside[g] >= 100 * a):
                score, cut = min((int(Fraction(1000 * a * words[lang], c[g[:k]] * c[g[k:]])), k) for k in range(1, len(g)))
                found.append((score, a, " ".join(g), c[g[:cut]], c[g[cut:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, r, words[lang], s) for i, (s, a, p, left, r) in enumerate(found[:top])]
    return out


def _texts():
    import random

    r = random.Random(5)
    kit = "of the house and green water Deep blue sea é x".split()
    made = []
    for i in range(300):
        w = []
        while len(w) < 60:
            w += r.choice([["Deep", "blue", "sea"], ["green", "water"], ["of", "the"], [r.choice(kit)], [r.choice(kit) + str(r.randrange(30))], ["x", "x", "x"]])
        made.append("".join(x + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for x in w))
    return [(t, r.choice(["en", "de", None])) for t in made] + [(made[0], "en")] * 40 + [(None, "en"), ("", "fr"), (" . ,", "fr"), ("a b " * 20_000, "en")]


@pytest.mark.parametrize("block_bytes", [2000, 4 << 20])
def test_phrases(spark, block_bytes):
    rows = _texts()
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, phrase int").repartition(5)
    got = [tuple(r) for r in collocations.mine_phrases(docs, least=30, top=25, block_bytes=block_bytes).collect()]
    want = phrases(rows, 30, 25)
    assert len(want) > 40 and sorted(got) == sorted(want)
    assert collocations.mine_phrases(docs.limit(0)).count() == 0


def test_phrase_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of 10**15: the products have 34 digits."""
    big = 10**15
    counts = spark.createDataFrame([("en", 1, "a", 3 * big), ("en", 1, "b", 7 * big), ("en", 2, "a b", 2 * big + 1)], "lang string, k int, phrase string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: counts)
    monkeypatch.setattr(collocations, "distinct_pieces", lambda *_: spark.createDataFrame([("en", "a", 9 * 10**17)], "lang string, piece string, n long"))
    (got,) = collocations.mine_phrases(spark.createDataFrame([("a", "en")], "text string, lang string")).collect()
    assert got["score"] == 1000 * (2 * big + 1) * 9 * 10**17 // (21 * big * big)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, noise=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k > 1}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: (b if (b := min(vs, key=lambda v: (-n[v], v))) and n[b] >= 10 * n[w] else None) if (vs := close[w]) else None for w in n}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


def test_variants(spark, make_docs):
    import random

    r = random.Random(3)
    base = ["aaaaaaa", "wonderful", "beautiful", "straßeén", "mississippi", "Étranger", "aabbaabb"]
    rows = []
    for i in range(400):
        w = []
        for _ in range(12):
            x = r.choice(base[:3] if r.random() < 0.8 else base)
            for _ in range(r.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                at, c = r.randrange(len(x)), r.choice("aelsté")
                x = r.choice([x[:at] + x[at + 1 :], x[:at] + c + x[at + 1 :], x[:at] + c + x[at:]])
            w.append(x)
        rows.append((i, r.choice([" ", "-", "1"]).join(w)))
    rows += [(7, rows[7][1]), (None, "wonderful beautiful"), (500, None), (501, ""), (502, "z" * 3000 + " wonderfu"), (503, "z" * 3000 + " " + "z" * 2999), (504, "z" * 2999)]
    want = variants(rows)
    assert any(x[1] and x[1] != x[2] for x in want)  # a chain of forms
    docs = make_docs(rows)
    for filter_bytes in (8 << 20, 8 << 10):  # the second lets much pass, and nothing changes
        got = spelling.group_variants(docs, filter_bytes=filter_bytes)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(x) for x in got.collect()} == want
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_neighbourhoods_are_whole_and_without_repeats():
    import numpy as np

    class All(spelling.Bloom):
        def has(self, hashes):
            return np.arange(len(hashes))

    letters = np.array([ord(c) for c in "abc"], np.uint32)
    for word in ("a", "aab", "abcabc", "bbbb"):
        codes = np.array([[ord(c) for c in word]], np.uint32)
        made = [s for _, out in spelling.neighbours(codes, letters, All(16)) for s in spelling._strings(out).to_pylist()]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abc"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abc"}
        assert sorted(x for x in made if x) == sorted(want - {word, ""})
