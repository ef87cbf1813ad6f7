import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lorewell.llm.components import components
from lorewell.llm.ngram_join import choose_level, similar_documents
from lorewell.llm.scratch import Scratch
from lorewell.llm.vector_dedup import near_vectors

from .conftest import prose


def classes(rows, width, percent):
    """Brute force: shingle sets, all pairs, smallest id of a component by row."""
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if top(k) == top(i) and rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if sets[i] and ids else doc_id))
    return out


def edited(text, n, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def check(make_docs, rows, width, percent):
    got = similar_documents(make_docs(rows), width=width, percent=percent).collect()
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=key) == sorted(classes(rows, width, percent), key=key)
    kept = [r["component_id"] for r in got if r["kept"] and r["n_shingles"]]
    assert len(kept) == len(set(kept)) and len([k for k in kept if k is not None]) == len({r["component_id"] for r in got if r["n_shingles"] and r["component_id"] is not None})


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_groups_of_near_copies_and_a_common_passage(make_docs, width, percent):
    base, passage = prose(1, 150), prose(2, 60)
    rows = [(i, edited(base, 1 + i % 6, i)) for i in range(60)]  # around the limit
    rows += [(100 + i, passage + " " + prose(1000 + i, 30 + i % 40)) for i in range(60)]
    rows += [(200 + i, prose(3, 80)) for i in range(5)] + [(300 + i, prose(4000 + i, 50)) for i in range(20)]
    rows += [(400 + i, edited(edited(base, 4, 77), i % 3, 500 + i)) for i in range(20)]
    check(make_docs, rows, width, percent)


def test_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE TWO"), (8, "one two three"), (9, "é"), (10, "É"), (11, "x\x0by\x0cz w"), (11, "x y z w"), (12, "one two three"), (12, "one two three"), (None, "one"), (None, "q w e r")]
    check(make_docs, rows, 3, 90)
    assert similar_documents(make_docs([])).count() == 0


def test_a_very_long_text(make_docs):
    text = prose(9, 60_000)
    rows = [(1, text), (2, edited(text, 900, 1)), (3, edited(text, 3000, 2)), (4, text + " end")]
    check(make_docs, rows, 3, 90)


def test_a_costly_prefix_grows():
    light = np.array([1] * 5 + [1] * 20)
    assert choose_level(light, 5, 21)[0] == 1
    heavy = np.array([1000] * 4 + [1] * 21)
    level, where = choose_level(heavy, 5, 21)
    assert level >= 5 - 1 and not set(where) & {0, 1, 2, 3}


def test_components(spark):
    store = Scratch(spark, "test")
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long"), store).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long"), store).count() == 0


def vectors(n, seed, dim=64):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = np.random.default_rng(i // 6).standard_normal(dim)
        rows.append((i, (base + draw.uniform(0.1, 0.45) * draw.standard_normal(dim)).astype(np.float32).tolist(), int(i % 3)))
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(40)]  # equal ones
    rows += [(n + 100, None, 1), (n + 101, [0.0] * dim, 1), (n + 102, [float("nan")] * dim, 1), (n + 103, [None] * dim, 1), (n + 104, rows[0][1], None), (n + 105, [1.0, 2.0], 0), (n + 106, [1.0, 2.0], 0), (n + 107, [], 0)]
    return rows


def brute(rows, threshold):
    out, up = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    def unit(v):
        if v is None or not v or any(x is None for x in v):
            return None
        v = np.asarray(v, float)
        return v / np.linalg.norm(v) if np.isfinite(v).all() and np.abs(v).max() > 0 else None

    good = [(i, unit(v), lab) for i, v, lab in rows if lab is not None]
    good = [g for g in good if g[1] is not None]
    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[:a]:
            if p == q and len(x) == len(y) and x @ y >= threshold:
                out[i] += 1
                out[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    return out, {k: top(k) for k in out}


def test_near_vectors(spark):
    rows = vectors(600, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'z' as key", "1 as n")
    want, comp = brute(rows, 0.93)
    got = {r["vec_id"]: r for r in near_vectors(df, block=64).collect()}
    assert set(got) == set(want)
    short = {605 + 100, 606 + 100}  # another length: their own equals are found, too
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.98 * sum(want.values())
    assert all(got[k]["n_links"] <= want[k] for k in want if k not in short)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert np.mean([got[k]["component_id"] == comp[k] for k in comp]) > 0.98
    assert near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_several_lengths(spark):
    rows = [(1000 * k + i, v, lab) for k, dim in enumerate((64, 16, 3)) for i, v, lab in vectors(300, 5, dim)[:300]]
    rows += [(9000, np.random.default_rng(1).standard_normal(5000).astype(np.float32).tolist(), 0)]  # one malformed longer vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want, comp = brute(rows, 0.93)
    assert all(sum(want[r[0]] for r in rows if len(r[1]) == dim) for dim in (64, 16, 3))
    got = {r["vec_id"]: r for r in near_vectors(df, exact_upto=512).collect()}  # without codes: nothing is missed
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == {k: (want[k], comp[k]) for k in want}
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, block=32).collect()}
    assert all(got[k] <= want[k] for k in want)
    for dim in (64, 16, 3):
        of = [r[0] for r in rows if len(r[1]) == dim]
        assert sum(got[k] for k in of) >= 0.98 * sum(want[k] for k in of)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables here")
def test_codes_decide_on_the_given_table(spark, monkeypatch):
    """The given vectors with noisy copies of them: few a label, and yet all by codes."""
    from lorewell.llm import vector_dedup

    made = []
    monkeypatch.setattr(vector_dedup, "rotations", lambda *a, f=vector_dedup.rotations: made.append(a) or f(*a))
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    draw = np.random.default_rng(4)
    rows = given + [(10**6 + i, (np.asarray(v) + draw.standard_normal(len(v)) * np.linalg.norm(v) * s / np.sqrt(len(v))).tolist(), lab) for i, v, lab in given for s in (0.1, 0.3, 0.36)]
    want, _ = brute(rows, 0.93)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93)
    links = Counter()
    for r in got.collect():
        links[r["vec_id"]] += r["n_links"]
    assert made and sum(want.values()) > 500
    assert all(links[k] <= n for k, n in want.items() if k < 10**6) and sum(links.values()) >= 0.98 * sum(want.values())


def test_words_of_two_letters_do_not_share_hashes(spark):
    """Words which agree in every sum modulo 2**64 of powers of an odd base."""
    word, other = "a", "b"
    for _ in range(10):
        word, other = word + other, other + word
    rows = similar_documents(spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 1}


def test_rows_far_from_their_centre_do_not_leave_as_pairs(make_docs, monkeypatch):
    """Copies, each with edits of its own: by their prefixes any two may link, of which none or a few do."""
    from lorewell.llm import ngram_join

    seen = []

    def counted(rest, *args, f=ngram_join._candidates):
        before = rest.count()
        out = f(rest, *args)
        seen.append((before, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    base = prose(1, 150)
    rows = [(i, edited(base, 10, i)) for i in range(150)]
    rows += [(200 + i, edited(rows[i][1], 1 + i % 3, 700 + i)) for i in range(0, 80, 8)]  # near some of them
    check(make_docs, rows, 3, 90)
    assert len(seen) == 1 and 150 < seen[0][0] and 100 < seen[0][1] <= 2 * seen[0][0]


def test_parts_of_a_block_and_their_settling_in_several_blocks(make_docs, monkeypatch):
    from lorewell.llm import ngram_join

    near = np.zeros((7, 7), bool)
    for a, b in [(0, 3), (3, 5), (1, 6)]:
        near[a, b] = near[b, a] = True
    assert ngram_join.parts_of(near).tolist() == [0, 1, -1, 0, -1, 0, 1]
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    base = prose(1, 150)
    rows = [(i, edited(base, 16, i % 30)) for i in range(60)]
    rows = [(i, edited(text, i % 4, 900 + i)) for i, text in rows]
    check(make_docs, rows, 3, 90)
