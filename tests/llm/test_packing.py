import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm.packing import WordTokens, pack_documents, plan_best_fit
from lorewell.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokens():
    return WordTokens.of(tokenizer_path())


def same(tokens, texts):
    for text, raw in zip(texts, tokens.encode(texts)):
        assert tokens.tokenizer.encode(text, add_special_tokens=False).ids == np.frombuffer(raw, "<u4").tolist(), text


def test_tokens_are_those_of_the_tokenizer(tokens):
    same(tokens, ["", " ", "\n\n", "Don't stop. It's ... ok.. a., b ,c I'LL we've", "x<|endoftext|>y <|ENDOFTEXT|>", "Straße. ÀÉ*** é. á .́ ΣΑΣ İ ǅ ½ \x1c a\x1fb\tc\r\nd", "日本語 テスト。 ok", "a" * 5000, "word " * 3000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'.,* \ńéÉßσΣ<|>1"), st.characters()), max_size=40), min_size=1, max_size=4))
def test_tokens_of_any_text(tokens, texts):
    same(tokens, [t.encode("utf-8", "ignore").decode() for t in texts])


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_the_plan_is_sequential_best_fit(counts):
    gaps = []  # best-fit decreasing, one at a time
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                gaps.append(64 - n)
    plan = plan_best_fit(counts, 64)
    used = {}
    for length, lo, hi, k, first, offset in plan:
        for r in range(hi - lo):
            used.setdefault(first + r // k, []).append((offset + r % k * length, length))
    assert sorted(64 - sum(x for _, x in v) for v in used.values()) == sorted(gaps)
    for v in used.values():
        assert [o for o, _ in sorted(v)] == list(np.cumsum([0] + [x for _, x in sorted(v)])[:-1])
    assert {n: sum(hi - lo for ln, lo, hi, *_ in plan if ln == n) for n in counts} == counts


def test_packing(spark, make_docs, tokens):
    docs = make_docs([(1, "a b c"), (2, None), (2, None), (None, ""), (3, "word " * 100), (4, "d e"), (4, "d e")])
    got = pack_documents(docs, tokenizer_path(), seq_len=16, keep_ids=True).toPandas()
    want = {}
    for i, text in [(r["doc_id"], r["text"] or "") for r in docs.collect()]:
        ids = [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 16):
            want.setdefault((i, p // 16), []).append(ids[p : p + 16])
    assert sum(map(len, want.values())) == len(got)
    for r in got.itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.piece)
        assert ids in want[key] and r.length == len(ids) and r.start == r.piece * 16 and r.ids_crc32 == zlib.crc32(r.ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 16
    assert got.sequence_id.nunique() == -(-got.length.sum() // 16)


def test_no_documents(spark, make_docs):
    assert pack_documents(make_docs([]), tokenizer_path()).count() == 0
