"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best fit on runs.  Lengths are integers of at most ``seq_len``, so documents and gaps, range-sorted by size, form at most
``seq_len`` runs of equal size each.  A step matches the longest run of waiting pieces with its successor, the smallest run of gaps that
still fits; pieces that want the same gap are resolved by rank (rank r of the pieces takes the gap of
rank r // k, k pieces fitting in one), the gaps are updated to their new sizes, and the next run follows.
The outcome is that of sequential best-fit decreasing.  The dealt method sweeps over documents and gaps as distributed tables in
supersteps; here the steps see only run lengths, at most ``seq_len`` of them whatever the input, and are taken one after another on the driver.  What
grows with the input is distributed: tokens, the ranks within runs (from counts per task and run), and the place of every piece by its rank.

Nulls and edges: null text is empty; every document, the empty one too, gets the closing id, so it
has at least one token; repeated rows and repeated doc_ids are separate documents; equal lengths
are ranked by task and order of reading, which changes only the arbitrary sequence numbers; an empty
table gives no rows.  Only columns ``id_col`` and ``text_col`` are read, others are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.packed import task_number, trim
from lorewell.llm.scratch import BATCH_BYTES, Scratch, modest_batches

#: Words of more characters are not cached; a cache of more words becomes the old generation.
CACHE_WORD_CHARS, CACHE_WORDS = 64, 600_000
#: Characters of text that are tokenised together.
GROUP_CHARS = 8 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank_in_part long, ids binary"


#: Lower-case letters that no normalisation changes while only such letters and spaces stand about them.
_LETTERS = "a-zß-öø-ÿ"
_ended = re.compile(rf"([{_LETTERS}]+)([!-/:-@\[-`{{-~]+)").fullmatch
_plain = re.compile(f"[{_LETTERS}]+").fullmatch
_latin = re.compile("[\\x00-\\xff]*").fullmatch
_tokenizers: dict[str, WordTokens] = {}


class WordTokens:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer normalises, splits and merges within stretches free of white space, and drops the
    white space itself, so a text's ids are those of its words one after another.  Capitals
    are lowered first, and a word that ends with punctuation is letters and punctuation apart: the
    tokenizer does both anyway, and fewer different words are left.  The tokenizer
    is loaded once per Python worker; the words are forgotten with every task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = CACHE_WORDS

    @staticmethod
    def of(path: str, most: int = CACHE_WORDS) -> WordTokens:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokens(path)
        _tokenizers[path].most = most
        return _tokenizers[path]

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def fresh(self, words: set[str]) -> dict[str, bytes]:
        plain = [w for w in words if _plain(w)]
        other = list(words.difference(plain))
        out = {}
        for lo in range(0, len(plain), 50_000):
            own = plain[lo : lo + 50_000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            raw = ids.tobytes()
            if len(ends) == len(own):
                out.update(zip(own, map(raw.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))
            else:  # a vocabulary without word ends
                other += own
        out.update(zip(other, (np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False))))
        return out

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; what is new is tokenised."""
        out = list(map(self.young.get, words))
        missing = [w for w, ids in zip(words, out) if ids is None]
        if not missing:
            return out
        if len(self.young) + len(missing) > self.most:
            self.young, self.old, missing = {}, self.young, words
        back = {w: ids for w, ids in zip(missing, map(self.old.get, missing)) if ids is not None}
        self.young.update(back)
        new = [w for w in missing if w not in back]
        parts = {w: m.groups() for w in new if (m := _ended(w))}
        wanted = {x for p in parts.values() for x in p if x not in self.young}
        self.young.update(self.fresh(wanted.union(w for w in new if w not in parts)))
        get = self.young.__getitem__
        self.young.update((w, get(a) + get(b)) for w, (a, b) in parts.items())
        out = list(map(get, words))
        for w in new:
            if len(w) > CACHE_WORD_CHARS:
                self.young.pop(w, None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = []
        for text in texts:
            if "<|" not in text:  # else a special token's name could be made or broken
                text = text.lower() if _latin(text) else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            whole.append(text.replace("\n", " "))
        words = pc.list_flatten(pc.split_pattern(pa.array([" ".join(whole)], pa.large_string()), " "))
        coded = words.dictionary_encode()
        which, ids = np.asarray(coded.indices), self.known(coded.dictionary.to_pylist())
        size = np.array([len(x) for x in ids], np.int64) // 4
        start = np.cumsum(size) - size
        each = size[which]
        until = np.cumsum(each)
        at = np.repeat(start[which] - until + each, each) + np.arange(until[-1] if len(until) else 0)
        raw = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        last = np.cumsum([t.count(" ") + 1 for t in whole])  # words up to the end of each text
        ends = [0, *(until[last - 1] * 4).tolist()]
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


def plan_best_fit(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where each rank of each length goes: rows (length, rank from, rank to, pieces per sequence,
    first sequence, offset).  ``counts``: pieces by length.  Bounded by seq_len, not by the input."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # of the runs of gaps, ascending
    opened, plan = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                gap, k = seq_len, seq_len // length
                first, n = opened, -(-left // k)
                opened += n
            else:
                gap = sizes[at]
                k = gap // length
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            full = min(n, left // k)
            if full:
                plan.append((length, rank, rank + full * k, k, first, seq_len - gap))
                put(gap - k * length, first, full)
                rank, left = rank + full * k, left - full * k
            if full < n:
                if left:  # fewer than k: one sequence takes the rest
                    plan.append((length, rank, rank + left, left, first + full, seq_len - gap))
                    put(gap - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(gap, first + full, n - full)
    return plan


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, seq_len: int, end_id: int, keep_ids: bool, group_chars: int = GROUP_CHARS, cache_words: int = CACHE_WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, part = WordTokens.of(tokenizer_path, cache_words), np.asarray([end_id], "<u4").tobytes(), task_number()
        seen = np.zeros(seq_len + 1, np.int64)
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
        for batch in batches:
            names, size, lo = batch.column(0).to_pylist(), np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))), 0
            while lo < len(names):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + group_chars)))
                out: list[tuple] = []
                for name, ids in zip(names[lo:hi], tokens.encode([t or "" for t in batch.column(1)[lo:hi].to_pylist()])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * seq_len)):
                        own = ids[at : at + 4 * seq_len]
                        n = len(own) // 4
                        out.append((name, piece, at // 4, n, zlib.crc32(own), part, int(seen[n]), own if keep_ids else None))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part", "ids"])
                lo = hi
        tokens.forget()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def place(plan: list[tuple[int, int, int, int, int, int]]) -> Callable:
    """Sequence and offset by length and rank, for mapInArrow."""
    table = np.array(plan, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << np.int64(40)
        low = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            row = table[np.searchsorted(low, length * wide + rank, "right") - 1] if len(length) else table[:0]
            into = rank - row[:, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(row[:, 4] + into // row[:, 3]), pa.array(row[:, 5] + into % row[:, 3] * length)],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 4096, end_id: int = 1, keep_ids: bool = False, group_chars: int = GROUP_CHARS, cache_words: int = CACHE_WORDS, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit,
    when ``keep_ids``), sequence_id, offset.  Documents longer than ``seq_len`` are cut.  ``group_chars`` of text are tokenised at a time,
    ``cache_words`` words remembered (twice that, with those of the old generation), and ``batch_bytes`` sent to a worker at a time: less of them needs less memory and more time."""
    store = Scratch(docs.sparkSession, "packing")
    modest_batches(docs.sparkSession, batch_bytes)
    pieces = store.write(cut_pieces(docs, tokenizer_path, id_col, text_col, seq_len, end_id, keep_ids, group_chars, cache_words), "pieces")
    runs = store.write(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "runs")
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, (F.col("first") + F.col("rank_in_part")).alias("rank"))
    extra = ", ids binary" if keep_ids else ""
    return ranked.mapInArrow(place(plan_best_fit(counts, seq_len)), f"doc_id long, piece int, start long, length long, ids_crc32 long{extra}, sequence_id long, offset long")
