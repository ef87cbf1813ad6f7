"""Spelling variants by full neighbourhood generation.

Every string one edit away from each vocabulary word is made: all different deletions, replacements and insertions over the
characters observed in the vocabulary.  A made string that equals a vocabulary word is a near word, by the join alone: no distance is
computed.  As either of two near words makes the other, what a word was made from are its near words.

Made strings are hashed as they are made (rolling sums, no string yet) and looked up in a Bloom filter of the vocabulary, of at
most ``filter_bytes`` whatever the vocabulary: a string that isn't in it equals no word, so none is lost.  The
rest become strings, are counted within each task by the string, and meet the vocabulary by a shuffled hash join, which settles
them exactly.  With a vocabulary far above the filter's size it lets more through, which costs shuffle, not results.

Words get numbers in the order of their count (greatest first, ties by the word), so that the near word of the largest count is the one of the
smallest number.  Forms lead to words at least ``ratio`` times as frequent, so chains are shorter than the number of digits of the
greatest count, and following them takes the binary logarithm of that many joins.

Nulls and edges: a null or empty text has no words; a null id counts as the empty string; words are taken whole, however long, from whole
texts; repeated rows count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.packed import mix, trim
from lorewell.llm.scratch import Scratch

#: Bytes of the Bloom filter at most; it is sent to every Python worker.
FILTER_BYTES = 8 << 20
#: Words for each task that makes neighbours, and made strings looked up at a time.
WORDS_A_TASK, MADE_AT_ONCE = 20_000, 1 << 20
LETTERS = "A-Za-zÀ-ÿ"

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 modulo 8: its powers do not repeat early
_DOWN = np.uint64(pow(_BASE, -1, 1 << 64))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2, noise: int = 31) -> DataFrame:
    """(word, n): the words of at least ``least_chars`` letters that occur ``least_count`` times.  In every ``noise``-th occurrence,
    by the checksum of id and word, one letter is missing (the test noise that comes with the query; 0: none)."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    word = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if noise:
        runs = runs.select("id", word.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % noise == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points (a row each) of the words of each length."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(lens):
        at = np.flatnonzero(lens == size)
        codes = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32)
        yield at, codes.reshape(len(at), size)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Rolling sums of value * base**place, one column more than characters."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(_values(codes) * _powers(codes.shape[1]), axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def _finish(sums: np.ndarray, size: int) -> np.ndarray:
    return mix(sums + np.uint64(size * _BASE % (1 << 64)))


class Bloom:
    """Two probes in ``1 << bits`` bits."""

    def __init__(self, bits: int, held: np.ndarray | None = None):
        self.bits, self.held = bits, held

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return hashes & low, (hashes >> np.uint64(64 - self.bits)) & low

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """The places in ``hashes`` of those that may be words."""
        first, second = self.places(hashes)
        there = np.flatnonzero(self._bit(first))
        return there[self._bit(second[there])]

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def word_filter(words: DataFrame, n_words: int, filter_bytes: int = FILTER_BYTES) -> Bloom:
    """The Bloom filter of a vocabulary, put together by Spark in pieces of 4 KB and gathered (``filter_bytes`` at most)."""
    bits = min(int(math.log2(filter_bytes * 8)), max(16, math.ceil(math.log2(max(1, n_words) * 64))))
    empty = Bloom(bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _by_length(batch.column(0).to_pylist()):
                both = np.concatenate(empty.places(_finish(_sums(codes)[:, -1], codes.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(both.astype(np.int64))], ["place"])

    piece = 1 << 15
    pieces = words.select("word").mapInArrow(places, "place long").groupBy(F.floor(F.col("place") / piece).alias("piece")).agg(F.bitmap_construct_agg(F.col("place") % piece).alias("held"))
    held = np.zeros((1 << bits) // 8, np.uint8)
    for row in pieces.collect():
        part = np.frombuffer(row["held"], np.uint8)[: piece // 8]
        held[row["piece"] * (piece // 8) :][: len(part)] = part
    return Bloom(bits, held)


def neighbours(codes: np.ndarray, alphabet: np.ndarray, bloom: Bloom) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, made code points) of the different strings one edit away from each row of ``codes`` that the filter lets pass.

    Within a run of equal characters only the first is deleted, and a character is put in only where the one before differs,
    so that no string is made twice."""
    n, size = codes.shape
    power, values, letters = _powers(size + 1), _values(codes), _values(alphabet)
    sums = _sums(codes)
    whole, down, up = sums[:, -1], _DOWN, np.uint64(_BASE)
    step = max(1, MADE_AT_ONCE // max(1, n * len(alphabet)))

    def passed(hashes: np.ndarray, allowed: np.ndarray, made_size: int) -> tuple[np.ndarray, ...]:
        found = bloom.has(_finish(hashes, made_size).ravel())
        found = found[allowed.ravel()[found]]
        return np.unravel_index(found, hashes.shape)

    for lo in range(0, size + 1, step):
        hi = min(lo + step, size)
        if lo < hi:
            # deletions
            made = sums[:, lo:hi] + (whole[:, None] - sums[:, lo + 1 : hi + 1]) * down
            fresh = np.ones(made.shape, bool)
            before = codes[:, max(lo - 1, 0) : hi - 1] if lo else codes[:, : hi - 1]
            fresh[:, (0 if lo else 1) :] = codes[:, max(lo, 1) : hi] != before
            row, at = passed(made, fresh, size - 1)
            yield row, _without(codes[row], at + lo)
            # replacements
            rest = whole[:, None] - values[:, lo:hi] * power[lo:hi]
            made = rest[:, :, None] + letters[None, None, :] * power[lo:hi][None, :, None]
            row, at, letter = passed(made, codes[:, lo:hi, None] != alphabet[None, None, :], size)
            out = codes[row]
            out[np.arange(len(row)), at + lo] = alphabet[letter]
            yield row, out
        # insertions before place lo .. end
        end = min(lo + step, size + 1)
        rest = sums[:, lo:end] + (whole[:, None] - sums[:, lo:end]) * up
        made = rest[:, :, None] + letters[None, None, :] * power[lo:end][None, :, None]
        fresh = np.ones(made.shape, bool)
        skip = 0 if lo else 1
        fresh[:, skip:, :] = codes[:, lo + skip - 1 : end - 1, None] != alphabet[None, None, :]
        row, at, letter = passed(made, fresh, size + 1)
        yield row, _with(codes[row], at + lo, alphabet[letter])


def _without(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    keep = np.arange(codes.shape[1])[None, :] != at[:, None]
    return codes[keep].reshape(len(codes), codes.shape[1] - 1)


def _with(codes: np.ndarray, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
    out = np.empty((len(codes), codes.shape[1] + 1), np.uint32)
    own = np.arange(codes.shape[1] + 1)[None, :] == at[:, None]
    out[~own] = codes.ravel()
    out[own] = letters
    return out


def _strings(codes: np.ndarray) -> pa.Array:
    if not codes.size:
        return pa.array([], pa.string())
    return pa.array(np.ascontiguousarray(codes).view(f"<U{codes.shape[1]}").ravel(), pa.string())


def near_words(words: DataFrame, n_words: int, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n_near, best): how many words are near each word that has any, and the smallest number among them.
    ``words``: (key, word, n), a table, numbers ascending from the most frequent word."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint32)  # at most one for each character of Unicode
    shared = spark.sparkContext.broadcast(word_filter(words, n_words, filter_bytes))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for batch in batches:
            keys, texts = np.asarray(batch.column(0), np.int64), batch.column(1).to_pylist()
            for at, codes in _by_length(texts):
                few = max(1, MADE_AT_ONCE // max(1, len(alphabet) * codes.shape[1]))
                for lo in range(0, len(at), few):
                    for row, made in neighbours(codes[lo : lo + few], alphabet, bloom):
                        if len(row):
                            yield pa.RecordBatch.from_arrays([_strings(made), pa.array(keys[at[lo : lo + few][row]])], ["word", "key"])
        trim()

    tasks = max(1, math.ceil(n_words / WORDS_A_TASK))
    made = words.select("key", "word").repartition(tasks, "key").mapInArrow(make, "word string, key long")
    met = made.groupBy("word").agg(F.count("*").alias("n_near"), F.min("key").alias("best"))
    return words.select("word").join(met, "word")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2, ratio: int = 10, noise: int = 31, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row a vocabulary word: word, form (its near word of the largest count, if that is at least ``ratio`` times its own), root (where forms
    lead; itself without one), n, n_near, form_n."""
    if ratio < 2:
        raise ValueError("forms need a ratio of 2 or more, else they may lead back")
    store = Scratch(docs.sparkSession, "spelling")
    counted = store.write(vocabulary(docs, id_col, text_col, least_chars, least_count, noise), "counted")
    size = counted.agg(F.count("*"), F.max("n")).first()
    n_words, most = size[0], size[1] or 1
    tasks = max(1, math.ceil(n_words / (5 * WORDS_A_TASK)))
    words = store.write(counted.repartitionByRange(tasks, F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word")).select(F.monotonically_increasing_id().alias("key"), "word", "n"), "words")
    near = words.join(near_words(words, n_words, filter_bytes), "word", "left")
    forms = words.select(F.col("key").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    found = store.write(near.join(forms, "best", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "found")
    roots = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = 1 + int(math.log(most) / math.log(ratio))  # forms one after another
    for k in range(math.ceil(math.log2(longest))):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = store.write(roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots{k}")
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
