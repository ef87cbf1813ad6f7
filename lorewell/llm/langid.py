"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased letters; everything else is a single space.  The n-grams of 2 to
``max_n`` characters (single characters if that is 1) are hashed into ``2**bits`` features.  Document frequencies come from all
labelled documents of the learning fold.  The weights are trained with follow-the-regularised-leader
and elastic-net penalties on a bounded sample of these documents, a fifth of which is held back to fit the temperature:
the ``max_train`` with the smallest hash of their id, and of each language at least the ``each`` with the smallest, so that a
rare language is learned, too.

Nulls and edges: a null text, or one without a letter, gets ``und`` with score 0; rows with null
language are never learned from; a null id is never held out nor learned from; without any labelled
row everything is ``und``; texts are read whole, very long ones in pieces; repeated rows each get
their own row; other columns pass through unread, clashing names are replaced by the new columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.packed import trim
from lorewell.llm.scratch import modest_batches

PIECE_CHARS = 1 << 20
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point of the first plane: its lower case if it is a letter, else a space."""
    if not _letters:
        table = np.full(0x10000, 32, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def letters_only(text: str, after_space: bool = False) -> np.ndarray:
    """Code points: lower-case letters and single spaces; no space at the start if one stands before."""
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = letter_table()
    out = table[np.minimum(at, 0xFFFF)]
    for i in np.flatnonzero(at > 0xFFFF):
        c = chr(at[i])
        out[i] = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else 32
    return out[(out != 32) | np.concatenate(([not after_space], out[:-1] != 32))] if len(out) else out


def feature_counts(text: str, bits: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs; the text stands between two spaces."""
    dim, shift, least = 1 << bits, np.uint32(32 - bits), min(2, max_n)
    text = f" {text} "
    every, held = None, np.zeros(0, np.uint32)  # the last characters of the piece before, for n-grams across the border
    for lo in range(0, len(text), PIECE_CHARS):
        new = letters_only(text[lo : lo + PIECE_CHARS], len(held) > 0 and held[-1] == 32)
        own, ids = np.concatenate([held, new]), []
        h = np.zeros(len(own), np.uint32)
        for n in range(1, max_n + 1):
            h = (h[: len(own) - n + 1] * np.uint32(0x9E3779B1) + own[n - 1 :] + np.uint32(n)) if len(own) >= n else h[:0]
            if n >= least:
                fresh = h[max(0, len(held) - n + 1) :]  # those that end in this piece
                ids.append((fresh * np.uint32(0x85EBCA6B) ^ (fresh >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> shift)
        at = np.concatenate(ids)
        if len(text) <= PIECE_CHARS and len(at) < 6000:
            return np.unique(at, return_counts=True)
        counted = np.bincount(at, minlength=dim)
        every = counted if every is None else every + counted
        held = own[max(0, len(own) - max(1, max_n - 1)) :]
    found = np.flatnonzero(every)
    return found, every[found]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float
    bits: int
    max_n: int

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found, n = feature_counts(text, self.bits, self.max_n)
        x = np.log1p(n) * self.idf[found]
        return found, x / max(np.sqrt((x * x).sum()), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        found, x = self.vector(text)
        p = softmax((x @ self.weights[found] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for multinomial logistic regression."""

    def __init__(self, dim: int, k: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((dim + 1, k)), np.zeros((dim + 1, k))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    # targets as in Platt's scaling, so that rows which are all right do not ask for certainty
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), labels] = 1 - (k - 1) / (n + k)

    def loss(log_t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-12))).sum(1).mean())

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 16, max_n: int = 3, max_train: int = 4000, each: int = 50, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.001, seed: int = 1
) -> LanguageModel:
    """Learns only from text and non-null language of the rows of ``docs``."""
    dim = 1 << bits
    modest_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")).filter("text is not null and lang is not null and id is not null").drop("id")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[feature_counts(text, bits, max_n)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], ["feature", "n"])
        trim()

    counts = rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most 2**bits + 1 rows
    n_docs = sum(r["n"] for r in counts if r["feature"] < 0)
    df = np.zeros(dim)
    for r in counts:
        if r["feature"] >= 0:
            df[r["feature"]] = r["n"]
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    least = rows.select("h").orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    # each task keeps its smallest of a language before they meet
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rare = rows.withColumn("r", rank).filter(F.col("r") <= each).filter(F.col("h") > least) if least is not None else None
    sample = [] if least is None else rows.filter(F.col("h") <= least).limit(max_train).select("h", "lang", "text").unionByName(rare.select("h", "lang", "text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [feature_counts(t, bits, max_n) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0].astype("<u4").tobytes() for g in got], pa.binary()), pa.array([np.log1p(g[1]).astype("<f4").tobytes() for g in got], pa.binary())], ["h", "lang", "at", "x"])
        trim()

    got = sorted(sample.mapInArrow(features, "h long, lang string, at binary, x binary").collect()) if n_docs else []
    langs = sorted({r["lang"] for r in got})
    model = Ftrl(dim, max(1, len(langs)), alpha, beta, l1, l2)
    data = []
    for r in got:
        at = np.frombuffer(r["at"], "<u4").astype(np.int64)
        x = np.frombuffer(r["x"], "<f4") * idf[at]
        x = x / max(np.sqrt((x * x).sum()), 1e-12)
        data.append((np.append(at, dim), np.append(x, 1.0), langs.index(r["lang"])))
    back, learned = data[::5], [d for i, d in enumerate(data) if i % 5] or data
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(learned)):
            model.learn(*learned[i])
    w = model.weights()
    t = fit_temperature(np.array([x @ w[at] for at, x, _ in back]).reshape(len(back), -1), np.array([y for *_, y in back], np.int64)) if langs else 1.0
    return LanguageModel(langs, idf.astype(np.float32), w[:dim].astype(np.float32), w[dim], t, bits, max_n)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits features x languages
    kept = [c for c in docs.columns if c not in (lang_name, score_name)]
    docs = docs.select(*kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{lang_name}` string", f"`{score_name}` double"])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*kept, lang_name, score_name])
        trim()

    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    fold = docs.filter(F.crc32(F.col(id_col).cast("string")) % 3 != 1)
    model = train(fold, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    return identify(rows, model, text_col).drop(text_col)
