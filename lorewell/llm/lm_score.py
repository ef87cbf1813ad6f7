"""Language-model scoring with stupid backoff, every document against the rest of the corpus.

N-grams of 1 to ``order`` words are exploded within blocks of documents and dealt by hash; each hash
bucket is a partition of the n-gram count table, which sums the blocks' counts and is joined back to the
n-grams that asked for them.  Buckets are taken one range at a time, so that disk holds one range.
A document's own occurrences are taken off the counts (else every n-gram had been seen), then

    S(w | context) = c(context w) / c(context)      if c(context w) > 0
                   = backoff * S(w | shorter context) otherwise;  S(w) = c(w) / N,

an unseen word counting as ``unseen`` occurrences.  A document's score is the mean log10 of S.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; n-grams do not cross documents.  Nulls and edges: null
or blank text has no words and a null score; repeated rows count as different documents, so they
have seen each other; a corpus of one document has seen nothing; an empty table gives no rows;
other columns are ignored.  N-grams are told apart by 64-bit hashes: of g different ones, about g**2 / 2**65 pairs share a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.packed import EMIT_SCHEMA, buckets_bits, chain, emit_batch, exchange, mix, pack_blocks, rows, squeeze, unsqueeze, with_replies, word_hashes
from lorewell.llm.scratch import Scratch

BUCKET_ENTRIES = 500_000
#: One range of buckets holds at most so many bytes of hashes for each byte of text.
RANGE_SHARE = 0.6


def gram_hashes(row: dict, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams by order, the documents they are in, and where each document's words begin."""
    words, at = word_hashes(np.frombuffer(unsqueeze(row["data"]), np.uint8), np.asarray(row["lens"], np.int64))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    grams, docs = [], []
    h = np.zeros(len(words), np.uint64)
    for n in range(order):
        h = chain(h[: max(0, len(words) - n)], words[n:])
        inside = doc[: len(h)] == doc[n:] if n else slice(None)
        grams.append(mix(h[inside] + np.uint64(n + 1)))
        docs.append(doc[: len(h)][inside])
    return grams, docs, at


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, backoff: float = 0.4, unseen: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_words, n_seen (n-grams of the highest order that others hold), score."""
    store = Scratch(docs.sparkSession, "backoff")
    blocks = store.write(pack_blocks(docs, id_col, text_col), "blocks", "none")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            grams, *_ = gram_hashes(row, order)
            yield pa.RecordBatch.from_arrays([pa.array([len(grams[0])], pa.int64()), pa.array([int(sum(map(len, grams)))], pa.int64()), pa.array([len(row["data"])], pa.int64())], ["words", "grams", "size"])

    sizes = blocks.mapInArrow(counted, "words long, grams long, size long").agg(F.sum("words"), F.sum("grams")).first()
    n_words, n_grams = sizes[0] or 0, sizes[1] or 0
    text_bytes = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = buckets_bits(n_grams, BUCKET_ENTRIES)
    ranges = 1 << min(bits, max(0, int(np.ceil(np.log2(max(1, n_grams * 8 / max(1, text_bytes * RANGE_SHARE)))))))
    per = 1 << (bits - ranges.bit_length() + 1)

    def grams_of(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows(batches):
                every = np.concatenate(gram_hashes(row, order)[0])
                which = every >> np.uint64(64 - bits)
                keys, n = np.unique(every[(which >= k * per) & (which < (k + 1) * per)], return_counts=True)
                if len(keys):
                    yield emit_batch(row["block"], keys, n.astype(np.uint32), bits)  # a block has fewer words

        return run

    def table(keys: list[np.ndarray], vals: list[bytes]) -> list[bytes]:
        every, n = np.concatenate(keys), np.concatenate([np.frombuffer(v, np.uint32) for v in vals])
        order_of = np.argsort(every, kind="stable")
        new = np.concatenate(([True], every[order_of][1:] != every[order_of][:-1]))
        sums = np.add.reduceat(n[order_of].astype(np.int64), np.flatnonzero(new))
        total = np.empty(len(every), np.int64)
        total[order_of] = sums[np.cumsum(new) - 1]
        ends = np.cumsum([len(k) for k in keys])
        return [squeeze(total[e - len(k) : e].astype("<u8").tobytes()) for k, e in zip(keys, ends)]

    found = []
    for k in range(ranges):
        found.append(store.write(exchange(blocks.mapInArrow(grams_of(k), EMIT_SCHEMA), table), f"counts{k}"))
        store.release()
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)

    def score(row: dict, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        grams, docs_of, at = gram_hashes(row, order)
        every, owners = np.concatenate(grams), np.concatenate(docs_of)
        n_docs, out = len(at) - 1, np.full(len(at) - 1, np.nan)
        seen = np.zeros(n_docs, np.int64)
        if len(every):
            total = np.concatenate([np.frombuffer(unsqueeze(r), "<u8") for r in replies]).astype(np.int64)
            _, inverse = np.unique(every, return_inverse=True)
            _, own_at, own = np.unique(inverse * np.int64(n_docs) + owners, return_inverse=True, return_counts=True)
            rest = total[inverse] - own[own_at]  # what other documents hold
            ends = np.cumsum([len(g) for g in grams])
            parts = [rest[e - len(g) : e] for g, e in zip(grams, ends)]
            words = np.diff(at)
            others = n_words - np.repeat(words, words)
            value = np.where(parts[0] > 0, parts[0], unseen) / np.maximum(others, 1)
            whole = np.full((order, len(value)), 0, np.int64)  # counts of the n-gram that ends at each word
            for n in range(order):
                whole[n][(np.arange(len(value)) - np.repeat(at[:-1], words)) >= n] = parts[n]
            for n in range(1, order):
                context = np.concatenate(([0], whole[n - 1][:-1]))
                known = whole[n] > 0
                there = (np.arange(len(value)) - np.repeat(at[:-1], words)) >= n
                value = np.where(known, whole[n] / np.maximum(context, 1), np.where(there, backoff * value, value))
            full = words > 0
            out[full] = np.add.reduceat(np.log10(value), at[:-1][full]) / words[full]
            np.add.at(seen, docs_of[-1], parts[-1] > 0)
        words = np.diff(at)
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(words.astype(np.int64)), pa.array(seen), pa.array(out, mask=words == 0)], ["doc_id", "n_words", "n_seen", "score"])

    done = with_replies(blocks, counts, score, "doc_id long, n_words long, n_seen long, score double")
    return done.select("doc_id", "n_words", "n_seen", F.round("score", 6).alias("score"))
