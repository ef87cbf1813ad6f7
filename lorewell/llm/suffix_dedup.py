"""Removal of repeated byte strings by hash counting of suffixes behind a difference-cover filter.

A byte goes if it is covered by a string of ``length`` bytes which also starts anywhere else.

1.  Cover samples.  D is a perfect difference cover modulo v = 133 (12 residues): for any two
    positions i and j some shift s < v puts both i + s and j + s into the cover.  The strings of
    length - (v - 1) bytes at cover positions are told repeated or not by their hash (they get no ranks); one
    that isn't repeated proves that no string which contains it repeats.  Only suffixes near a repeated sample stay.
2.  Blocks of suffixes.  The remaining suffixes are dealt into buckets, and the buckets are taken
    one range at a time, so that disk and memory hold one range, never all suffixes.  Within a bucket
    64-bit hashes of the suffixes' first ``length`` bytes are sorted, not the suffixes (only equality is
    needed, not their order, so there are no ties to resolve by ranks: a departure from the dealt method, see the README).
3.  Equal neighbours in that order are repeats; each suffix's answer goes back to its block, where
    covered bytes are removed.

Nulls and edges: null text is empty; strings never cross documents; repeated rows are separate
documents, so they repeat each other; documents shorter than ``length`` lose nothing; an empty table
gives no rows; very long documents are worked on in pieces of ``CHUNK`` bytes.  Columns other than
``id_col`` and ``text_col`` are ignored.  Equal hashes are not verified by bytes: about
(suffixes near repeats)**2 / 2**65 wrong equalities are expected in the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.packed import BLOCK_SCHEMA, EMIT_SCHEMA, buckets_bits, emit_batch, exchange, pack_blocks, prefix_hash, rows, span_hash, squeeze, unsqueeze, with_replies
from lorewell.llm.scratch import Scratch

#: Perfect difference cover: every residue modulo PERIOD is a difference of two of these (fixed values).
PERIOD = 133
COVER = (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110)

CHUNK = (1 << 20) - 4096
#: Hashes per bucket.
BUCKET_ENTRIES = 500_000
#: One range of buckets holds at most so many bytes of suffix hashes for each byte of text.
RANGE_SHARE = 0.6


def _window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of data[s : s + length] for ascending starts."""
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, max(1, len(data)), CHUNK):
        a, b = np.searchsorted(starts, (lo, lo + CHUNK))
        if a < b:
            prefix = prefix_hash(data[lo : lo + CHUNK + length])
            own = starts[a:b] - lo
            out[a:b] = span_hash(prefix, own, own + length)
    return out


def _cover_positions(lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of a block at which ``width`` bytes stay within the document; its start there."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = (np.arange(0, total, PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[at < total]
    doc = np.searchsorted(ends, at, "right")
    keep = at + width <= ends[doc]
    return at[keep], (ends - lens)[doc[keep]]


def _sample_keys(row: dict, width: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(unsqueeze(row["data"]), np.uint8)
    at, start = _cover_positions(np.asarray(row["lens"], np.int64), width)
    keys, inverse, n = np.unique(_window_hashes(data, at, width), return_inverse=True, return_counts=True)
    return data, at, start, keys, inverse, n


def _repeats(keys: list[np.ndarray], vals: list[bytes]) -> list[bytes]:
    """For each array of distinct keys, bits: found twice in its block (as vals says) or in any two blocks."""
    twice = [np.frombuffer(v, np.uint8).astype(bool) for v in vals]
    every = np.sort(np.concatenate(keys))
    known = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[k[t] for k, t in zip(keys, twice)]]))
    out = []
    for k in keys:
        at = np.minimum(np.searchsorted(known, k), max(0, len(known) - 1))
        hit = known[at] == k if len(known) else np.zeros(len(k), bool)
        out.append(np.packbits(hit).tobytes())
    return out


def _bits(replies: list[bytes], counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=int(n)) for r, n in zip(replies, counts)]).astype(bool) if len(counts) else np.zeros(0, bool)


def _bucket_counts(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.unique((keys >> np.uint64(64 - bits)), return_counts=True)[1]


def _covered(at: np.ndarray, width: int, total: int) -> np.ndarray:
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", range_share: float = RANGE_SHARE) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (array of struct<start, end>, the maximal removed
    runs in bytes), kept (binary: the remaining bytes)."""
    if length < PERIOD + 16:
        raise ValueError(f"length must be at least {PERIOD + 16}")
    spark = docs.sparkSession
    width = length - (PERIOD - 1)
    store = Scratch(spark, "suffix")
    blocks = store.write(pack_blocks(docs, id_col, text_col), "blocks", "none")
    total = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = buckets_bits(total * len(COVER) // PERIOD, BUCKET_ENTRIES)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            *_, keys, _, n = _sample_keys(row, width)
            yield emit_batch(row["block"], keys, (n > 1).astype(np.uint8), bits)

    classes = store.write(exchange(blocks.mapInArrow(samples, EMIT_SCHEMA), _repeats), "classes")
    store.release()

    def near(row: dict, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        data, at, start, keys, inverse, _ = _sample_keys(row, width)
        again = _bits(replies, _bucket_counts(keys, bits))[inverse]
        lens = np.asarray(row["lens"], np.int64)
        ends, edge = np.cumsum(lens), np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, np.maximum(at[again] - (PERIOD - 1), start[again]), 1)
        np.add.at(edge, at[again] + 1, -1)
        mask = np.cumsum(edge[:-1]) > 0
        for a, b in zip(np.maximum(ends - lens, ends - length + 1), ends):  # no whole string starts there
            mask[a:b] = False
        a, b = _runs(mask)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["block"]], pa.int64()), pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([row["lens"]], pa.list_(pa.int64())), pa.array([row["data"]], pa.binary()), pa.array([squeeze(np.stack([a, b]).astype(np.int64).tobytes())], pa.binary()), pa.array([int(mask.sum())], pa.int64())],
            ["block", "ids", "lens", "data", "near", "n_near"],
        )

    marked = store.write(with_replies(blocks, classes, near, BLOCK_SCHEMA + ", near binary, n_near long"), "near", "none")
    store.drop(blocks, classes)
    suffixes = marked.agg(F.sum("n_near")).first()[0] or 0
    bits2 = buckets_bits(suffixes, BUCKET_ENTRIES)
    ranges = 1 << min(bits2, max(0, int(np.ceil(np.log2(max(1, suffixes * 8 / max(1, total * range_share)))))))
    per = 1 << (bits2 - ranges.bit_length() + 1)  # buckets in a range

    def suffix_keys(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(unsqueeze(row["data"]), np.uint8)
        a, b = np.frombuffer(unsqueeze(row["near"]), np.int64).reshape(2, -1)
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        return data, at, _window_hashes(data, at, length)

    def suffixes_of(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows(batches):
                if row["n_near"]:
                    keys = suffix_keys(row)[2]
                    which = keys >> np.uint64(64 - bits2)
                    keys, n = np.unique(keys[(which >= k * per) & (which < (k + 1) * per)], return_counts=True)
                    if len(keys):
                        yield emit_batch(row["block"], keys, (n > 1).astype(np.uint8), bits2)

        return run

    found = []
    for k in range(ranges):
        found.append(store.write(exchange(marked.mapInArrow(suffixes_of(k), EMIT_SCHEMA), _repeats), f"repeats{k}"))
        store.release()
    repeats = found[0]
    for more in found[1:]:
        repeats = repeats.unionByName(more)

    def cut(row: dict, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        data, at, keys = suffix_keys(row)
        uniq, inverse = np.unique(keys, return_inverse=True)
        again = at[_bits(replies, _bucket_counts(uniq, bits2))[inverse]]
        gone = _covered(again, length, len(data))
        ends = np.cumsum(np.asarray(row["lens"], np.int64))
        out: list[tuple] = []
        held = 0
        for i, (name, n, end) in enumerate(zip(row["ids"], row["lens"], ends)):
            mask = gone[end - n : end]
            a, b = _runs(mask)
            own = data[end - n : end]
            out.append((name, n, [{"start": int(x), "end": int(y)} for x, y in zip(a, b)], (own[~mask] if len(a) else own).tobytes()))
            held += n
            if held > CHUNK or i + 1 == len(ends):
                yield _spans_batch(out)
                out, held = [], 0

    return with_replies(marked, repeats, cut, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def _spans_batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "removed", "kept"])


def kept_digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the lowercase hex SHA-256 of the remaining bytes."""
    return spans.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
