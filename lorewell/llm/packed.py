"""Packed blocks: many documents in one row, and exchanges of packed hash arrays.

Work on every n-gram or suffix of a corpus would need one JVM row for each.  Here a row holds a
block of documents (about ``BLOCK_BYTES`` of text), and what has to meet by key is sent as sorted
64-bit arrays, one for each (block, hash bucket).  The reducer of a bucket sees each key at most
once per block, so a key which a third of all documents hold costs one entry per block, not one
per document.  It answers every array it got with an array of the same length; blocks and answers
meet again by block number.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: Documents in a block at most: a document is known by ``block << 20 | its place in the block``.
BLOCK_DOCS = 1 << 19

BLOCK_SCHEMA = "block long, ids array<long>, lens array<long>, data binary"
EMIT_SCHEMA = "bucket long, block long, keys binary, vals binary"
REPLY_SCHEMA = "block long, bucket long, reply binary"


def squeeze(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def text_views(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and its offsets (n + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Give freed memory back to the system at a task's end, as Python workers live on and share their
    executor's memory with the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of BLOCK_SCHEMA: whole documents, null text as empty, ids as they are (null included).

    A document longer than ``block_bytes`` gets a block of its own.  Block numbers are unique."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq = task_number(), 0
        ids: list = []
        lens: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, lens, parts, held
            data = b"".join(p.tobytes() for p in parts)
            row = pa.RecordBatch.from_arrays(
                [pa.array([(number << 20) | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(lens)], pa.list_(pa.int64())), pa.array([squeeze(data)], pa.binary())],
                ["block", "ids", "lens", "data"],
            )
            seq, ids, lens, parts, held = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            raw, at = text_views(batch.column(1))
            names, lo = batch.column(0).to_pylist(), 0
            while lo < len(names):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block_bytes - held, "right")) - 1)
                hi = min(hi, len(names), lo + BLOCK_DOCS - len(ids))
                if held and at[hi] - at[lo] + held > block_bytes:
                    yield flush()
                    continue
                ids += names[lo:hi]
                lens.append(np.diff(at[lo : hi + 1]))
                parts.append(raw[at[lo] : at[hi]].copy())
                held += int(at[hi] - at[lo])
                lo = hi
                if held >= block_bytes or len(ids) >= BLOCK_DOCS:
                    yield flush()
        if ids:
            yield flush()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, BLOCK_SCHEMA)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Consecutive rows with equal ``key``; the input must be sorted by it."""
    now, held = None, []
    for row in rows(batches):
        if held and row[key] != now:
            yield now, held
            held = []
        now = row[key]
        held.append(row)
    if held:
        yield now, held


def emit_batch(block: int, keys: np.ndarray, vals: np.ndarray | None, bits: int, low: int | None = None) -> pa.RecordBatch:
    """One row for each bucket of the sorted, distinct ``keys``.  The bucket is the top ``bits`` of the 64, or, with
    ``low`` = 32, all but the lowest 32 bits, and then only these 32 are sent as the key."""
    if low is None:
        which = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    else:
        which, keys = (keys >> np.uint64(low)).astype(np.int64), keys.astype(np.uint32)
    found, first = np.unique(which, return_index=True)
    ends = np.append(first[1:], len(keys))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(found, pa.int64()),
            pa.array(np.full(len(found), block, np.int64), pa.int64()),
            pa.array([keys[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
            pa.array([b"" if vals is None else vals[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
        ],
        ["bucket", "block", "keys", "vals"],
    )


def exchange(emitted: DataFrame, reduce: Callable[[list[np.ndarray], list[bytes]], list[bytes]], kind: type = np.uint64) -> DataFrame:
    """Bring the arrays of each bucket together; ``reduce`` answers each (keys, vals) with bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in grouped(batches, "bucket"):
            replies = reduce([np.frombuffer(r["keys"], kind) for r in held], [r["vals"] for r in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"] for r in held], pa.int64()), pa.array([bucket] * len(held), pa.int64()), pa.array(replies, pa.binary())],
                ["block", "bucket", "reply"],
            )
        trim()

    return emitted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, REPLY_SCHEMA)


def with_replies(blocks: DataFrame, replies: DataFrame, fn: Callable[[dict, list], Iterator[pa.RecordBatch]], schema: str, numbered: bool = False) -> DataFrame:
    """``fn(block row, its replies in bucket order)`` for every block; ``numbered``: as (bucket, reply)."""
    names = blocks.columns
    kinds = dict(blocks.dtypes)
    left = blocks.select(*names, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("reply"))
    right = replies.select(*[F.col("block") if n == "block" else F.lit(None).cast(kinds[n]).alias(n) for n in names], F.lit(0).alias("kind"), "bucket", "reply")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        block = None
        for row in rows(batches):
            if row["block"] != block:
                block, held = row["block"], []
            if row["kind"] == 0:
                held.append((row["bucket"], row["reply"]) if numbered else row["reply"])
            else:
                yield from fn({n: row[n] for n in names}, held)
                held = []
        trim()

    both = left.unionByName(right).repartition("block").sortWithinPartitions("block", "kind", "bucket")
    return both.mapInArrow(run, schema)


def buckets_bits(total: int, each: int, least: int = 6) -> int:
    """Bits so that a bucket holds about ``each`` of ``total`` entries."""
    return max(least, int(np.ceil(np.log2(max(1, total / each)))))


# --- hashes of byte windows -------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
BYTE_VALUES = _byte_values(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << int(np.ceil(np.log2(max(n, 1 << 16))))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum over data[i:j] of value * base**position."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# --- words ------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
HASH_CHUNK = (1 << 20) - 4096
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mixed_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: eight bytes at a time, each step mixed before the next, so that strings which agree in
    their sums (as power series with two letters do) are told apart.  Strings of up to eight bytes never share one with those of their length."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    going = np.flatnonzero(size > 0)
    done = 0
    while len(going):
        left = size[going] - done
        out[going] = mix((out[going] ^ (eight[starts[going] + done] & _TAILS[np.minimum(left, 8)])) * np.uint64(0xD6E8FEB86659FD93))
        done += 8
        going = going[left > 8]
    return out


def word_hashes(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lowered) of documents that stand one after
    another in ``data``, and where each document's words begin (n + 1)."""
    inside = ~_SPACE[data]
    borders = np.concatenate(([0], np.cumsum(lens)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = borders[(borders > 0) & (borders < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(data), HASH_CHUNK):
        i, j = np.searchsorted(starts, (lo, lo + HASH_CHUNK))
        if i < j:
            out[i:j] = mixed_hash(_LOWER[data[lo : ends[j - 1]]], starts[i:j] - lo, ends[i:j] - lo)
    return out, np.searchsorted(starts, borders)


def chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a word sequence that goes on with one more word."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(0x632BE59BD9B4E019))
