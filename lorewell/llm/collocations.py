"""Phrases whose words stand together more often than their parts would by chance.

1. Texts are cut into pieces at punctuation and line ends, and equal pieces of a language become one with a multiplicity, so that
   copies and repeated lines are read once from here on.  Pieces are packed into blocks.
2. A filter: each block sends the hashes of its different words and pairs of words with their weighted counts (no more than the minimum,
   which decides alone) to hash buckets.  duckdb sums them in each bucket, out of core, and answers each block with those that
   reach the minimum.  A hash may let too much pass, never too little.
3. The counts: each block writes out, as text, the n-grams that passed and the longer ones all of whose pairs passed (a phrase is no more
   frequent than its pairs), one row for each and block, sent sorted and compressed.  duckdb sums them by the text itself, a hash bucket at a time and out of
   core.  These counts are exact, whatever the hashes did.
4. Each candidate asks for the counts of its first and last parts at every cut.  The requests are shuffled to the count table; nothing
   of it is broadcast.

duckdb runs inside the tasks, on one bucket's rows at a time, with one thread and a bound on its memory; what it spills lies in the task's own
folder, is read by nobody else and goes when the task ends.

A-Z are lowered; pieces are divided by ``[.,;:!?\\x0A-\\x0D]`` and words are ``[^\\x20\\x09]+``.  Everything is counted per language.  Nulls and
edges: a null text is empty and has no phrase, a null language is ``und``; repeated rows count again; overlapping occurrences all count;
texts and pieces are taken whole, however long; equal scores at several cuts go to the shortest first part; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.packed import REPLY_SCHEMA, buckets_bits, chain, emit_batch, mix, mixed_hash, rows, squeeze, task_number, text_views, trim, unsqueeze, with_replies
from lorewell.llm.scratch import Scratch

BORDERS = "[.,;:!?\\x0A-\\x0D]"
#: Bytes of pieces in a block; hashes in a bucket of the filter; duckdb's memory in a task before it spills.
BLOCK_BYTES, BUCKET_ENTRIES, DUCKDB_MB = 2 << 20, 2_000_000, 128
#: Rows handed to duckdb at a time.
ROWS_AT_ONCE = 1 << 17

_BLOCK = "block long, langs array<string>, words array<long>, lang array<int>, n array<long>, lens array<long>, data binary"
_COUNTED = "lang string, k int, phrase string, n long"


def distinct_pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): the different pieces that have a word, words divided by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), ""))
            lists = pc.split_pattern_regex(texts, BORDERS)
            piece = pc.ascii_trim(pc.list_flatten(lists), " \t")
            lang = pc.take(batch.column(0), pc.list_parent_indices(lists))
            worded = pc.greater(pc.binary_length(piece), 0)
            piece, lang = pc.filter(piece, worded), pc.filter(lang, worded)
            if pc.any(pc.or_(pc.match_substring(piece, "  "), pc.match_substring(piece, "\t"))).as_py():
                piece = pc.replace_substring_regex(piece, "[ \\t]+", " ")
            same = pa.table({"lang": lang, "piece": piece}).group_by(["lang", "piece"]).aggregate([([], "count_all")])
            for part in same.select(["lang", "piece", "count_all"]).to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.string()), part.column(2)], ["lang", "piece", "n"])
        trim()

    pieces = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).mapInArrow(cut, "lang string, piece string, n long")
    return pieces.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def pack_pieces(pieces: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of pieces, with the words of each language."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq, held, size = task_number(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size
            table = pa.Table.from_batches(held)
            coded = table.column("lang").combine_chunks().dictionary_encode()
            lang, piece, n = np.asarray(coded.indices, np.int32), table.column("piece").combine_chunks(), np.asarray(table.column("n"), np.int64)
            of_piece = np.asarray(pc.add(pc.count_substring(piece, " "), 1), np.int64) * n
            words = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(words, lang, of_piece)
            lens = np.asarray(pc.binary_length(piece), np.int64)
            data = squeeze("".join(piece.to_pylist()).encode())
            row = [[(number << 20) | seq], [coded.dictionary.to_pylist()], [words], [lang], [n], [lens], [data]]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            seq, held, size = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["block", "langs", "words", "lang", "n", "lens", "data"])

        for batch in batches:
            lo = 0
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), np.int64))
            while lo < batch.num_rows:
                begun = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begun + block_bytes - size, "right")))
                held.append(batch.slice(lo, hi - lo))
                size, lo = size + int(ends[hi - 1] - begun), hi
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()
        trim()

    return pieces.select("lang", "piece", "n").mapInArrow(pack, _BLOCK)


class Grams:
    """The n-grams of one block: different ones have different numbers, settled by the words and not by hashes."""

    def __init__(self, row: dict):
        self.data = unsqueeze(row["data"])
        raw, lens = np.frombuffer(self.data, np.uint8), np.asarray(row["lens"], np.int64)
        borders = np.concatenate(([0], np.cumsum(lens)))
        begins = np.zeros(len(raw) + 1, bool)
        begins[borders[:-1]] = True
        begins[np.flatnonzero(raw == 32) + 1] = True
        self.starts = np.flatnonzero(begins[:-1])
        self.piece = np.searchsorted(borders, self.starts, "right") - 1
        follows = np.append(self.starts[1:], len(raw))
        self.ends = follows - (raw[np.maximum(follows - 1, 0)] == 32)
        self.langs = row["langs"]
        self.lang, self.weight = np.asarray(row["lang"], np.int64)[self.piece], np.asarray(row["n"], np.int64)[self.piece]
        # a word's text, told apart exactly
        offsets = np.empty(2 * len(self.starts) + 1, np.int64)
        offsets[0:-1:2], offsets[1::2], offsets[-1] = self.starts, self.ends, len(raw)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])
        coded = pc.take(words, pa.array(np.arange(0, 2 * len(self.starts), 2))).dictionary_encode()
        self.word, self.kinds = np.asarray(coded.indices, np.int64), len(coded.dictionary)
        first = np.zeros(self.kinds, np.int64)
        first[self.word[::-1]] = np.arange(len(self.word))[::-1]
        self.word_hash = mixed_hash(raw, self.starts[first], self.ends[first])
        of_lang = pa.array([x.encode() for x in self.langs], pa.binary())
        joined, sizes = b"".join(of_lang.to_pylist()), np.asarray(pc.binary_length(of_lang), np.int64)
        at = np.concatenate(([0], np.cumsum(sizes)))
        self.lang_hash = mixed_hash(np.frombuffer(joined, np.uint8), at[:-1], at[1:])

    def inside(self, k: int) -> np.ndarray:
        """Places where k words of one piece begin."""
        n = len(self.piece) - k + 1
        return np.flatnonzero(self.piece[: max(n, 0)] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def number(self, k: int, at: np.ndarray) -> np.ndarray:
        """A number for each different n-gram of k words among those at ``at``; equal where language and words are equal."""
        out = self.lang[at]
        for i in range(k):
            out = pd.factorize(out * self.kinds + self.word[at + i])[0].astype(np.int64)
        return out

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        h = self.lang_hash[self.lang[at]]
        for i in range(k):
            h = chain(h, self.word_hash[self.word[at + i]])
        return mix(h + np.uint64(k))

    def counted(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each place, and each different n-gram's first place and weighted count."""
        numbers = self.number(k, at)
        kinds = int(numbers.max()) + 1 if len(numbers) else 0
        first = np.zeros(kinds, np.int64)
        first[numbers[::-1]] = at[::-1]
        order = np.argsort(numbers, kind="stable")
        sums = np.add.reduceat(self.weight[at][order], np.searchsorted(numbers[order], np.arange(kinds))) if kinds else np.zeros(0, np.int64)
        return numbers, first, sums

    def written(self, k: int, first: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of _COUNTED."""
        begins, ends = self.starts[first], self.ends[first + k - 1]
        for lo in range(0, len(first), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            texts = [self.data[a:b].decode() for a, b in zip(begins[part], ends[part])]
            langs = pc.take(pa.array(self.langs, pa.string()), pa.array(self.lang[first[part]]))
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(texts), k, np.int32)), pa.array(texts, pa.string()), pa.array(sums[part])], ["lang", "k", "phrase", "n"])


def in_duckdb(table: pa.RecordBatchReader, name: str, ask: Callable, memory_mb: int = DUCKDB_MB) -> Iterator[pa.RecordBatch]:
    """The answers of ``ask(connection)`` about a task's rows, which duckdb holds or spills."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="lorewell-duckdb-")
    try:
        with duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": folder, "preserve_insertion_order": False}) as db:
            db.register(name, table)
            yield from ask(db)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def frequent_hashes(emitted: DataFrame, least: int) -> DataFrame:
    """Replies (REPLY_SCHEMA) with those of each block's hashes whose counts reach ``least`` in all."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("key", pa.uint32()), ("n", pa.uint32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked() -> Iterator[pa.RecordBatch]:
            for row in rows(batches):
                keys, n = np.frombuffer(row["keys"], np.uint32), np.frombuffer(unsqueeze(row["vals"]), np.uint32)
                for lo in range(0, len(keys), ROWS_AT_ONCE):
                    k, v = keys[lo : lo + ROWS_AT_ONCE], n[lo : lo + ROWS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row["bucket"])), pa.array(np.full(len(k), row["block"])), pa.array(k), pa.array(v)], schema=schema)

        def ask(db) -> Iterator[pa.RecordBatch]:
            db.execute("CREATE TEMP TABLE sent AS SELECT * FROM incoming")
            db.execute(f"CREATE TEMP TABLE frequent AS SELECT bucket, key FROM sent GROUP BY bucket, key HAVING sum(n) >= {int(least)}")
            found = db.sql("SELECT block, bucket, key FROM sent SEMI JOIN frequent USING (bucket, key) ORDER BY block, bucket, key").to_arrow_reader(ROWS_AT_ONCE)
            now, held = None, []

            def reply() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([squeeze(np.concatenate(held).tobytes())], pa.binary())], ["block", "bucket", "reply"])

            for batch in found:
                block, bucket, key = (np.asarray(batch.column(i)) for i in range(3))
                cuts = np.flatnonzero((block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1])) + 1
                for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(block))):
                    if lo == hi:
                        continue
                    if held and now != (block[lo], bucket[lo]):
                        yield reply()
                        held = []
                    now = (block[lo], bucket[lo])
                    held.append(key[lo:hi].astype(np.uint32))
            if held:
                yield reply()

        yield from in_duckdb(pa.RecordBatchReader.from_batches(schema, unpacked()), "incoming", ask)
        trim()

    return emitted.repartition("bucket").mapInArrow(run, REPLY_SCHEMA)


def by_bucket(written: list[pa.RecordBatch], bits: int) -> pa.RecordBatch | None:
    """(bucket, rows): the rows of a block by the hash of their phrase, sorted and compressed, as the shuffle sends them."""
    if not written:
        return None
    table = pa.Table.from_batches(written)
    phrase = table.column("phrase").combine_chunks()
    raw, at = text_views(phrase)
    bucket = (mixed_hash(raw, at[:-1], at[1:]) >> np.uint64(64 - bits)).astype(np.int64)
    order = pc.sort_indices(pa.table({"bucket": bucket, "phrase": phrase}), [("bucket", "ascending"), ("phrase", "ascending")])
    table, bucket = table.take(order), bucket[np.asarray(order)]
    found, first = np.unique(bucket, return_index=True)
    blobs = []
    for lo, hi in zip(first, np.append(first[1:], len(bucket))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.slice(lo, hi - lo).combine_chunks())
        blobs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def count_phrases(emitted: DataFrame, least: int) -> DataFrame:
    """The rows of _COUNTED in (bucket, rows), summed by language and text, bucket by bucket."""
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def incoming() -> Iterator[pa.RecordBatch]:
            for row in rows(batches):
                for batch in pa.ipc.open_stream(row["rows"]):
                    yield batch.cast(schema)

        def ask(db) -> Iterator[pa.RecordBatch]:
            found = db.sql(f"SELECT lang, k, phrase, CAST(sum(n) AS BIGINT) AS n FROM incoming GROUP BY lang, k, phrase HAVING sum(n) >= {int(least)}")
            yield from found.to_arrow_reader(1 << 16)

        yield from in_duckdb(pa.RecordBatchReader.from_batches(schema, incoming()), "incoming", ask)
        trim()

    return emitted.repartition("bucket").mapInArrow(run, _COUNTED)


def phrase_counts(blocks: DataFrame, store: Scratch, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of up to ``longest`` words that occur ``least`` times."""

    text_bytes = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = buckets_bits(text_bytes // 4, BUCKET_ENTRIES)  # words and pairs of words

    def hashed(row: dict) -> Iterator[tuple[Grams, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        grams = Grams(row)
        for k in (1, 2):
            at = grams.inside(k)
            numbers, first, sums = grams.counted(k, at)
            yield grams, k, at, numbers, first, sums

    def short(grams: Grams, k: int, first: np.ndarray) -> np.ndarray:
        return grams.hashes(k, first) >> np.uint64(32 - bits)  # bits of bucket, 32 of key

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            found = [(short(g, k, first), sums) for g, k, _, _, first, sums in hashed(row)]
            keys, sums = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            order = np.argsort(keys)
            keys, sums = keys[order], sums[order]
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sums = np.minimum(np.add.reduceat(sums, new), least).astype(np.uint32) if len(keys) else sums.astype(np.uint32)
            sent = emit_batch(row["block"], keys[new] if len(keys) else keys, sums, 0, 32)
            del found, keys, sums, order, new
            yield pa.RecordBatch.from_arrays([*sent.columns[:3], pa.array([squeeze(v.as_py()) for v in sent.column(3)], pa.binary())], sent.schema.names)
            trim()

    replies = store.write(frequent_hashes(blocks.mapInArrow(emit, "bucket long, block long, keys binary, vals binary"), least), "frequent")
    store.release()

    def write(row: dict, answered: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        known = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(unsqueeze(r), np.uint32).astype(np.uint64) for b, r in answered])) if answered else np.zeros(0, np.uint64)
        passes, out = None, []
        for grams, k, at, numbers, first, sums in hashed(row):
            keys = short(grams, k, first)
            place = np.searchsorted(known, keys)
            there = np.zeros(len(keys), bool) if not len(known) else known[np.minimum(place, len(known) - 1)] == keys
            out += grams.written(k, first[there], sums[there])
            if k == 2:
                passes = np.zeros(len(grams.starts), bool)  # the pair that begins here
                passes[at] = there[numbers]
        run = passes
        for k in range(3, longest + 1):
            run = run[:-1] & passes[k - 2 :] if len(run) > 1 else run[:0]
            _, first, sums = grams.counted(k, np.flatnonzero(run))
            out += grams.written(k, first, sums)
        sent = by_bucket(out, bits)
        del grams, at, numbers, first, sums, keys, place, there, out
        if sent is not None:
            yield sent
        trim()

    return store.write(count_phrases(with_replies(blocks, replies, write, "bucket long, rows binary", numbered=True), least), "counts")


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase inside a longer one that occurs ``share`` percent as often as itself is left out.  Counts are multiplied as decimals of 38
    digits."""
    store = Scratch(docs.sparkSession, "collocations")
    blocks = store.write(pack_pieces(distinct_pieces(docs, text_col, lang_col), block_bytes), "blocks", "none")
    store.release()  # the shuffle files of the pieces
    totals = store.few(blocks.select(F.explode(F.arrays_zip("langs", "words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.words").alias("n")))
    counts = phrase_counts(blocks, store, longest, least)

    words, cut = F.split("phrase", " "), F.col("cut")
    asked = counts.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    asked = asked.withColumn("first", F.array_join(F.slice(words, 1, cut), " ")).withColumn("rest", F.array_join(F.slice(words, cut + 1, F.col("k")), " "))
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("found"))
    answered = asked.join(part.withColumnsRenamed({"part": "first", "found": "l"}), ["lang", "first"]).join(part.withColumnsRenamed({"part": "rest", "found": "r"}), ["lang", "rest"]).join(totals, "lang")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    scored = answered.withColumns({"over": (whole["a"] * whole["n"]).cast("decimal(38,0)") * F.lit(1000), "under": (whole["l"] * whole["r"]).cast("decimal(38,0)")}).withColumn("score", F.expr("CAST(over AS DECIMAL(38,0)) div under"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))))
    within = counts.filter("k > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * share
    kept = lowest.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~held)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
