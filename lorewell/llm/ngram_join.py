"""Similarity self-join of documents by the Jaccard index of their word shingles.

Adaptive multi-match prefixes.  Shingles are ordered by their hash, the same order in every
document.  If two sets of sizes n >= m overlap by o, their first n - o + k and m - o + k shingles
share at least k.  A document therefore finds every partner that is no larger within its prefix of level k if it looks
for at least k common shingles there, or, what is the same, if it leaves out its k - 1 most frequent
shingles and looks for one.  Each document lengthens its prefix as long as this lowers its estimated candidate
cost, the summed frequencies of the shingles it looks up; frequencies are counted over all documents, of
truncated hashes (a false match, one in some thousands, only makes a shingle look more frequent).  As a partner of a larger
document it shows the somewhat longer prefix that the highest level asks for.

Documents with equal sets are one node.  Frequencies are summed from one entry a block and shingle; the answer also has the
greatest of two random marks among the documents that hold the shingle.  Shingles with the same marks (as likely as their
documents are the same) and about the same frequency form one group, divided by classes of set size if frequent, so that a document joins a few groups
and not one for each shingle.  Groups are not expanded into pairs.  All members are compared with the most central one: a comparison first
bounds the Jaccard distance by the two prefixes, then takes the whole sets.  Members near a centre form its cluster,
whatever shingles brought them there; the symmetric difference of two members is that of their differences from the
centre, which are small, so a cluster is settled exactly in blocks of these differences, of which only
links come out.  By the triangle inequality members near the centre cannot link with far ones, but for those in between;
these and the far ones are compared in blocks, too, by the known parts of their prefixes.  What passes there leaves as rows, not as pairs, marked
with the part of the block that hangs together by such pairs; the parts are settled by the whole sets, again in blocks of which only links come out.

Shingles are told apart by 64-bit hashes of their words, in verification too: with s shingles in two compared sets
a wrong match has a chance of about s**2 / 2**65.

Nulls and edges: null or blank text has the empty set and links with nothing; texts with fewer words than
a shingle have their whole sequence as the one shingle; documents with equal sets are linked; rows with
equal id are separate documents; a null id takes part, component_id is the smallest id that isn't null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.components import components, merged
from lorewell.llm.packed import EMIT_SCHEMA, buckets_bits, chain, emit_batch, exchange, mix, pack_blocks, rows, squeeze, trim, unsqueeze, with_replies, word_hashes
from lorewell.llm.scratch import Scratch

#: Frequency above which a shingle's group is divided by classes of set size.
HOT = 16
#: Members of a group, and bytes of their sets, that meet in one task on either side (about as many).
BLOCK, BLOCK_SET_BYTES = 2048, 12 << 20
#: Pairs whose comparisons leave a task together.
PAIRS = 256
#: Prefix cuts at which the pairs of a block are judged.
CUTS = 8
BUCKET_ENTRIES = 500_000


def shingle_sets(data: np.ndarray, lens: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words, at = word_hashes(data, lens)
    h = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        h = chain(h, words[k : k + len(h)])
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = chain(one, words[k : k + 1])
            out.append(one)
        else:
            out.append(words[:0])
    return out


def least_overlap(n, percent: int):
    """The least overlap of a set of n shingles with one that is no larger."""
    return -(-percent * n // 100)


def probe_length(n, percent: int):
    """The prefix of level 1 in which a set of n shingles looks for partners that are no larger."""
    return n - least_overlap(n, percent) + 1


def index_length(n, percent: int):
    """The prefix in which a set of n shingles is found at level 1 by those that are no smaller."""
    return n + 1 - -(-2 * percent * n // (100 + percent))


def most_level(n, percent: int):
    """The highest level of a set of n shingles, by the shortest index prefix of its partners."""
    return 2 * index_length(-(-percent * n // 100), percent)


def longest(n, percent: int):
    """The prefix that a set of n shingles needs to look and to be found at any level."""
    return np.minimum(n, np.maximum(probe_length(n, percent) + most_level(n, percent), index_length(n, percent) + most_level(100 * n // percent, percent)) - 1)


def distance(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of sorted distinct arrays."""
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same, len(both) - same


def choose_level(df: np.ndarray, first: int, most: int) -> tuple[int, np.ndarray]:
    """The prefix level, at most ``most``, with the least cost, and the places of the shingles to look up there.
    ``df``: frequencies of the longest prefix; ``first``: length of the shortest."""
    best, where, level = None, None, 1
    while level == 1 or level <= most and first + level - 1 <= len(df):
        own = df[: first + level - 1]
        order = np.argsort(own, kind="stable")[:first]
        cost = float((own[order] - 1).sum()) + level
        if best is None or cost < best[0]:
            best, where = (cost, level), order
        level *= 2
    return best[1], where


def stored(hashes: np.ndarray, width: int) -> bytes:
    """The leading ``width`` bytes of each hash."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def restored(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(">u8").ravel().astype(np.uint64)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links of a
    Jaccard index of at least ``percent`` / 100), kept (one row of each component)."""
    store = Scratch(docs.sparkSession, "ngrams")
    far = 1 - percent / 100
    blocks = store.write(pack_blocks(docs, id_col, text_col), "blocks", "none")
    total = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    # a key is a bucket and 32 bits; about as many shingles stand in prefixes as there are bytes, by 16
    bits = buckets_bits(total // 16, BUCKET_ENTRIES)
    wide = min(8, -(-(bits + 32) // 8))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            sets = shingle_sets(np.frombuffer(unsqueeze(row["data"]), np.uint8), np.asarray(row["lens"], np.int64), width)
            n = np.array([len(s) for s in sets], np.int64)
            sig = np.array([[mix(s).sum(), mix(s + np.uint64(99)).sum()] for s in sets], np.uint64)
            prefix = np.concatenate([s[:k] for s, k in zip(sets, longest(n, percent))])
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["ids"]], pa.list_(pa.int64())), *(pa.array([v], pa.binary()) for v in (n.tobytes(), sig.tobytes(), stored(prefix, wide)))], ["block", "ids", "n", "sig", "prefix"])
        trim()

    packed = store.write(blocks.mapInArrow(prepare, "block long, ids array<long>, n binary, sig binary, prefix binary"), "prefixes", "none")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            n, sig = np.frombuffer(row["n"], np.int64), np.frombuffer(row["sig"], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array((row["block"] << 20) + np.arange(len(n))), pa.array(row["ids"], pa.int64()), pa.array(n), pa.array(sig[:, 0]), pa.array(sig[:, 1])], ["rid", "doc_id", "n", "s1", "s2"])

    documents = store.write(packed.select("block", "ids", "n", "sig").mapInArrow(unpacked, "rid long, doc_id long, n long, s1 long, s2 long"), "documents")
    # one node for equal sets: the first row; named is the row with the smallest id
    named = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid"))
    reps = store.write(documents.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), named.alias("named")), "reps")

    def by_block(rids: DataFrame) -> DataFrame:
        """Replies that name documents, as text, to each block, with what ``copies`` says."""
        copies = F.col("copies") if "copies" in rids.columns else F.lit(1)
        at = F.concat_ws(":", F.col("rid").bitwiseAND((1 << 20) - 1), copies)
        listed = rids.groupBy(F.shiftright("rid", 20).alias("block")).agg(F.collect_list(at).alias("at"))  # at most a block's documents
        return listed.select("block", F.lit(-1).cast("long").alias("bucket"), F.array_join("at", ",").cast("binary").alias("reply"))

    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Set sizes, prefixes one after another, and their keys."""
        n, prefix = np.frombuffer(row["n"], np.int64), restored(row["prefix"], wide)
        return n, prefix, mix(prefix) >> np.uint64(32 - bits)

    def marks(row: dict) -> np.ndarray:
        """Two random marks of each document."""
        return (np.frombuffer(row["sig"], np.uint64).reshape(-1, 2) >> np.uint64(32)).astype(np.uint32)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            n, _, keys = keys_of(row)
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            most = np.maximum.reduceat(np.repeat(marks(row), longest(n, percent), axis=0)[order], first)
            times = np.diff(np.append(first, len(keys))).astype(np.uint32)
            yield emit_batch(row["block"], keys[first], np.column_stack([times, most]), bits, 32)
        trim()

    def frequency(keys: list[np.ndarray], vals: list[bytes]) -> list[bytes]:
        every, both = np.concatenate(keys), np.concatenate([np.frombuffer(v, np.uint32).reshape(-1, 3) for v in vals])
        order = np.argsort(every, kind="stable")
        new = np.concatenate(([True], every[order][1:] != every[order][:-1]))
        first, back = np.flatnonzero(new), np.empty(len(every), np.int64)
        back[order] = np.cumsum(new) - 1
        df = np.add.reduceat(both[order, 0].astype(np.int64), first)[back]
        most = np.maximum.reduceat(both[order, 1:], first)[back]
        ends = np.cumsum([len(k) for k in keys])
        out = []
        for k, e in zip(keys, ends):
            own = slice(e - len(k), e)
            out.append(squeeze(df[own].tobytes() + most[own][df[own] > 1].tobytes()))
        return out

    def choose(row: dict, replies: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if not replies or replies[0][0] >= 0:  # no node here
            return
        nodes = [tuple(map(int, x.split(b":"))) for x in replies[0][1].split(b",")]
        n, prefix, keys = keys_of(row)
        distinct, inverse = np.unique(keys, return_inverse=True)
        sizes = np.unique(distinct >> np.uint64(32), return_counts=True)[1]
        df, most = np.empty(len(distinct), np.int64), np.zeros((len(distinct), 2), np.uint64)
        at = 0
        for (_, reply), k in zip(replies[1:], sizes):
            raw = unsqueeze(reply)
            own = df[at : at + k] = np.frombuffer(raw, np.int64, k)
            most[at : at + k][own > 1] = np.frombuffer(raw, np.uint32, offset=8 * k).reshape(-1, 2)
            at += k
        df, most = df[inverse], most[inverse]
        length = longest(n, percent)
        ends, out = np.cumsum(length), []
        for place, copies in nodes:
            size = int(n[place])
            own = slice(ends[place] - length[place], ends[place])
            every = df[own]
            f = every - copies + 1  # its own copies are no candidates
            shared = np.flatnonzero(f > 1)
            if not len(shared):
                continue
            level, where = choose_level(f, probe_length(size, percent), most_level(size, percent))
            probe = np.zeros(len(f), bool)
            probe[where] = True
            probe, every = probe[shared], every[shared]
            first, second = most[own][shared].T
            group = mix(mix(first << np.uint64(32) | second) + (32 * np.log2(every)).astype(np.uint64))
            hot, cls = every > HOT, int(np.log(size) / np.log(1.0001 * 100 / percent))
            classes = lambda k, c: mix(k ^ np.uint64((c + 2) * 0x9E3779B97F4A7C15 % 2**64))
            # as a partner of larger sets it also stands in the class above
            group, probe = np.concatenate([np.where(hot, classes(group, cls), group), classes(group[hot], cls + 1)]), np.concatenate([probe, np.zeros(hot.sum(), bool)])
            group, which = np.unique(group, return_inverse=True)
            looked = np.bincount(which, probe) > 0
            score = int(np.minimum(f, 1000).sum() * 1000 // len(f))
            out.append(((row["block"] << 20) + place, size, score, group.view(np.int64), looked, (prefix[own] >> np.uint64(32)).astype(np.uint32).tobytes()))
        for lo in range(0, len(out), 500):
            cols = list(zip(*out[lo : lo + 500]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["rid", "n", "score", "groups", "probes", "top"])

    found = store.write(exchange(packed.select("block", "n", "sig", "prefix").mapInArrow(tokens, EMIT_SCHEMA), frequency, np.uint32), "frequencies", "none")
    store.release()
    active = store.write(with_replies(packed.select("block", "n", "prefix"), found.unionByName(by_block(reps)), choose, "rid long, n long, score long, groups array<long>, probes array<boolean>, top binary", numbered=True), "active")
    store.drop(packed, found)
    members = active.select("rid", "n", "score", F.explode(F.arrays_zip("groups", "probes")).alias("x")).select(F.col("x.groups").alias("g"), "rid", "n", "score", F.col("x.probes").cast("int").alias("probe"))

    # every member of a group that someone looks up against the group's centre
    near = min(0.5, 3.5 * far)  # the radius of a cluster
    centre = store.write(members.groupBy("g").agg(F.max(F.struct("score", "rid", "n")).alias("c"), F.count("*").alias("size"), F.max("probe").alias("looked")).filter("size > 1 and looked = 1").select("g", F.col("c.rid").alias("c"), F.col("c.n").alias("cn")), "centres")
    # tables that a join would gather by a hot key are written, so that adaptive execution can split either side
    placed = store.write(members.join(centre, "g").filter("rid <> c").select("g", "rid", "n", "probe", "c", "cn"), "placed")
    alike = F.least("n", "cn") >= F.greatest("n", "cn") * (1 - near)
    asked = placed.filter(alike).select(F.least("rid", "c").alias("a"), F.greatest("rid", "c").alias("b")).distinct()
    known = _compare(asked, active, blocks, by_block, store, width, percent, near)
    roots = components(known.filter("linked").select("a", "b"), store)
    # clusters of members near a centre
    spots = placed.select("rid", "n", "c", "cn").distinct().join(known.select("a", "b", "d", "diff"), (F.least("rid", "c") == F.col("a")) & (F.greatest("rid", "c") == F.col("b")), "left")
    spots = store.write(spots.select("rid", "n", "c", F.coalesce("d", 1 - F.least("n", "cn") / F.greatest("n", "cn")).alias("d"), "diff"), "spots", "none")
    roots = merged(roots, _within(spots.filter("diff is not null"), roots, store, percent), store)
    # the rest: far members, and near ones that may reach them
    keyed = placed.drop("n").join(spots.select("rid", "c", "n", "d", F.col("diff").isNull().alias("away")), ["rid", "c"])
    rooted = store.write(keyed.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")).drop("cn"), "rooted")
    reach = store.few(rooted.filter("away").groupBy("c").agg(F.min("d").alias("least")))
    reached = rooted.join(reach, "c").filter(F.col("away") | (F.col("d") > F.col("least") - far - 1e-9)).drop("least")
    going = store.few(reached.groupBy("g").agg(F.max(F.col("away").cast("int")).alias("away"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("probe").alias("looked")).filter("r0 < r1 and looked = 1 and away = 1").select("g"))
    # groups with the same centre go on as one
    rest = store.write(reached.join(going, "g", "left_semi").select("c", "rid", "n", "root", "away", "d").distinct(), "rest")
    store.drop(centre, placed, spots, rooted, reach, going)
    candidates = _candidates(rest, active, store, percent)
    fetched = _texts(candidates.select("rid").distinct(), blocks, by_block, store)
    roots = merged(roots, _settled(candidates, fetched, store, width, percent), store)
    store.drop(blocks, rest, known, active, candidates, fetched)
    classes = store.write(reps.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "classes")
    least = store.few(classes.groupBy("root").agg(F.min("named").alias("k")))
    marked = store.write(classes.join(least, "root").select("s1", "s2", "n", F.col("k.doc_id").alias("component_id"), F.col("k.rid").alias("keeper")), "marked")
    store.drop(reps, roots, classes, least)
    joined = documents.join(marked, ["s1", "s2", "n"], "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), ((F.col("n") == 0) | F.col("keeper").eqNullSafe(F.col("rid"))).alias("kept")
    )


def _texts(wanted: DataFrame, blocks: DataFrame, by_block, store: Scratch) -> DataFrame:
    """(rid, z): the squeezed texts of the rows ``wanted``."""

    def texts(row: dict, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not replies:
            return
        data, ends = unsqueeze(row["data"]), np.cumsum(row["lens"])
        at = sorted(int(x.partition(b":")[0]) for x in replies[0].split(b","))
        yield pa.RecordBatch.from_arrays([pa.array([(row["block"] << 20) + i for i in at], pa.int64()), pa.array([squeeze(data[ends[i] - row["lens"][i] : ends[i]]) for i in at], pa.binary())], ["rid", "z"])

    return store.write(with_replies(blocks, by_block(wanted), texts, "rid long, z binary"), "texts", "none")


def _compare(pairs: DataFrame, active: DataFrame, blocks: DataFrame, by_block, store: Scratch, width: int, percent: int, near: float) -> DataFrame:
    """(a, b, d, linked, diff): the distance and, if that is at most ``near``, the symmetric difference; for
    pairs that by their prefixes neither can link nor seem near, a lower bound of the distance."""
    side = lambda k: active.select(F.col("rid").alias(k), F.col("n").alias(f"n_{k}"), F.col("top").alias(f"top_{k}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, guess = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, r in enumerate(rows([batch])):
                x, y = np.frombuffer(r["top_a"], np.uint32), np.frombuffer(r["top_b"], np.uint32)
                # below the smaller of the last hashes both sets are known
                cut = min(x[-1] if len(x) < r["n_a"] else 2**32, y[-1] if len(y) < r["n_b"] else 2**32)
                x, y = x[x < cut], y[y < cut]
                same = distance(x, y)[0]  # equal halves of different hashes only lower the bound
                differ, both = len(x) + len(y) - 2 * same, r["n_a"] + r["n_b"]
                low[i] = 1 - (both - differ) / (both + differ) if differ < both else 1.0
                guess[i] = differ / (same + differ) if differ else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low), pa.array(guess)], ["a", "b", "low", "guess"])

    bounded = store.write(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "top_a", "top_b").mapInArrow(bound, "a long, b long, low double, guess double"), "bounded")
    store.release()
    far = 1 - percent / 100 + 1e-9
    asked = (F.col("low") <= far) | (F.col("guess") <= near)
    close = bounded.filter(asked)

    fetched = _texts(close.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), blocks, by_block, store)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(rid: int, z: bytes) -> np.ndarray:
            if rid not in sets:
                if len(sets) > 200:
                    sets.clear()
                data = np.frombuffer(unsqueeze(z), np.uint8)
                sets[rid] = shingle_sets(data, np.array([len(data)]), width)[0]
            return sets[rid]

        for batch in batches:
            for lo in range(0, batch.num_rows, PAIRS):
                part = batch.slice(lo, PAIRS)
                d, linked, diff = np.zeros(part.num_rows), np.zeros(part.num_rows, bool), []
                for i, r in enumerate(rows([part])):
                    x, y = of(r["a"], r["z_a"]), of(r["b"], r["z_b"])
                    same, union = distance(x, y)
                    d[i], linked[i] = 1 - same / union, 100 * same >= percent * union
                    diff.append(np.setxor1d(x, y, assume_unique=True).tobytes() if d[i] <= near else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d), pa.array(linked), pa.array(diff, pa.binary())], ["a", "b", "d", "linked", "diff"])
        sets.clear()
        trim()

    held = lambda k: fetched.select(F.col("rid").alias(k), F.col("z").alias(f"z_{k}"))
    verified = store.write(close.select("a", "b").join(held("a"), "a").join(held("b"), "b").select("a", "b", "z_a", "z_b").mapInArrow(exact, "a long, b long, d double, linked boolean, diff binary"), "verified", "none")
    out = store.write(verified.union(bounded.filter(~asked).select("a", "b", F.col("low").alias("d"), F.lit(False).alias("linked"), F.lit(None).cast("binary").alias("diff"))), "known", "none")
    store.drop(bounded, fetched, verified)
    return out


def _blocks(rows_: DataFrame, key: str, sizes: DataFrame, columns: list[str], store: Scratch) -> DataFrame:
    """Rows of each key dealt into pairs (i <= j) of blocks, sorted by them; ``sizes``: key, m and size in bytes."""
    own = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    parts = store.few(sizes.select(key, F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SET_BYTES)).cast("int").alias("parts")))
    dealt = rows_.join(parts, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(F.col(key).alias("key"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _by_block(fn, names: tuple[str, ...] = ("a", "b")):
    """``fn(rows of a pair of blocks, places of the left, places of the right)`` gives rows of ``names``, pairs of ids if not said otherwise."""

    def batch(held: list[dict]) -> pa.RecordBatch:
        side = np.array([r["own"] for r in held])
        left, right = (np.flatnonzero(side == held[0][k]) for k in ("i", "j"))
        found = fn(held, left, right) if len(left) and len(right) else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for row in rows(batches):
            key = (row["key"], row["i"], row["j"])
            if held and key != now:
                yield batch(held)
                held = []
            now = key
            held.append(row)
        if held:
            yield batch(held)
        trim()

    return run


#: Shingles that are counted together, and rows of a block that are judged together.
COLUMNS, ROWS = 1024, 256


def _differences(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the symmetric differences of sets (each of distinct values)."""
    size = np.array([len(d) for d in sets])
    tokens, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    often = np.flatnonzero(times > 1)  # others are common to no two
    place = np.full(len(tokens), -1)
    place[often] = np.arange(len(often))
    column = place[at]
    common = np.zeros((len(left), len(right)), np.float32)
    by_column = np.argsort(column, kind="stable")
    ordered = column[by_column]
    for lo in range(0, len(often), COLUMNS):
        own = by_column[slice(*np.searchsorted(ordered, (lo, lo + COLUMNS)))]
        dense = np.zeros((len(sets), min(COLUMNS, len(often) - lo)), np.float32)
        dense[owner[own], column[own] - lo] = 1
        common += dense[left] @ dense[right].T
    np.rint(common, out=common)
    return size[left].astype(np.int32)[:, None] + size[right].astype(np.int32)[None] - 2 * common.astype(np.int32)


def _within(spots: DataFrame, roots: DataFrame, store: Scratch, percent: int) -> DataFrame:
    """Links (a, b), enough to connect what is linked, among the members (rid, n, diff) of each cluster c."""
    rooted = spots.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    sizes = rooted.groupBy("c").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum(F.length("diff")).alias("size")).filter("r0 < r1")

    def settle(held: list[dict], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        n = np.array([r["n"] for r in held])
        root = np.unique([r["root"] for r in held], return_inverse=True)[1]
        apart = _differences([np.frombuffer(r["diff"], np.uint64) for r in held], left, right)
        found = []
        for lo in range(0, len(left), ROWS):
            own = left[lo : lo + ROWS]
            both, part = n[own][:, None] + n[right][None], apart[lo : lo + ROWS].astype(np.int64)
            # overlap (both - part) / 2 of union (both + part) / 2
            x, y = np.nonzero((100 * (both - part) >= percent * (both + part)) & (root[own][:, None] != root[right][None]))
            found.append((x + lo, y))
        a, b = (np.concatenate(z) for z in zip(*found))
        up = np.arange(root.max() + 1)

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        out = []
        for x, y in zip(left[a], right[b]):
            p, q = top(root[x]), top(root[y])
            if p != q:
                up[p] = q
                out.append((held[x]["rid"], held[y]["rid"]))
        return out

    return store.write(_blocks(rooted, "c", sizes, ["rid", "n", "root", "diff"], store).mapInArrow(_by_block(settle), "a long, b long"), "within")


def parts_of(near: np.ndarray) -> np.ndarray:
    """The connected parts of a symmetric matrix, each by its first row; -1 where a row has no other."""
    label = np.full(len(near), -1)
    for k in np.flatnonzero(near.any(1)):
        front = np.array([k]) if label[k] < 0 else np.zeros(0, np.int64)
        while len(front):
            label[front] = k
            front = np.flatnonzero(near[front].any(0) & (label < 0))
    return label


def _candidates(rest: DataFrame, active: DataFrame, store: Scratch, percent: int) -> DataFrame:
    """(part, rid, n, root): the rows of the groups around a centre c with others which they are not known to be too far from by their prefixes, one of
    the two away from the centre.  A part hangs together by such pairs, within one pair of blocks; an equal part is listed once."""
    # a row with no other of about its set size in the group has no partner there; sizes are few, however many rows have them
    w = Window.partitionBy("c").orderBy("n")
    per = rest.groupBy("c", "n").agg(F.count("*").alias("k")).withColumns({"less": F.lag("n").over(w), "more": F.lead("n").over(w)})
    paired = (F.col("k") > 1) | F.coalesce(100 * F.col("less") >= percent * F.col("n"), F.lit(False)) | F.coalesce(100 * F.col("n") >= percent * F.col("more"), F.lit(False))
    rest = store.write(rest.join(store.few(per.filter(paired).select("c", "n")), ["c", "n"], "left_semi"), "paired")
    # the rows of a large group meet by classes of set size: in their own, and in the one above as partners of larger sets
    load = F.sum(F.col("n") * 1.6)  # about four bytes for each shingle of a prefix
    large = store.few(rest.groupBy("c").agg(F.count("*").alias("m"), load.alias("size")).filter((F.col("m") > BLOCK) | (F.col("size") > BLOCK_SET_BYTES)).select("c", F.lit(True).alias("large")))
    cls = F.floor(F.log("n") / np.log(1.0001 * 100 / percent)).cast("int")
    met = rest.join(large, "c", "left").withColumn("cls", F.explode(F.when(F.col("large"), F.array(cls, cls + 1)).otherwise(F.array(F.lit(-1)))))
    met = met.withColumn("g", F.xxhash64("c", "cls")).drop("c", "cls", "large")
    sizes = met.groupBy("g").agg(F.count("*").alias("m"), load.alias("size")).filter("m > 1")
    tops = met.join(active.select("rid", "top"), "rid")

    def bound(held: list[dict], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        n = np.array([r["n"] for r in held])
        root = np.unique([r["root"] for r in held], return_inverse=True)[1]
        away = np.array([r["away"] for r in held])
        tops = [np.frombuffer(r["top"], np.uint32) for r in held]
        # below its last hash a set is known, so a pair is judged below a cut that neither last hash is under;
        # equal halves of different hashes only lower the bound
        ends = np.array([int(t[-1]) if len(t) < k else 1 << 32 for t, k in zip(tops, n)])
        apart = np.zeros((len(left), len(right)), np.int32)
        for cut in np.unique(np.quantile(ends, np.linspace(0, 1, CUTS), method="lower")):
            l, r = np.flatnonzero(ends[left] >= cut), np.flatnonzero(ends[right] >= cut)
            own = np.flatnonzero(ends >= cut)
            back = np.cumsum(ends >= cut) - 1
            if len(l) and len(r):
                apart[np.ix_(l, r)] = _differences([np.unique(tops[k][tops[k] < cut]) for k in own], back[left[l]], back[right[r]])
        # by the triangle inequality: d bounds the distance from the centre, and is that of members near it
        low = np.array([r["d"] for r in held])
        up, near = np.where(away, 1.0, low), np.zeros((len(held), len(held)), bool)
        for lo in range(0, len(left), ROWS):
            own = left[lo : lo + ROWS]
            a, b, part = n[own][:, None], n[right][None], apart[lo : lo + ROWS].astype(np.int64)
            beyond = np.maximum(low[own][:, None] - up[right][None], low[right][None] - up[own][:, None]) > 1 - percent / 100 + 1e-9
            ok = ~beyond & (100 * (a + b - part) >= percent * (a + b + part)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (root[own][:, None] != root[right][None]) & (away[own][:, None] | away[right][None])
            near[np.ix_(own, right)] |= ok
        near |= near.T
        rid, label, found = np.array([r["rid"] for r in held]), parts_of(near), []
        for k in np.unique(label[label >= 0]):
            own = np.flatnonzero(label == k)
            name = int(mix(mix(rid[own].astype(np.uint64)).sum(keepdims=True)).view(np.int64)[0])  # the same for the same rows
            found += [(name, held[x]["rid"], held[x]["n"], held[x]["root"]) for x in own]
        return found

    listed = _blocks(tops, "g", sizes, ["rid", "n", "root", "away", "d", "top"], store).mapInArrow(_by_block(bound, ("part", "rid", "n", "root")), "part long, rid long, n long, root long")
    found = store.write(listed.distinct(), "candidates")
    store.release()
    return found


def _settled(parts: DataFrame, fetched: DataFrame, store: Scratch, width: int, percent: int) -> DataFrame:
    """Links (a, b), enough to connect what is linked, among the rows (rid, n, root) of each part, by their whole sets; ``fetched``: their texts (rid, z)."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("m"), F.sum(F.col("n") * 8).alias("size"))

    def settle(held: list[dict], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        n = np.array([r["n"] for r in held])
        root = np.unique([r["root"] for r in held], return_inverse=True)[1]
        texts = [unsqueeze(r["z"]) for r in held]
        sets = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts]), width)
        token = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(n)
        # partners are a run of the right ones by size, and so are their shingles
        right = right[np.argsort(n[right], kind="stable")]
        every = np.concatenate([token[ends[y] - n[y] : ends[y]] for y in right])
        starts, own = np.concatenate(([0], np.cumsum(n[right]))), np.zeros(token.max() + 1, bool)
        out = []
        for x in left:
            lo, hi = np.searchsorted(100 * n[right], percent * n[x]), np.searchsorted(percent * n[right], 100 * n[x], "right")
            if lo == hi or (root[right[lo:hi]] == root[x]).all():
                continue
            mine = token[ends[x] - n[x] : ends[x]]
            own[mine] = True
            same = np.add.reduceat(own[every[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            own[mine] = False
            for y in right[lo:hi][100 * same >= percent * (n[x] + n[right[lo:hi]] - same)]:
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    out.append((held[x]["rid"], held[y]["rid"]))
        return out

    return store.write(_blocks(parts.join(fetched, "rid"), "part", sizes, ["rid", "n", "root", "z"], store).mapInArrow(_by_block(settle), "a long, b long"), "settled")
