"""Exact vector retrieval: tier-weighted search, grouped search, and the k nearest neighbours of every row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import canonical, tier_weight
from lorewell.functions.vectors import cosine
from lorewell.sources import files as S

#: Rows and bytes of a block of vectors; bytes of the blocks of one side that a task of the neighbour join goes through.
BLOCK_ROWS, BLOCK_BYTES, SIDE_BYTES = 4096, 8 << 20, 64 << 20


def search(chunks: DataFrame, query: list[float], k: int = 5, vector: str = "vector", key: str = "id") -> DataFrame:
    """The k best chunks by cosine times tier weight, out of the max(3k, k + 5) best by cosine alone.

    A blank query (empty vector) finds nothing.  Ties go to the smaller key."""
    if not query:
        return chunks.limit(0).withColumn("score", F.lit(0.0)).withColumn("weighted", F.lit(0.0))
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    near = chunks.withColumn("score", score).orderBy(F.desc("score"), key).limit(max(3 * k, k + 5))
    return near.withColumn("weighted", F.col("score") * tier_weight(F.col("tier"))).orderBy(F.desc("weighted"), F.desc("score"), key).limit(k)


def search_grouped(chunks: DataFrame, query: list[float], k: int = 10, vector: str = "vector", key: str = "id") -> DataFrame:
    """Files by their best weighted hit, each with its hits in order."""
    hits = search(chunks, query, max(3 * k, k + 5), vector, key)
    packed = F.struct((-F.col("weighted")).alias("o"), F.col(key).alias(key), "heading", "score", "weighted")
    grouped = hits.groupBy("source", "filename").agg(F.max("weighted").alias("best"), F.count("*").alias("n_hits"), F.sort_array(F.collect_list(packed)).alias("h"))  # at most the fetched rows
    return grouped.select("source", "filename", "best", "n_hits", F.transform("h", lambda x: F.struct(x[key].alias(key), x.heading.alias("heading"), x.score.alias("score"), x.weighted.alias("weighted"))).alias("hits")).orderBy(F.desc("best"), "source", "filename").limit(k)


def best_per(rows: DataFrame, by: list[str], order: list[Column], n: int | None = None) -> DataFrame:
    """The first row of each group, then the first n of these."""
    w = Window.partitionBy(*by).orderBy(*order)
    best = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return best if n is None else best.orderBy(*order).limit(n)


def unit_rows(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, unit (doubles as bytes) of the rows whose vector can be used: not null or zero, no null or non-finite component."""
    kind = "string" if dict(rows.dtypes)[key] == "string" else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims, units = [], [], []
            for i, v in enumerate(batch.column(1).to_pylist()):
                if v and not any(e is None for e in v):
                    x = np.asarray(v, float)
                    length = np.sqrt((x * x).sum())
                    if np.isfinite(length) and length > 0:
                        at.append(i)
                        dims.append(len(v))
                        units.append((x / length).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["key", "dim", "unit"])

    return rows.select(F.col(key).cast(kind).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"key {kind}, dim int, unit binary")


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), float).reshape(len(blobs), dim)


class Best:
    """The k rows seen that are most similar to each asked row: ties (of nine digits) to the smaller key, none to itself.  Products in single precision tell
    which pairs may be among them, by more than these can be off; the cosines are of double precision."""

    def __init__(self, asked: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None):
        self.asked, self.x, self.k = asked, x, k
        self.short, self.slack = x.astype(np.float32), 1e-9 + 1.2e-7 * (x.shape[1] + 8)
        self.least = np.full(len(asked), -np.inf) if least is None else least  # the k-th cosine so far, or what is known not to be above it
        self.row, self.key, self.cos = np.empty(0, np.int64), asked[:0], np.empty(0)

    def see(self, keys: np.ndarray, y: np.ndarray, which: np.ndarray | None = None) -> None:
        """Rows in order of their keys, for all asked rows or those of the places ``which``."""
        which = np.arange(len(self.asked)) if which is None else which
        rows, cols, found, short = [], [], [], y.astype(np.float32)
        for lo in range(0, len(which), 256):
            some = which[lo : lo + 256]
            near = self.short[some] @ short.T
            first, last = (np.searchsorted(keys, self.asked[some], side) for side in ("left", "right"))
            for i in np.flatnonzero(last > first):
                near[i, first[i] : last[i]] = -np.inf
            bound = self.least[some] - self.slack
            if len(keys) > self.k and np.isneginf(bound).any():
                bound = np.maximum(bound, np.partition(near, len(keys) - self.k, axis=1)[:, len(keys) - self.k] - 2 * self.slack)
            at = np.flatnonzero(near >= np.nextafter(bound.astype(np.float32), np.float32(-np.inf))[:, None])
            r, c = np.divmod(at[np.isfinite(near.ravel()[at])], len(keys))
            crowd = np.flatnonzero(np.bincount(r, minlength=len(some)) > 16 * self.k)  # many ties, of which the first are enough
            if len(crowd):
                apart = ~np.isin(r, crowd)
                r, c = r[apart], c[apart]
                for i in crowd:
                    value = y @ self.x[some[i]]
                    value[first[i] : last[i]] = -np.inf
                    top = np.argsort(-np.round(value, 9), kind="stable")[: self.k]
                    r, c = np.append(r, np.full(len(top), i)), np.append(c, top)
                apart = np.isfinite(near[r, c])
                r, c = r[apart], c[apart]
            rows.append(some[r])
            cols.append(c)
            found.append(np.einsum("ij,ij->i", self.x[some[r]], y[c]))
        if sum(map(len, rows)):
            self._take(np.concatenate(rows), keys[np.concatenate(cols)], np.concatenate(found))

    def _take(self, row: np.ndarray, key: np.ndarray, cos: np.ndarray) -> None:
        row, key, cos = np.concatenate([self.row, row]), np.concatenate([self.key, key]), np.concatenate([self.cos, cos])
        order = np.lexsort((key, -np.round(cos, 9), row))
        row, key, cos = row[order], key[order], cos[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = place == self.k - 1
        self.least[row[kth]] = np.maximum(self.least[row[kth]], np.round(cos[kth], 9))
        self.row, self.key, self.cos = (v[place < self.k] for v in (row, key, cos))

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        """src, dst, cos."""
        return pa.RecordBatch.from_arrays([pa.array(self.asked[self.row], kind), pa.array(self.key, kind), pa.array(self.cos)], ["src", "dst", "cos"])


def best_pairs(asked: np.ndarray, x: np.ndarray, keys: np.ndarray, y: np.ndarray, k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """src, dst, cos: the k rows of y most similar to each of x."""
    order = np.argsort(keys, kind="stable")
    best = Best(asked, x, k)
    best.see(keys[order], y[order])
    yield best.rows(kind)


def _meet(k: int, kind: str):
    """Rows (dim, i, j, side, key, unit), sorted by the first three: the k best of side 1 for every row of side 0 of the same three."""
    arrow = pa.string() if kind == "string" else pa.int64()

    def flush(dim: int, a: list, b: list) -> Iterator[pa.RecordBatch]:
        if a and b:
            yield from best_pairs(array_of([x[0] for x in a], arrow), matrix([x[1] for x in a], dim), array_of([x[0] for x in b], arrow), matrix([x[1] for x in b], dim), k, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            for dim, i, j, side, key_, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if (dim, i, j) != now:
                    yield from flush(now[0] if now else 0, *held)
                    now, held = (dim, i, j), ([], [])
                held[side].append((key_, unit))
        yield from flush(now[0] if now else 0, *held)

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """src, dst, cos, rank: the k best of each src."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("cos", 9)), "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def blocks(units: DataFrame, path: str) -> DataFrame:
    """block, dim, n, keys, units: rows (key, dim, unit) in blocks of one vector length, each in order of its keys; written to ``path``."""
    spark = units.sparkSession
    kind = dict(units.dtypes)["key"]
    arrow = pa.string() if kind == "string" else pa.int64()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, now, keys, held = TaskContext.get().partitionId(), 0, None, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task}/{count}"]), pa.array([now], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([keys], pa.list_(arrow)), pa.array([b"".join(held)], pa.binary())], ["block", "dim", "n", "keys", "units"])

        for batch in batches:
            for key, dim, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if keys and (dim != now or len(keys) >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * dim)))):
                    yield flush()
                    count, keys, held = count + 1, [], []
                now = dim
                keys.append(key)
                held.append(unit)
        if keys:
            yield flush()

    dealt = units.repartition(2 * spark.sparkContext.defaultParallelism, "key").sortWithinPartitions("dim", "key")
    return S.stored(dealt.mapInArrow(pack, f"block string, dim int, n long, keys array<{kind}>, units binary"), path)


def every_pair(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Every block asked (columns of ``blocks``, and maybe others) with every row of ``held`` (n, dim, ...) of its vector length, those of a block one after another.  Written
    tables are read where they meet, and nothing is shuffled; a task goes through some SIDE_BYTES of ``held`` for each of its blocks."""
    asked.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
    size = held.agg(F.sum(F.col("n") * F.col("dim") * 8)).first()[0] or 0
    other = held.coalesce(1 + size // SIDE_BYTES)
    left = asked.drop("n").withColumnsRenamed({"keys": "asked", "units": "asked_units"})
    return left.alias("a").join(other.alias("b").hint("shuffle_replicate_nl"), F.col("a.dim") == F.col("b.dim")).select("a.*", *[f"b.{c}" for c in held.columns if c not in ("block", "dim", "n")])


def array_of(keys: list, kind: pa.DataType) -> np.ndarray:
    return np.array(keys, str if kind == pa.string() else np.int64)


def nearest(rows: DataFrame, k: int = 12, key: str = "id", vector: str = "vector", asked: DataFrame | None = None) -> DataFrame:
    """(src, dst, cos, rank): the k most similar other rows of every row, or of every row of ``asked``, ties to the smaller key.

    Vectors meet those of their own length; null, zero and otherwise unusable ones have no neighbours and are nobody's.  Exact, hence quadratic in
    arithmetic (asked times all): rows are written in blocks, and a task takes some blocks through a part of all others (``every_pair``), a matrix product
    each, and passes on k rows for each row and part; memory is bounded by blocks and part, and a vector is shuffled once.  The result is
    written, so that it is computed once however often it is read.  See ``neighbour_index`` for an index that skips what cannot hold neighbours."""
    spark, work = rows.sparkSession, S.work_folder(rows.sparkSession, "nearest")
    own = blocks(unit_rows(rows, key, vector), f"{work}/own")
    ask = own if asked is None else blocks(unit_rows(asked, key, vector), f"{work}/asked")
    kind = dict(own.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    arrow = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, dim = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if block != now:
                    if best is not None:
                        yield best.rows(arrow)
                    at = array_of(batch.column(2)[i].as_py(), arrow)
                    now, best = block, Best(at, np.frombuffer(batch.column(3)[i].as_py(), float).reshape(len(at), dim), k)
                keys = array_of(batch.column(4)[i].as_py(), arrow)
                best.see(keys, np.frombuffer(batch.column(5)[i].as_py(), float).reshape(len(keys), dim))
        if best is not None:
            yield best.rows(arrow)

    found = every_pair(ask, own).mapInArrow(run, f"src {kind}, dst {kind}, cos double")
    out = S.stored(ranked(found, k), f"{work}/found")
    for name in ("own", "asked"):
        S.remove(spark, f"{work}/{name}")
    return out


def draw_centres(sample: np.ndarray, n: int, seed: int, rounds: int = 4) -> np.ndarray:
    """``n`` centres of a bounded sample, moved to the mean of what they attract."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        of = np.concatenate([(sample[lo : lo + 2048] @ centres.T).argmax(1) for lo in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        size = np.sqrt((sums * sums).sum(1))
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


#: Rows that centres are drawn from, bytes of these, and centres at most; all of one vector length.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CENTRES = 20_000, 32 << 20, 1024


def centres_by_length(units: DataFrame, wanted: Callable[[int, int], int], seed: int = 1) -> dict[int, np.ndarray]:
    """For each vector length its centres, as many as ``wanted(length, rows)``, from a bounded sample."""
    out = {}
    for r in units.groupBy("dim").agg(F.count("*").alias("n")).collect():  # one for each vector length
        dim = r["dim"]
        n = max(1, min(MOST_CENTRES, wanted(dim, r["n"])))
        drawn = units.filter(F.col("dim") == dim).select("unit").orderBy(F.xxhash64(F.lit(seed), "key")).limit(max(n, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim))))  # the sample's own bound
        out[dim] = draw_centres(matrix([x["unit"] for x in drawn.collect()], dim), n, seed)
    return out


def nearest_in_cells(rows: DataFrame, k: int = 12, key: str = "id", vector: str = "vector", cells: int | None = None, probes: int = 8, seed: int = 1) -> DataFrame:
    """(src, dst, cos, rank) as ``nearest``, but every row meets only the rows of the ``probes`` cells nearest to it, so that a row is
    sent ``probes`` + 1 times whatever the number of rows.

    Cells are those of ``cells`` centres (about the square root of the number of rows); all rows are in a cell.  Approximate: a neighbour in a cell that is
    not looked at is missed (see the test for the recall); a cell of many rows is dealt into blocks, each compared in a task of its own."""
    own = unit_rows(rows, key, vector)
    kind = dict(own.dtypes)["key"]
    shared = rows.sparkSession.sparkContext.broadcast(centres_by_length(own, lambda _, n: cells or int(n**0.5), seed))  # MOST_CENTRES vectors of a length at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                n = part.num_rows
                order = np.argsort(-(matrix(part.column(2).to_pylist(), int(dim)) @ shared.value[int(dim)].T), axis=1, kind="stable")[:, :probes]
                # the row's own cell is where it can be found; it looks in all of its cells
                at = pa.array(np.concatenate([np.repeat(np.arange(n), order.shape[1]), np.arange(n)]))
                side = np.repeat(np.array([0, 1], np.int32), [order.size, n])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([order.ravel(), order[:, 0]]).astype(np.int64)), pa.array(side), *(part.column(i).take(at) for i in range(3))], ["cell", "side", "key", "dim", "unit"])

    dealt = own.mapInArrow(deal, f"cell long, side int, key {kind}, dim int, unit binary")
    sizes = dealt.groupBy("dim", "cell").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    parts = sizes.select("dim", "cell", F.greatest(F.lit(1), F.ceil(F.col("n0") / BLOCK_ROWS)).cast("int").alias("p0"), F.greatest(F.lit(1), F.ceil(F.col("n1") / BLOCK_ROWS)).cast("int").alias("p1"))
    joined = dealt.join(F.broadcast(parts), ["dim", "cell"])  # MOST_CENTRES rows of a length at most
    left = F.col("side") == 0
    mine = F.pmod(F.xxhash64("key"), F.when(left, F.col("p0")).otherwise(F.col("p1"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(left, F.col("p1")).otherwise(F.col("p0")) - 1))
    met = joined.withColumn("mine", mine).withColumn("other", others).select("dim", F.concat_ws("/", "cell", F.when(left, F.col("mine")).otherwise(F.col("other"))).alias("i"), F.when(left, F.col("other")).otherwise(F.col("mine")).alias("j"), "side", "key", "unit")
    return ranked(met.repartition("dim", "i", "j").sortWithinPartitions("dim", "i", "j").mapInArrow(_meet(k, kind), f"src {kind}, dst {kind}, cos double"), k)


def classify(pairs: DataFrame, similar: float = 0.78, inter: float = 0.55, cross: float = 0.60) -> DataFrame:
    """Edge type of a neighbour pair with a_source, a_filename, b_source, b_filename and cos; others go."""
    same = F.col("a_source") == F.col("b_source")
    kind = (
        F.when(F.col("cos") <= 0, None)
        .when(same & (F.col("a_filename") == F.col("b_filename")) & (F.col("cos") > similar), "similar")
        .when(same & (F.col("a_filename") != F.col("b_filename")) & (F.col("cos") > inter), "inter_file")
        .when(~same & (F.col("cos") > cross), "cross_domain")
    )
    return pairs.withColumn("edge_type", kind).filter("edge_type is not null")


def cap_similar(edges: DataFrame, most: int = 5) -> DataFrame:
    """Similar edges: the best ``most`` of each source, with rank and total; other edges stay."""
    rest = edges.filter("edge_type <> 'similar'").withColumn("intra_rank", F.lit(None).cast("int")).withColumn("intra_total", F.lit(None).cast("int"))
    w = Window.partitionBy("src").orderBy(F.desc("cos"), "dst")
    top = edges.filter("edge_type = 'similar'").withColumn("intra_rank", F.row_number().over(w)).filter(F.col("intra_rank") <= most)
    top = top.withColumn("intra_total", F.count("*").over(Window.partitionBy("src")).cast("int"))
    return rest.unionByName(top)


def similarity_edges(chunks: DataFrame, k: int = 12, key: str = "id", vector: str = "vector", near: DataFrame | None = None, **limits: float) -> DataFrame:
    """Directed edges src, dst, edge_type, weight, cos, intra_rank, intra_total: top k over the whole corpus (or those of ``near``, where they
    are kept or come from an index), then classified, then capped."""
    meta = lambda p: chunks.select(F.col(key).alias(p), F.col("source").alias(f"{p}_source"), F.col("filename").alias(f"{p}_filename"))
    near = nearest(chunks, k, key, vector) if near is None else near
    pairs = near.join(meta("a"), near.src == F.col("a")).join(meta("b"), near.dst == F.col("b")).drop("a", "b")
    return cap_similar(classify(pairs, **limits)).select("src", "dst", "edge_type", F.round("cos", 3).alias("weight"), "cos", "intra_rank", "intra_total")


def with_file_headers(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Ranked hits (source, filename) with their rank and, where a run of hits of one file begins, the file's canonical name."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a search's few hits
    file = F.coalesce(canonical(F.col("source"), F.col("filename")), F.col("filename"))
    before = F.lag(file).over(Window.orderBy("rank"))
    return ranked.withColumn("header", F.when(~before.eqNullSafe(file), F.concat(F.lit("== "), file, F.lit(" ["), F.coalesce("tier", F.lit("wiki")), F.lit("]"))))


def excerpts(chunks: DataFrame, query: list[float], k: int = 3, most: int = 500, vector: str = "vector", key: str = "id") -> DataFrame:
    """What goes into a model's context: the k best chunks by rank with label, position, score and the head of their text."""
    hits = search(chunks, query, k, vector, key)
    label = F.when(F.coalesce("heading", F.lit("")) != "", F.concat("path", F.lit(" > "), "heading")).otherwise(F.col("path"))
    rank = F.row_number().over(Window.orderBy(F.desc("weighted"), F.desc("score"), key))  # k rows
    return hits.select(rank.alias("rank"), label.alias("label"), (F.col("chunk_index") + 1).alias("position"), F.col("section_count").alias("total"), "score", F.left(F.coalesce("content", F.lit("")), F.lit(most)).alias("excerpt"))


def search_records(chunks: DataFrame, query: list[float], k: int = 5, most: int = 200, vector: str = "vector", key: str = "id") -> DataFrame:
    """path, snippet, score of the k best chunks."""
    return search(chunks, query, k, vector, key).select("path", F.left(F.coalesce("content", F.lit("")), F.lit(most)).alias("snippet"), "score")
