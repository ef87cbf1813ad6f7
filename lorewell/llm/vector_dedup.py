"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are compared within their label and length.  Equal vectors are one representative with a count.  Each
representative is normalised and turned by random rotations; the signs are its code, and the inner
product of code and turned vector is its correction factor.  Code and factor are stored once, beside the vector rounded to one
byte a component and what the rounding left.  Banded code bits name the
cells in which candidates meet, by their codes: <code of x, turned y> / factor of x is an
unbiased estimate of the cosine, taken of the rounded y; a pair whose confidence bound (with all that the rounding can make up) lies below the threshold
needs no more work.  The pairs that the bound lets pass are kept as bits, one row of bits for each vector and cell; only vectors with such a pair are
fetched into their cell, and exactly these pairs are recomputed in double precision.  A pair counts in the first band in which its cells agree.
Every length has rotations and bands of its own, which follow from the number of its vectors and the wanted recall, however few they
are; only where ``exact_upto`` is given, labels of up to so many vectors of a length are compared without codes (for tests).
A cell of more than ``block`` members is dealt into pairs of blocks.

Nulls and edges: vectors that are null, zero, or hold null or non-finite components, and those
with a null label, link with nothing; vectors of different length link with nothing; repeated rows
link as equal vectors do (cosine 1), rows with the same id count as different vectors in n_links;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.components import components
from lorewell.llm.packed import rows as rows_of
from lorewell.llm.scratch import Scratch


def rotations(dim: int, n: int, seed: int) -> np.ndarray:
    """n random orthogonal dim x dim matrices."""
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        q, r = np.linalg.qr(draw.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out) if out else np.zeros((0, dim, dim))


def band_plan(n: int, threshold: float, recall: float, cell: int) -> tuple[int, int]:
    """Bits of a band, and bands: about ``cell`` of n vectors share a cell, and a pair at the threshold
    meets in some band with the probability ``recall``."""
    same = 1 - np.arccos(threshold) / pi
    bits = max(4, ceil(log2(max(1, n / cell))))
    return bits, max(1, ceil(log(1 - recall) / log(1 - same**bits)))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", recall: float = 0.995, cell: int = 24, block: int = 512, code_rotations: int = 4, sigmas: float = 3.5, seed: int = 7, exact_upto: int = 0
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    store = Scratch(spark, "vectors")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = None if label is None or v is None or any(e is None for e in v) else np.asarray(v, "<f8")
                good = x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
                vecs.append((x + 0.0).tobytes() if good else None)
                keys.append(hashlib.blake2b(f"{label}\0".encode() + vecs[-1], digest_size=16).hexdigest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "x"])

    rows = store.write(given.mapInArrow(checked, "vec_id long, label string, key string, x binary"), "rows")
    # equal vectors: one representative each, with the smallest id and the number of rows
    reps = store.write(rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("x").alias("x")), "reps")
    # for each length that two vectors of a label share: bits, bands and rotations (none where one cell takes all)
    most = reps.groupBy("label", (F.length("x") / 8).cast("int").alias("dim")).agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).filter("n > 1")
    plans = {}
    for dim, n in sorted(most.collect()):
        if n <= exact_upto:
            plans[dim] = 0, 1, None
        else:
            bits, bands = band_plan(n, threshold, recall, cell)
            turned = rotations(dim, max(code_rotations, ceil(bits * bands / dim)), seed)
            plans[dim] = bits, bands, spark.sparkContext.broadcast(turned.astype(np.float32))  # dim x dim each

    def cells_of(unit: np.ndarray) -> np.ndarray:
        dim = unit.shape[1]
        bits, bands, shared = plans[dim]
        if shared is None:
            return np.zeros((len(unit), 1), np.int64)
        signs = np.concatenate([unit @ r.T for r in shared.value[: ceil(bits * bands / dim)]], 1)[:, : bits * bands] > 0
        return signs.reshape(len(unit), bands, bits) @ (1 << np.arange(bits)).astype(np.int64)

    def units(blobs: list[bytes]) -> np.ndarray:
        x = np.stack([np.frombuffer(b, "<f8") for b in blobs])
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths: dict[int, list[dict]] = {}
            for r in rows_of([batch]):
                lengths.setdefault(len(r["x"]) // 8, []).append(r)
            for dim in sorted(lengths.keys() & plans.keys()):
                own, bands, step = lengths[dim], plans[dim][1], max(1, 64_000 // dim)
                for lo in range(0, len(own), step):
                    part = own[lo : lo + step]
                    unit = units([r["x"] for r in part])
                    shared = plans[dim][2]
                    if shared is None:
                        bits, factor = np.zeros((len(part), 0), np.uint8), np.zeros(len(part))
                    else:
                        turned = np.concatenate([unit @ r.T for r in shared.value[:code_rotations]], 1) / np.sqrt(code_rotations)
                        bits, factor = np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
                    scale = np.abs(unit).max(1) / 127
                    round_ = np.rint(unit / scale[:, None]).astype(np.int8)
                    left = np.sqrt(((unit - round_ * scale[:, None]) ** 2).sum(1))
                    cells = cells_of(unit).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["label"] for r in part]), pa.array(np.full(len(part), dim, np.int32)), pa.array([r["key"] for r in part]), pa.array([c.tolist() for c in cells], pa.list_(pa.int64())), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(factor), pa.array([b.tobytes() for b in round_], pa.binary()), pa.array(scale), pa.array(left)],
                        ["label", "dim", "key", "cells", "code", "factor", "rounded", "scale", "left"],
                    )

    cell_key = ["label", "dim", "band", "cell"]
    codes = store.write(reps.select("label", "key", "x").mapInArrow(coded, "label string, dim int, key string, cells array<long>, code binary, factor double, rounded binary, scale double, left double"), "codes")
    in_cells = codes.select("label", "dim", F.posexplode("cells").alias("band", "cell"), "key", "code", "factor", "rounded", "scale", "left")
    sizes = store.write(in_cells.groupBy(*cell_key).agg(F.count("*").alias("m")).filter("m > 1"), "cells")
    # block pairs (i <= j) of large cells; small ones have the one pair (0, 0)
    parts = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    met = [*cell_key, "i", "j"]
    dealt = (
        in_cells.join(sizes.withColumn("parts", parts), cell_key).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*cell_key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "code", "factor", "rounded", "scale", "left")
        .repartition(*met).sortWithinPartitions(*met)
    )
    limit = np.float64(threshold)

    def by_cell(fn):
        """``fn(rows of a block pair, places of the left, places of the right)`` gives a batch or nothing."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(held: list[dict]) -> pa.RecordBatch | None:
                side = np.array([r["own"] for r in held])
                left, right = (np.flatnonzero(side == held[0][k]) for k in ("i", "j"))
                return fn(held, left, right) if len(held) > 1 and len(left) and len(right) else None

            now, held = None, []
            for row in rows_of(batches):
                key = tuple(row[k] for k in met)
                if held and key != now:
                    if (out := done(held)) is not None:
                        yield out
                    held = []
                now = key
                held.append(row)
            if held and (out := done(held)) is not None:
                yield out

        return run

    def reject(held: list[dict], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        """The members of a block pair that have a pair which the bound lets pass, in the order of their keys, each with the bits of its later partners."""
        dim = held[0]["dim"]
        shared = plans[dim][2]
        pairs = np.zeros((len(held), len(held)), bool)
        if shared is None:
            pairs[:] = True
        else:
            turns = shared.value[:code_rotations]
            width = code_rotations * dim
            code = np.unpackbits(np.frombuffer(b"".join(r["code"] for r in held), np.uint8).reshape(len(held), -1), axis=1, count=width) * 2.0 - 1
            # <code, turned y> is <code turned back, y>
            back = sum(code[:, k * dim : (k + 1) * dim] @ turns[k] for k in range(code_rotations)) / np.sqrt(code_rotations * width)
            factor, rest = np.array([r["factor"] for r in held]), np.array([r["left"] for r in held])
            back /= factor[:, None]
            y = np.frombuffer(b"".join(r["rounded"] for r in held), np.int8).reshape(len(held), dim) * np.array([r["scale"] for r in held])[:, None]
            bound = sigmas * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(1, width - 1))
            size = np.sqrt((back * back).sum(1))
            maybe = back[left] @ y[right].T + bound[left][:, None] + size[left][:, None] * rest[right][None] >= limit
            pairs[np.ix_(left, right)] = maybe
            pairs |= pairs.T
        np.fill_diagonal(pairs, False)
        at = sorted(np.flatnonzero(pairs.any(1)), key=lambda k: held[k]["key"])
        if not at:
            return None
        bits = np.packbits(np.triu(pairs[np.ix_(at, at)], 1), axis=1)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([*(pa.array([held[k][c] for k in at], kind) for c, kind in zip((*met, "own", "key"), kinds)), pa.array([b.tobytes() for b in bits], pa.binary())], [*met, "own", "key", "pairs"])

    passed = store.write(dealt.mapInArrow(by_cell(reject), "label string, dim int, band int, cell long, i int, j int, own int, key string, pairs binary"), "passed")
    again = passed.join(reps.select("key", "n", "x"), "key").select(*met, "own", "key", "pairs", "n", "x").repartition(*met).sortWithinPartitions(*met, "key")

    def compare(held: list[dict], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        unit = units([r["x"] for r in held])
        a, b = np.nonzero(np.unpackbits(np.frombuffer(b"".join(r["pairs"] for r in held), np.uint8).reshape(len(held), -1), axis=1, count=len(held)))
        exact = np.empty(len(a))
        step = max(1, (1 << 22) // unit.shape[1])
        for lo in range(0, len(a), step):
            exact[lo : lo + step] = (unit[a[lo : lo + step]] * unit[b[lo : lo + step]]).sum(1)
        a, b = a[exact >= limit], b[exact >= limit]
        cells = cells_of(unit)
        new = (cells[a] == cells[b]).argmax(1) == held[0]["band"]
        a, b = a[new], b[new]
        if not len(a):
            return None
        n = np.array([r["n"] for r in held])
        links = np.zeros(len(held), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        root = np.arange(len(held))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for x, y in zip(a, b):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array([held[k]["key"] for k in at], pa.string()), pa.array([held[find(k)]["key"] for k in at], pa.string()), pa.array(links[at], pa.int64())], ["key", "root", "links"])

    found = store.write(again.mapInArrow(by_cell(compare), "key string, root string, links long"), "found")
    store.drop(codes, sizes, passed)
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), store)
    ids = reps.select("key", "rep", "n")
    groups = store.write(ids.join(roots, ids.key == roots.node, "left").select("key", "rep", "n", F.coalesce("root", "key").alias("root")), "groups")
    least = store.few(groups.groupBy("root").agg(F.min("rep").alias("component_id")))
    counts = store.write(found.groupBy("key").agg(F.sum("links").alias("links")), "counts")
    named = groups.join(least, "root").join(counts, "key", "left").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    done = store.write(named, "named")
    store.drop(reps, found, roots, groups, least, counts)
    out = rows.select("vec_id", "key").join(done, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
