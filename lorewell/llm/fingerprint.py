"""Document fingerprints: a Merkle tree over sections and paragraphs.

A document's tree has its sections (divided by blank lines), their paragraphs (lines) and, below
each paragraph, grains cut by content: one starts where the hash of the next ``WINDOW`` bytes is the least
of as many places to either side (ties: the first), so grains realign after an edit in any script, with or without
spaces.  A stretch of more than ``GRAIN_BYTES`` without such a place is cut by length.  A
paragraph's node is a cryptographic hash of its text, a section's that of its paragraphs' nodes, the
root that of the sections' nodes; equal roots mean equal texts, and where roots differ only differing
branches are looked into: sections that both trees hold are alike as a whole, then the paragraphs of the other sections, and only
below differing paragraphs grains are compared.  A fingerprint is the string ``root|size|section/section...``, ``size`` the bytes of all paragraphs, a section
``paragraph;paragraph...``, a paragraph the base64 of its node (6 bytes) and grains (4 bytes of hash of the whole grain, 1 of its length).

Nulls and edges: null text is empty; the empty text has a fingerprint too; repeated rows are
separate documents; ties of the id are ordered by the text's hash; a null id comes first; a single
row is its own next document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.packed import powers, prefix_hash, span_hash
from lorewell.llm.scratch import modest_batches

#: Bytes of a window (a power of two; no less than the places compared, so that lines don't influence each other).
WINDOW = 16
#: Longest grain; its length takes one byte.
GRAIN_BYTES = 255
PIECE = 1 << 20
_MOST = np.uint64(2**64 - 1)


def _minima(data: np.ndarray) -> np.ndarray:
    """Where the hash of the next WINDOW bytes, all of one line, is the least of WINDOW places to either side."""
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    prefix = prefix_hash(data)
    h = (prefix[WINDOW:] - prefix[:-WINDOW]) * powers(len(data))[1][:n]
    line = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int32)))
    h[line[WINDOW:] != line[:-WINDOW]] = _MOST
    edge = np.full(WINDOW, _MOST)
    least, step = np.concatenate((edge, h, edge)), 1
    while step < WINDOW:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    return np.flatnonzero((h < least[:n]) & (h <= least[WINDOW + 1 :][:n]))


def _grains(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4 bytes of hash and 1 of length for each grain, and the number of its line."""
    size = len(data)
    feeds = np.flatnonzero(data == 10)
    lines, stops = np.concatenate(([0], feeds + 1)), np.append(feeds, size)
    cuts = [lines[lines < stops]]
    for lo in range(0, size, PIECE):
        first = max(0, lo - WINDOW)
        at = _minima(data[first : lo + PIECE + 2 * WINDOW]) + first
        cuts.append(at[(at >= lo) & (at < lo + PIECE)])
    a = np.unique(np.concatenate(cuts))
    line = np.searchsorted(feeds, a)
    b = np.minimum(np.append(a[1:], size), stops[line])
    n = -(-(b - a) // GRAIN_BYTES)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b, line = np.repeat(a, n) + nth * GRAIN_BYTES, np.repeat(b, n), np.repeat(line, n)
    b = np.minimum(b, a + GRAIN_BYTES)
    out = np.zeros((len(a), 5), np.uint8)
    for lo in range(0, size, PIECE):
        i, j = np.searchsorted(a, (lo, lo + PIECE))
        if i < j:
            h = span_hash(prefix_hash(data[lo : lo + PIECE + GRAIN_BYTES]), a[i:j] - lo, b[i:j] - lo)
            out[i:j, :4] = h.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = b - a
    return out, line


def fingerprint(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    grains, line_of = _grains(np.frombuffer(raw, np.uint8))
    ends = np.searchsorted(line_of, np.arange(len(lines) + 1)) * 5
    grains = grains.tobytes()
    sections, paragraphs, nodes, root = [], [], [], hashlib.blake2b(digest_size=16)
    for i, line in enumerate(lines):
        node = hashlib.blake2b(line, digest_size=16).digest()
        nodes.append(node)
        paragraphs.append(base64.b64encode(node[:6] + grains[ends[i] : ends[i + 1]], b"+_").decode())
        if i + 1 == len(lines) or not line.strip():
            root.update(hashlib.blake2b(b"".join(nodes), digest_size=16).digest())
            sections.append(";".join(paragraphs))
            paragraphs, nodes = [], []
    return f"{root.hexdigest()}|{len(raw) - len(lines) + 1}|{'/'.join(sections)}"


def parts_of(mark: str) -> tuple[str, int, list[str]]:
    """Root, size and sections of a fingerprint."""
    root, size, tree = mark.split("|", 2)
    return root, int(size), tree.split("/")


def _decoded(paragraph: str) -> bytes:
    return base64.b64decode(paragraph, b"+_")[6:]


def _size(paragraphs: Counter) -> int:
    """Bytes of paragraphs: the lengths of their grains."""
    return sum(sum(_decoded(p)[4::5]) * n for p, n in paragraphs.items())


def likeness(a: str, b: str) -> float:
    """Share of length in common branches, of the longer one's length; 1 for equal roots.  What stands in both several times counts as
    often as in the one that has it less often."""
    (root_a, size_a, x), (root_b, size_b, y) = parts_of(a), parts_of(b)
    if root_a == root_b:
        return 1.0
    most = max(size_a, size_b)
    if not most:
        return 0.0
    x, y = Counter(x), Counter(y)
    shared = x & y
    same = sum(_size(Counter({p: n * m for p, n in Counter(s.split(";")).items()})) for s, m in shared.items())
    below = lambda nodes, cut: Counter(part for s, n in (nodes - shared).items() for part in s.split(cut) for _ in range(n))
    x, y = below(x, ";"), below(y, ";")
    shared = x & y
    same += _size(shared)
    grains = lambda nodes: Counter(raw[i : i + 5] for p, n in (nodes - shared).items() for raw in [_decoded(p)] for i in range(0, len(raw), 5) for _ in range(n))
    same += sum(g[4] * n for g, n in (grains(x) & grains(y)).items())
    return same / most


def edit_spans(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``b`` whose branches differ from ``a``'s at the same place."""
    (root_a, _, left), (root_b, _, right) = parts_of(a), parts_of(b)
    out: list[tuple[int, int]] = []
    if root_a == root_b:
        return out
    for i, section in enumerate(right):
        if i >= len(left) or section != left[i]:
            other = left[i].split(";") if i < len(left) else []
            out += [(i, j) for j, p in enumerate(section.split(";")) if j >= len(other) or other[j] != p]
    return out


def _ranked(cuts: list[int], x: Column) -> Column:
    """How many of the ascending cuts are no greater: first among every k-th, then among the k from there on."""
    if not cuts:
        return F.lit(0)
    k = max(1, int(len(cuts) ** 0.5))
    every = lambda cs: F.array(*[F.lit(c).cast("long") for c in cs])
    block = F.size(F.filter(every(cuts[::k]), lambda c: c <= x))
    inside = F.size(F.filter(F.slice(every(cuts), (F.greatest(block, F.lit(1)) - 1) * k + 1, F.lit(k)), lambda c: c <= x))
    return F.when(block == 0, 0).otherwise((block - 1) * k + inside)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, id, text, ghost: rows dealt by ranges of the id; the first row of a range is also
    the last, as a ghost, of the range before it (of the last range for the first one)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = _ranked(cuts, F.col("id"))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), -1).otherwise(bucket)).withColumn("tie", F.xxhash64("text"))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("f")).orderBy("bucket").collect()  # one row a range
    first = {r["bucket"]: (r["f"]["id"], r["f"]["tie"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)}
    ids, ties, before = (F.array(*[F.lit(first.get(k, (None, None, None))[j]).cast(kind) for k in range(-1, len(cuts) + 1)]) for j, kind in enumerate(("long", "long", "int")))
    at = F.col("bucket") + 2
    ghosts = F.when(F.element_at(ids, at).eqNullSafe(F.col("id")) & (F.element_at(ties, at) == F.col("tie")), F.element_at(before, at))
    both = F.array_compact(F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("ghost")), F.when(ghosts.isNotNull(), F.struct(ghosts.alias("to"), F.lit(1).alias("ghost")))))
    return rows.select("id", "text", "tie", F.explode(both).alias("x")).select("id", "text", "tie", F.col("x.to").alias("bucket"), F.col("x.ghost").alias("ghost")).repartition(n, "bucket").sortWithinPartitions("bucket", "ghost", "id", "tie")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last half of its code points
    replaced by the first as many of the next document), how alike they and the next one's are, and how many branches (paragraphs) the
    edit changed, from which section and paragraph on (from 0, null if none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, fingerprint
        out: list[tuple] = []
        size = 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for name, text, bucket, ghost in zip(*cols):
                if held is not None and held[0] == bucket:
                    row, mark = _compare(held, text)
                    out.append(row)
                    size += len(row[3]) + len(row[4])
                elif not ghost:
                    mark = fingerprint(text)
                held = None if ghost else (bucket, name, text, mark)
            if size > 1 << 24:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    modest_batches(docs.sparkSession)
    return with_next(docs, id_col, text_col).select("id", "text", "bucket", "ghost").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_changed long, first_changed string")


def _compare(held: tuple, after: str) -> tuple[tuple, str]:
    _, name, text, mark = held
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    other, mark_next = fingerprint(edited), fingerprint(after)
    spans = edit_spans(mark, other)
    first = f"{spans[0][0]}:{spans[0][1]}" if spans else None
    return (name, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, other, likeness(mark, other), likeness(mark, mark_next), len(spans), first), mark_next


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_changed", "first_changed"])
