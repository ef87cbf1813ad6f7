"""The neighbour index against the join of all with all."""

import numpy as np

from lorewell.operators import vector_search as V
from lorewell.operators.neighbour_index import NeighbourIndex


def rows():
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((40, 24))
    out = [(f"k{i:05}", (centres[i % 40] + 0.25 * draw.standard_normal(24)).tolist()) for i in range(1000)]
    out += [(f"e{i:03}", draw.standard_normal(7).tolist()) for i in range(30)]  # another length
    out += [(f"c{i:03}", centres[0].tolist()) for i in range(150)]  # copies, more than a cell holds
    return [*out, ("zero", [0.0] * 24), ("none", None), ("gap", [1.0, None]), ("nan", [float("nan")] * 24), ("alone", [1.0] * 5)]


def brute(own, k):
    out = set()
    for dim in (24, 7):
        good = [(key, np.array(v, float)) for key, v in own if v and len(v) == dim and np.isfinite(v).all() and any(v)]
        keys, x = [g[0] for g in good], np.array([g[1] for g in good])
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        cos = np.round(x @ x.T, 9)
        for i, key in enumerate(keys):
            best = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-cos[i, j], keys[j]))[:k]
            out |= {(key, keys[j], n + 1) for n, j in enumerate(best)}
    return out


def test_index_and_join_agree_and_cells_are_skipped(spark, tmp_path):
    own = rows()
    df = spark.createDataFrame(own, "id string, vector array<double>").selectExpr("*", "1 as dim", "'x' as cell")
    want = brute(own, 5)
    as_set = lambda found: {(r["src"], r["dst"], r["rank"]) for r in found.collect()}
    assert as_set(V.nearest(df, 5)) == want
    NeighbourIndex(spark, str(tmp_path / "ix")).build(df, cell_bytes=24 * 8 * 64)
    kept = NeighbourIndex(spark, str(tmp_path / "ix"))  # as another build finds it
    found, work = kept.nearest(5)
    assert as_set(found) == want
    for r in work.collect():
        assert r["compared"] + r["skipped"] == r["asked"] * r["cells"]
        assert r["dim"] != 24 or (r["cells"] > 15 and r["skipped"] > 0.7 * r["asked"] * r["cells"])
    asked = spark.createDataFrame([x for x in own if x[0] in ("k00003", "e004", "alone", "none")], "id string, vector array<double>")
    assert as_set(kept.nearest(5, asked)[0]) == {x for x in want if x[0] in ("k00003", "e004")}
    assert as_set(V.nearest(df, 5, asked=asked)) == {x for x in want if x[0] in ("k00003", "e004")}


def test_cells_are_read_by_bucket(spark, tmp_path):
    df = spark.createDataFrame(rows()[:200], "id string, vector array<double>")
    own = NeighbourIndex(spark, str(tmp_path / "ix")).build(df, cell_bytes=24 * 8 * 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        visits = own.cells().select("cell").join(own.cells().select("cell", "units"), "cell")
        assert "Exchange" not in visits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([("none", None)], "id string, vector array<double>")
    own = NeighbourIndex(spark, str(tmp_path / "ix")).build(df)
    found, work = own.nearest(3)
    assert found.count() == 0 and work.count() == 0 and V.nearest(df, 3).count() == 0


def test_blocks_meet_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Vectors are shuffled once, however many blocks there are."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "SIDE_BYTES", 1 << 15)
    own = rows()
    df = spark.createDataFrame(own, "id string, vector array<double>")
    blocks = V.blocks(V.unit_rows(df, "id", "vector"), str(tmp_path / "blocks"))
    assert blocks.count() > 60 and blocks.agg({"n": "max"}).first()[0] == 16
    plan = V.every_pair(blocks, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan.replace("BroadcastExchange", "Exchange")
    assert {(r["src"], r["dst"], r["rank"]) for r in V.nearest(df, 5).collect()} == brute(own, 5)


def test_best_rows_do_not_hang_on_the_order_of_blocks():
    draw = np.random.default_rng(3)
    base, unit = draw.standard_normal((5, 6)), lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    some = lambda n: unit(np.where(draw.random((n, 1)) < 0.6, base[draw.integers(0, 5, n)], draw.standard_normal((n, 6))))
    x, y, asked, keys = some(300), some(500), draw.integers(0, 400, 300), np.sort(draw.permutation(1000)[:500])
    best = V.Best(asked, x, 4)
    for part in np.split(draw.permutation(500), (90, 350)):  # many copies, and both sides of a tie in different blocks
        part = np.sort(part)
        best.see(keys[part], y[part])
    cos = np.round(x @ y.T, 9)
    assert list(zip(best.row, best.key)) == [(i, keys[j]) for i in range(300) for j in sorted((j for j in range(500) if keys[j] != asked[i]), key=lambda j: (-cos[i, j], keys[j]))[:4]]
