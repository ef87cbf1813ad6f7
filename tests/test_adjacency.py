"""The kept adjacency against the traversal of the edges, and what a step moves."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lorewell.operators import graph as G
from lorewell.operators.adjacency import AdjacencyIndex
from lorewell.sources import files as S

SCHEMA = "src string, dst string, edge_type string, weight double, note string"


def kept(spark, edges, **more):
    return AdjacencyIndex(spark, S.work_folder(spark, "adjacency"), **{"buckets": 8, "per_slot": 3, **more}).build(edges)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start string")


ENDS = st.sampled_from(["a", "b", "c", "d", "e", "f", None])
EDGE = st.tuples(ENDS, ENDS, st.sampled_from(["similar", "references", "parent_child"]), st.sampled_from([0.2, 0.5, 0.5, 1.0, None, -1.0]), st.just("n"))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(EDGE, max_size=25))
def test_as_the_edges_have_it(spark, edges):
    """Nulls, loops, repeated rows, ties, hubs of several shards, an empty graph."""
    df = spark.createDataFrame(edges, SCHEMA)
    own, start = kept(spark, df), starts(spark, "a", "b", "zz")
    for exclude in ((), ("similar",)):
        assert rows(own.traverse(start, 3, exclude, 0.3)) == rows(G.traverse(df, start, 3, exclude, 0.3))
    for got, want in zip(own.subgraph(start.withColumnRenamed("start", "id"), 2, max_nodes=4, max_edges=3), G.subgraph(df, start.withColumnRenamed("start", "id"), 2, max_nodes=4, max_edges=3)):
        assert rows(got.select(*want.columns)) == rows(want)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.fixture(scope="module")
def wide(spark):
    edges = spark.range(20000).selectExpr("concat('n', id % 4000) as src", "concat('m', id) as dst", "'similar' as edge_type", "0.5D as weight", "'x' as note")
    return kept(spark, edges.unionByName(spark.range(1000).selectExpr("'hub' as src", "concat('m', id) as dst", "'similar' as edge_type", "0.9D as weight", "'x' as note")), per_slot=100)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_slots_open_their_buckets(spark, wide, no_broadcast):
    """The plan states it where it keeps to the buckets; where it doesn't, files of other buckets are passed over all the same."""
    text = plan(wide.step(starts(spark, "n1").withColumn("node", S.F.col("start"))))
    assert "SelectedBucketsCount: 1 out of 8" in text
    hub = starts(spark, "hub").withColumn("node", S.F.col("start"))
    assert wide.slots(hub).count() == 10 and wide.step(hub).count() == 1000


def test_a_step_shuffles_the_frontier_only(spark, wide, no_broadcast):
    """Of a frontier too large to send to all, the plan has one exchange below the join, and none of the edges."""
    step = wide.step(S.stored(spark.range(3000).selectExpr("'s' as start", "concat('n', id) as node"), S.work_folder(spark, "front")))
    text = plan(step)
    assert step.count() == 15000 and "SortMergeJoin [slot" in text
    at = text.index("SortMergeJoin [slot")
    scan = [x for x in text[at:].splitlines() if "FileScan" in x and "neighbor" in x][0]
    assert "Bucketed: true" in scan
    indent = lambda line: len(re.match(r"[ :|+-]*", line).group())
    depth = indent(scan)
    # from the scan of the edges up to the join: nothing but projections, filters and sorts
    for line in reversed(text[at : text.index(scan)].splitlines()):
        if indent(line) < depth:
            depth = indent(line)
            assert "Exchange" not in line, text


def test_a_build_reads_its_edges_once_and_has_buckets_by_their_number(spark, monkeypatch):
    from lorewell.operators import adjacency

    monkeypatch.setattr(adjacency, "BUCKET_EDGES", 50)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.range(1000).selectExpr("concat('n', id % 40) as src", "concat('m', id) as dst", "'similar' as edge_type", "0.5D as weight", "'x' as note")
    own = kept(spark, edges.mapInArrow(count, edges.schema))
    assert seen.value == 1000
    files = own.read("near", starts(spark, *[f"m{i}" for i in range(1000)]).selectExpr("start as node", "concat('0:', start) as slot")).inputFiles()
    assert len(files) > 8
    assert rows(own.traverse(starts(spark, "n1"), 2)) == rows(G.traverse(edges, starts(spark, "n1"), 2))


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_build_shuffles_each_end_once_however_many_hubs(spark, no_broadcast):
    """Where hubs are too many for Spark to send them to all by itself, they are sent all the same, and edges are not shuffled to meet them."""
    edges = S.stored(spark.range(20000).selectExpr("concat('n', id % 40) as src", "concat('m', id % 50) as dst", "'similar' as edge_type", "0.5D as weight", "'x' as note"), S.work_folder(spark, "many"))
    before = shuffled(spark)
    own = kept(spark, edges, per_slot=100)
    assert own.hubs().count() == 90
    assert shuffled(spark) - before <= 2 * 20000 + 4000  # each edge at both ends, and counts by cell and node of each task


def test_hubs_are_few_in_a_large_graph(spark, monkeypatch):
    """So many that by per_slot each node were a hub; with few of them, and cells that nodes share, the rows are the same."""
    from lorewell.operators import adjacency

    monkeypatch.setattr(adjacency, "MOST_HUBS", 8)
    monkeypatch.setattr(adjacency, "CELLS", 16)
    edges = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hub' else concat('n', id % 100) end as src", "concat('m', id) as dst", "'similar' as edge_type", "(id % 7) / 7D as weight", "'x' as note")
    own = kept(spark, edges)
    assert [tuple(r) for r in own.hubs().collect()] == [("hub", 2)]  # 1000 edges, 750 a slot
    assert rows(own.traverse(starts(spark, "m1", "n1", "hub"), 3)) == rows(G.traverse(edges, starts(spark, "m1", "n1", "hub"), 3))
    nodes = spark.createDataFrame([("hub",), ("m0",), ("n1",), ("zz",)], "node string")
    assert rows(own.neighbors(nodes)) == rows(G.neighbors(edges).join(nodes, "node", "left_semi").select("node", "neighbor", "edge_type", "weight", "direction"))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(EDGE, max_size=25))
def test_merged_edges_are_those_grouped_before(spark, edges):
    df = spark.createDataFrame(edges, SCHEMA)
    grouped = df.groupBy("src", "dst", "edge_type", "note").agg(S.F.max("weight").alias("weight")).select(*df.columns)
    own = AdjacencyIndex(spark, S.work_folder(spark, "adjacency"), buckets=4, per_slot=3).build(df)
    start = starts(spark, "a", "b", "zz")
    assert rows(own.traverse(start, 3)) == rows(G.traverse(grouped, start, 3))
    for got, want in zip(own.subgraph(start.withColumnRenamed("start", "id"), 2, max_edges=9, merge=True), G.subgraph(grouped, start.withColumnRenamed("start", "id"), 2, max_edges=9)):
        assert rows(got.select(*want.columns)) == rows(want)


def test_tasks_deal_few_edges_and_the_session_keeps_its_splits(spark, monkeypatch):
    from lorewell.operators import adjacency

    key, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    write = adjacency.bucketed.write
    monkeypatch.setattr(adjacency.bucketed, "write", lambda df, *more: (seen.append(df.rdd.getNumPartitions()), write(df, *more))[1])
    monkeypatch.setattr(adjacency, "TASK_EDGES", 1000)
    edges = spark.range(400_000).selectExpr("uuid() as src", "uuid() as dst", "'similar' as edge_type", "0.5D as weight").coalesce(1)
    kept(spark, edges, per_slot=100)
    assert seen[0] > 2 * 15 and spark.conf.get(key) == before  # splits of a MB, once for each end
