import json
import os
import time

from lorewell.operators import index
from lorewell.sources import files as S
from lorewell.sources.snapshots import SNAPSHOT_SCHEMA, ChangeFeed, difference, snapshot
from lorewell.streaming import changes as ST


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_markdown_tree_and_index(spark, tmp_path):
    write(tmp_path / "k/wiki/a b.md", "# A\nalpha")
    write(tmp_path / "k/root.md", "plain")
    write(tmp_path / "k/skip.txt", "no")
    found = S.read_markdown(spark, {"knowledge": str(tmp_path / "k"), "canon": str(tmp_path / "none")})
    assert {(r["source"], r["filename"], r["text"]) for r in found.collect()} == {("knowledge", "wiki/a b.md", "# A\nalpha"), ("knowledge", "root.md", "plain")}
    chunks = index.build_chunks(found, embed=index.hash_embedding(8), dim=8)
    S.write_chunks(chunks.drop("content"), str(tmp_path / "out"))
    back = S.read_chunks(spark, str(tmp_path / "out"))
    assert {(r["filename"], r["tier"], len(r["vector"])) for r in back.collect()} == {("wiki/a b.md", "wiki", 8), ("root.md", "wiki", 8)}
    assert index.changed_files(found, found).count() == 0
    assert index.orphan_rows(back, found.filter("filename = 'root.md'")).count() == 1
    assert S.read_chunks(spark, str(tmp_path / "absent")).count() == 0


def test_sessions_graph_and_logs(spark, tmp_path):
    write(tmp_path / "s/1.json", json.dumps({"id": "1", "title": "New Chat", "turns": [{"role": "user", "content": "hello there"}]}))
    write(tmp_path / "s/2.json", "{broken")
    sessions = S.read_sessions(spark, str(tmp_path / "s"))
    assert [(r["conv_id"], r["turn"], r["text"]) for r in S.turns_of_sessions(sessions).collect()] == [("1", 0, "hello there")]
    more = S.add_turn(sessions.filter("id = '1'"), "1", "user", "x" * 60)
    row = more.first()
    assert len(row["turns"]) == 2 and row["title"] == "x" * 50 + "..."
    assert S.delete_session(more, "1").count() == 0
    assert S.new_session(spark).first()["turns"] == []
    write(tmp_path / "g.json", json.dumps({"nodes": [{"id": "a", "node_type": "chunk"}], "edges": [{"source_id": "a", "target_id": "b", "edge_type": "similar", "weight": 0.5}]}))
    nodes, edges = S.read_graph_document(spark, str(tmp_path / "g.json"))
    assert nodes.first()["attributes"] == {} and edges.first()["src"] == "a"
    S.append_log(spark.createDataFrame([("t", "start")], "ts string, event string"), str(tmp_path / "log"))
    assert S.read_log(spark, str(tmp_path / "log")).first()["event"] == "start"


def test_change_feed_sees_modified_files(spark, tmp_path):
    root, seen = tmp_path / "kb", []
    write(root / "a.md", "1")
    write(root / "b.md", "1")

    def apply(batch, n):
        seen.extend((r["path"], r["op"]) for r in batch.collect())

    def once():
        q = ST.upsert(ST.change_feed(spark, str(root)), apply, str(tmp_path / "cp"))
        q.awaitTermination(60)

    once()
    assert sorted(seen) == [("a.md", "created"), ("b.md", "created")]
    seen.clear()
    os.utime(root / "a.md", (time.time() + 5, time.time() + 5))
    once()
    assert seen == [("a.md", "modified")]


def test_suppression(spark):
    changes = spark.createDataFrame([("a.md", "modified", 1000), ("a.md", "modified", 9000), ("b.md", "modified", 1000)], ST.CHANGE_SCHEMA)
    registered = spark.createDataFrame([("a.md", 500)], "path string, at_ms long")
    assert {(r["path"], r["mtime"]) for r in ST.suppress(changes, registered).collect()} == {("a.md", 9000), ("b.md", 1000)}


def test_streamed_admission_equals_the_batch(spark, tmp_path):
    from lorewell.operators import policy

    rows = [("t1" if i % 3 else "t2", i, ["write", "orient"][i % 2], f"s{i % 5}") for i in range(30)]
    calls = spark.createDataFrame(rows, "turn_id string, seq long, class string, signature string")
    for k in range(3):
        calls.filter(f"seq >= {10 * k} and seq < {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ST.admit_stream(stream).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r["turn_id"], r["seq"], r["decision"]) for r in policy.admit(calls).collect()}
    assert {(r["turn_id"], r["seq"], r["decision"]) for r in spark.table("admitted").collect()} == want


def test_snapshots_see_what_times_hide(spark, tmp_path):
    root = tmp_path / "kb"
    for name in ("a.md", "b.md", "sub/c [x].md", "d.md"):
        write(root / name, f"text of {name}")
    write(root / "no.txt", "x")
    feed = ChangeFeed(spark, str(root), str(tmp_path / "feed"))
    seen = lambda: sorted((r["path"], r["op"]) for r in feed.changes().collect())
    assert feed.poll() == 4 and seen() == [(n, "created") for n in ("a.md", "b.md", "d.md", "sub/c [x].md")]
    assert feed.poll() == 0 and feed.log.versions() == [1]
    write(root / "a.md", "other text, restored")
    os.utime(root / "a.md", (1_000_000, 1_000_000))  # older than anything seen
    (root / "b.md").unlink()
    os.utime(root / "d.md", (2_000_000_000, 2_000_000_000))  # touched only
    (root / "sub/c [x].md").rename(root / "sub/e.md")
    assert feed.poll() == 4 and seen() == [("a.md", "modified"), ("b.md", "deleted"), ("sub/c [x].md", "deleted"), ("sub/e.md", "created")]
    # killed between commit and publication: the next poll finishes it
    (root / "a.md").unlink()
    feed._publish, kept = lambda version: None, feed._publish
    assert feed.poll() == 1
    feed._publish = kept
    assert feed.poll() == 0 and seen() == [("a.md", "deleted")]
    got = []
    for _ in range(2):  # every change once, restarts included
        q = ST.upsert(feed.stream(), lambda batch, n: got.extend((r["path"], r["op"]) for r in batch.collect()), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert sorted(path for path, _ in got) == ["a.md", "b.md", "d.md", "sub/c [x].md", "sub/e.md"]  # each path once in a batch, and nothing again
    assert difference(spark.createDataFrame([], SNAPSHOT_SCHEMA), snapshot(spark, str(tmp_path / "none"))).count() == 0


def test_suppression_expires_without_input_and_outlives_a_restart(spark, tmp_path):
    kinds = {"c": ST.CHANGE_SCHEMA, "r": "path string, at_ms long"}
    for k, schema in kinds.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / k))

    def put(k, *rows):
        spark.createDataFrame(list(rows), kinds[k]).coalesce(1).write.mode("append").parquet(str(tmp_path / k))

    def run(ttl_ms):
        stream = lambda k: spark.readStream.schema(kinds[k]).parquet(str(tmp_path / k))
        q = ST.suppress_stream(stream("c"), stream("r"), ttl_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return sorted(r["path"] for r in spark.read.schema(ST.CHANGE_SCHEMA).parquet(str(tmp_path / "out")).collect())

    ttl = 45_000
    put("r", ("own.md", 1))
    put("c", ("own.md", "modified", 2), ("other.md", "modified", 2))
    began = time.time()
    assert run(ttl) == ["other.md"]
    put("c", ("own.md", "modified", 3))
    if time.time() - began < ttl / 1000 - 15:  # else this machine is too slow to tell
        assert run(ttl) == ["other.md"]  # a new query from the checkpoint still knows
    time.sleep(max(0, began + ttl / 1000 + 15 - time.time()))
    put("c", ("own.md", "modified", 4))
    assert "own.md" in run(ttl)
