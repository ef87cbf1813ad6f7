"""Streams: a change feed of files, suppression, per-turn state, and upserts."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lorewell.operators.policy import CLASS_BUDGETS, HARD_CAP, Admission

CHANGE_SCHEMA = "path string, op string, mtime long"


class Changes(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int]]):
        self.rows = rows


def _mark(path: str) -> bytes:
    return hashlib.blake2b(path.encode(), digest_size=6).digest()


class FileChangeReader(DataSourceStreamReader):
    """The offset is the newest change seen, in milliseconds, the paths changed in that very millisecond, and six bytes for every known
    path, which tell created files from modified ones; a batch holds what was changed between two offsets.  A file that is put in
    place with an older time comes as created; one that is changed and given an older time is not seen."""

    def __init__(self, root: str):
        self.root = root

    def _files(self) -> Iterator[tuple[str, int]]:
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.endswith(".md"):
                    path = os.path.join(folder, name)
                    yield os.path.relpath(path, self.root), int(os.stat(path).st_mtime_ns // 1_000_000)

    def initialOffset(self) -> dict:
        return {"ms": -1, "paths": "[]", "known": ""}

    def latestOffset(self) -> dict:
        newest, paths, known = -1, [], []
        for path, ms in self._files():
            known.append(_mark(path))
            if ms > newest:
                newest, paths = ms, []
            if ms == newest:
                paths.append(path)
        return {"ms": newest, "paths": json.dumps(sorted(paths)), "known": base64.b64encode(zlib.compress(b"".join(sorted(known)))).decode()}

    @staticmethod
    def _known(offset: dict) -> set[bytes]:
        raw = zlib.decompress(base64.b64decode(offset["known"])) if offset["known"] else b""
        return {raw[i : i + 6] for i in range(0, len(raw), 6)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, last = set(json.loads(start["paths"])), set(json.loads(end["paths"]))
        before, upto, rows = self._known(start), self._known(end), []
        for path, ms in sorted(self._files()):
            own = _mark(path)
            if own in upto and own not in before:
                rows.append((path, "created", ms))
            elif start["ms"] < ms < end["ms"] or ms == end["ms"] and path in last and not (ms == start["ms"] and path in old):
                rows.append((path, "modified", ms))
        return [Changes(rows[i : i + 1000]) for i in range(0, len(rows), 1000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        pass


class FileChanges(DataSource):
    """``spark.readStream.format("file_changes").option("root", ...)``: markdown files created or modified.

    The folder must be visible to the driver; the built-in file source does not see a path again once it was read."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FileChangeReader(self.options["root"])


def change_feed(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("root", root).load()


def suppress(changes: DataFrame, registered: DataFrame, ttl_ms: int = 5000) -> DataFrame:
    """Changes without those within ``ttl_ms`` after their path was registered (path, at_ms)."""
    own = registered.select(F.col("path").alias("_path"), "at_ms")
    hit = (F.col("path") == F.col("_path")) & F.col("mtime").between(F.col("at_ms"), F.col("at_ms") + ttl_ms)
    return changes.join(own, hit, "left_anti") if not changes.isStreaming else changes.join(own, hit, "left").filter("_path is null").drop("_path", "at_ms")


class Suppression(StatefulProcessor):
    """For each path whether it was registered within the last ``ttl_ms`` by the clock of processing.  The state forgets a registration by itself when its
    time is over, without further input; it lies in the stream's checkpoint, so it outlives a restart."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.registered = handle.getValueState("registered", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ms", "order"], kind="stable")  # the changes of one path in one batch
        shown = []
        for op, ms, order in zip(every["op"], every["ms"], every["order"]):
            if order == 0:
                self.registered.update((int(ms),))
            elif not self.registered.exists():
                shown.append((key[0], op, int(ms)))
        yield pd.DataFrame(shown, columns=["path", "op", "mtime"])

    def close(self) -> None:
        pass


def suppress_stream(changes: DataFrame, registered: DataFrame, ttl_ms: int = 5000) -> DataFrame:
    """A stream of changes (path, op, mtime) without those of paths that a stream of registrations (path, at_ms) has named less than ``ttl_ms``
    ago.  State with a time to live needs the RocksDB store, which the session is set to."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = registered.select("path", F.lit("registered").alias("op"), F.col("at_ms").alias("ms"), F.lit(0).alias("order"))
    every = told.unionByName(changes.select("path", "op", F.col("mtime").alias("ms"), F.lit(1).alias("order")))
    return every.groupBy("path").transformWithStateInPandas(Suppression(ttl_ms), CHANGE_SCHEMA, "Append", "ProcessingTime")


def upsert(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Each micro-batch of changed paths through ``apply`` (e.g. reindexing these files)."""
    w = changes.writeStream.foreachBatch(lambda batch, n: apply(batch.dropDuplicates(["path"]), n)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def reindex_stream(changes: DataFrame, index_, source: str, checkpoint: str, once: bool = True):
    """Every micro-batch of changed paths (relative to the root of ``source``) into a ``KnowledgeIndex``, whose lock keeps other writers out."""

    def apply(batch: DataFrame, _: int) -> None:
        files = [(source, r["path"]) for r in batch.select("path").collect()]  # of one micro-batch
        if files:
            index_.reindex(files)

    return upsert(changes, apply, checkpoint, once)


def heartbeat_stream(events: DataFrame, silence_ms: int = 3000, key: str = "user_id") -> DataFrame:
    """key, last_ms, silent_ms: a beat for every key that has been silent for ``silence_ms``, once for each silence, by the clock of the
    stream's processing; events: key and ts."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], "last_ms": [last], "silent_ms": [silence_ms]})
            return
        last = max(int(p["ms"].max()) for p in parts if len(p))
        state.update((max(last, state.get[0]) if state.exists else last,))
        state.setTimeoutDuration(silence_ms)

    own = events.select(F.col(key).cast("string").alias(key), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return own.groupBy(key).applyInPandasWithState(step, f"{key} string, last_ms long, silent_ms long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounce(events: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Bursts of changes (path, ts) as one row each, with late events up to ``delay``."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return own.groupBy("path", F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("n")).select("path", F.col("burst.start").alias("first"), F.col("burst.end").alias("until"), "n")


def admit_stream(calls: DataFrame, budgets: dict[str, int] | None = None, hard_cap: int = HARD_CAP, timeout: str = "30 minutes") -> DataFrame:
    """The admission of calls (turn_id, seq, class, signature) as they arrive; a turn's state is kept
    between batches and dropped after ``timeout`` without calls."""
    budgets = budgets or CLASS_BUDGETS
    minutes = int(timeout.split()[0]) * 60_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Admission(budgets, hard_cap)
        if state.exists:
            used, seen, own.total = state.get
            own.used, own.seen = json.loads(used), set(json.loads(seen))
        rows = pd.concat(list(parts)).sort_values("seq")
        rows["decision"] = [own.decide(c, s) for c, s in zip(rows["class"], rows["signature"])]
        state.update((json.dumps(own.used), json.dumps(sorted(own.seen)), own.total))
        state.setTimeoutDuration(minutes)
        yield rows[["turn_id", "seq", "class", "signature", "decision"]]

    own = calls.select(F.col("turn_id").cast("string"), F.col("seq").cast("long"), F.col("class").cast("string"), F.col("signature").cast("string"))
    return own.groupBy("turn_id").applyInPandasWithState(step, "turn_id string, seq long, class string, signature string, decision string", "used string, seen string, total int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def heartbeats(events: DataFrame, silence_ms: int = 3000, key: str = "user_id") -> DataFrame:
    """Batch form: silences longer than ``silence_ms`` between events of a key."""
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(Window.partitionBy(key).orderBy("ts"))
    return events.withColumn("gap_us", gap).filter(F.col("gap_us") > silence_ms * 1000)
