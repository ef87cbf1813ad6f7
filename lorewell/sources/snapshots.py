"""Changes of a folder as the difference of two snapshots.

A snapshot is a table (path, ms, size, digest) of the markdown files below a folder, listed by Spark through Hadoop's file systems; a file is read, in tasks, only if
its time or size is new.  What was created, modified and deleted comes from a full outer join of two snapshots by path.  So a file that is put back with an
older time is seen, a deletion is seen, and one that was only touched is not.

``ChangeFeed`` keeps the last snapshot in a commit log.  A poll writes its changes aside, commits them with the new snapshot in one entry, and then moves them
to where readers (and Spark's file stream, once each) find them; a poll that is killed before the commit has happened not at all, and one killed after it is
finished by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.sources import files as S
from lorewell.sources.commits import CommitLog

SNAPSHOT_SCHEMA = "path string, ms long, size long, digest string"
CHANGE_SCHEMA = "path string, op string, mtime long"
#: Changed files that are read by name; beyond, the whole folder is read.
FEW_FILES = 500


def _files(spark: SparkSession, root: str, pattern: str, only: list[str] | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if only is None:
        return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    escaped = []
    for name in only:  # a name with characters that globs use is taken as it is
        for c in "\\{}[]*?":
            name = name.replace(c, "\\" + c)
        escaped.append(f"{root.rstrip('/')}/{name}")
    return reader.load(escaped)


def snapshot(spark: SparkSession, root: str, before: DataFrame | None = None, pattern: str = "*.md") -> DataFrame:
    """The files below ``root`` as they are; digests of those whose time and size are as ``before`` are taken from there.  An absent folder has none."""
    if not S.exists(spark, root):
        return spark.createDataFrame([], SNAPSHOT_SCHEMA)
    path = S.relative(spark, F.col("path"), root)
    listed = _files(spark, root, pattern).select(path.alias("path"), F.unix_millis("modificationTime").alias("ms"), F.col("length").alias("size"))
    known = (spark.createDataFrame([], SNAPSHOT_SCHEMA) if before is None else before).select("path", "ms", "size", "digest")
    same = listed.join(known, ["path", "ms", "size"])
    new = listed.join(known, ["path", "ms", "size"], "left_anti")
    names = [r["path"] for r in new.select("path").limit(FEW_FILES + 1).collect()]
    if not names:
        return same
    read = _files(spark, root, pattern, names if len(names) <= FEW_FILES else None)
    digests = read.select(path.alias("path"), F.unix_millis("modificationTime").alias("ms"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))
    return same.unionByName(digests.join(known, ["path", "ms", "size"], "left_anti"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, op (created, modified, deleted), mtime (in milliseconds; of a deleted file the last known): what differs between two snapshots."""
    b, a = before.select("path", F.col("ms").alias("b_ms"), F.col("digest").alias("b")), after.select("path", F.col("ms").alias("a_ms"), F.col("digest").alias("a"))
    op = F.when(F.col("b_ms").isNull(), "created").when(F.col("a_ms").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return b.join(a, "path", "full_outer").select("path", op.alias("op"), F.coalesce("a_ms", "b_ms").alias("mtime")).filter("op is not null")


class ChangeFeed:
    """The changes below ``root``; ``path``: the feed's own folder."""

    def __init__(self, spark: SparkSession, root: str, path: str, pattern: str = "*.md", lease_s: float = 600):
        self.spark, self.root, self.path, self.pattern = spark, root, path.rstrip("/"), pattern
        self.log = CommitLog(spark, f"{self.path}/state", lease_s)

    def poll(self) -> int:
        """Finds what has changed since the last poll; how many changes there were."""
        with self.log.lease():
            version = self.log.last()
            self._publish(version)
            before = self._snapshot(version)
            for aside in ("snapshots", "aside"):  # of a poll that was killed
                S.remove(self.spark, f"{self.path}/{aside}/{version + 1}")
            now = S.stored(snapshot(self.spark, self.root, before, self.pattern), f"{self.path}/snapshots/{version + 1}")
            found = S.stored(difference(before, now), f"{self.path}/aside/{version + 1}")
            n = found.count()
            moved = n or now.select("path", "ms").exceptAll(before.select("path", "ms")).limit(1).count()
            if not moved:
                return 0
            self.log.commit({"changes": n}, version)
            self._publish(version + 1)
            S.remove(self.spark, f"{self.path}/snapshots/{version}")
            return n

    def _snapshot(self, version: int) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{self.path}/snapshots/{version}") if version else self.spark.createDataFrame([], SNAPSHOT_SCHEMA)

    def _publish(self, version: int) -> None:
        aside, target = f"{self.path}/aside/{version}", f"{self.path}/changes/{version}"
        if version and S.exists(self.spark, aside) and not S.exists(self.spark, target):
            S.ensure_folder(self.spark, f"{self.path}/changes")
            fs, p = S.filesystem(self.spark, aside)
            fs.rename(p, S.filesystem(self.spark, target)[1])

    def changes(self, version: int | None = None) -> DataFrame:
        """The changes of one poll, by default of the last that found any."""
        version = self.log.last() if version is None else version
        return self.spark.read.schema(CHANGE_SCHEMA).parquet(f"{self.path}/changes/{version}") if version else self.spark.createDataFrame([], CHANGE_SCHEMA)

    def stream(self) -> DataFrame:
        """All changes, as a stream that goes on with every poll."""
        S.ensure_folder(self.spark, f"{self.path}/changes")
        return self.spark.readStream.schema(CHANGE_SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.path}/changes")

    def watch(self, checkpoint: str, seconds: int = 2):
        """A query that polls every so many seconds until it is stopped."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, __: self.poll() and None).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()
