"""Tables that cut lineage, kept in the folder which all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset and Spark runs
inside one machine (tests), a temporary folder is made, which goes when Python ends; on a cluster the setting is required.
Tables that a returned DataFrame still reads stay until that folder is cleaned.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def base_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lorewell-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def modest_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let this session's Arrow batches be small, as rows here may be large: a batch is held by the JVM and by
    each Python worker, besides what is made of it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


class Scratch:
    """Written tables of one operator run; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        modest_batches(spark)
        self.root = f"{base_dir(spark)}/lorewell/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        schema = df.schema
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def few(self, df: DataFrame, most: int = 50_000) -> DataFrame:
        """A table of a few numbers a row, written, and broadcast if it has at most ``most`` rows."""
        out = self.write(df, "few")
        shared = F.broadcast(out) if out.count() <= most else out
        shared._scratch_path = out._scratch_path
        return shared

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables and let Spark's cleaner remove the shuffle files of finished jobs."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)
        self.release()

    def release(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()
