"""Tables bucketed and sorted by a key, kept in a folder: joins by that key read them without a shuffle, in any session.

The bucket layout lies beside the data in ``_BUCKETS``, and each session enters the folder into its catalog again, under a name made from the
path; the folder, not the catalog, is the table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from lorewell.sources import files as S


def _name(path: str) -> str:
    return f"lorewell_{hashlib.md5(path.encode()).hexdigest()}"


def write(df: DataFrame, path: str, key: str, buckets: int, settle: Callable[[DataFrame], DataFrame] = lambda dealt: dealt, made: Column | None = None, codec: str | None = None) -> DataFrame:
    """Writes a new folder: one shuffle by the key, a file a bucket, each sorted.  ``made``: what the key is made of, where it isn't a column yet and need not be shuffled.  ``settle``: what is done with the dealt rows before they are written, such as grouping
    by the key and others, which then shuffles nothing.  ``codec``: how files are compressed, if not as the session has it."""
    spark, name = df.sparkSession, _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df = settle(df.repartition(buckets, key) if made is None else df.repartition(buckets, made).withColumn(key, made))
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).options(path=path, **{"compression": codec} if codec else {}).saveAsTable(name)
    S.write_small(spark, f"{path}/_BUCKETS", json.dumps({"key": key, "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}))
    return spark.table(name)


def read(spark: SparkSession, path: str) -> DataFrame:
    name = _name(path)
    if not spark.catalog.tableExists(name):
        about = json.loads(S.read_small(spark, f"{path}/_BUCKETS"))
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({about['schema']}) USING parquet CLUSTERED BY (`{about['key']}`) SORTED BY (`{about['key']}`) INTO {about['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(name)
