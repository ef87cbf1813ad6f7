"""Sources and sinks: markdown trees, sessions, graphs, event logs, and pages to write."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_temporary: list[str] = []

FILE_SCHEMA = "source string, filename string, text string, mtime long"
CHUNK_SCHEMA = (
    "id string, vector array<float>, document string, filename string, source string, heading string, chunk_index long, summary string, token_count long, mtime long, "
    "file_tokens long, section_count long, file_outline string, path string, folder string, type string, tier string"
)
NODE_SCHEMA = "id string, node_type string, name string, filename string, heading string, summary string, source_chunk_id string, attributes map<string,string>, tags array<string>"
EDGE_SCHEMA = "source_id string, target_id string, edge_type string, weight double, evidence string, attributes map<string,string>"
SESSION_SCHEMA = (
    "id string, title string, created_at string, updated_at string, turns array<struct<role: string, content: string, timestamp: string, "
    "tool_calls: array<struct<name: string, args: map<string,string>>>, tool_results: array<struct<name: string, executed: boolean, delivered_chars: long, original_chars: long, truncated: boolean, preview: string>>>>"
)
LOG_SCHEMA = "ts string, module string, level string, msg string, event string, data map<string,string>, error string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def ensure_folder(spark: SparkSession, path: str) -> None:
    """Makes a folder, and those above it, unless it is there."""
    fs, p = filesystem(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def sweep(spark: SparkSession, path: str, keep: set[str]) -> None:
    """Removes what lies directly in a folder, but for the names to keep."""
    fs, p = filesystem(spark, path)
    for found in fs.listStatus(p) if fs.exists(p) else ():
        if found.getPath().getName() not in keep:
            fs.delete(found.getPath(), True)


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small text file through Spark's file systems; null if there is none."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written beside and renamed into its place."""
    fs, p = filesystem(spark, path)
    _, beside = filesystem(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE  # at no time is there no file
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(p), options)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below ``spark.checkpoint.dir``, which all executors share; where that is unset and Spark runs inside one
    machine, below a temporary one that goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _temporary:
            _temporary.append(tempfile.mkdtemp(prefix="lorewell-"))
            atexit.register(shutil.rmtree, _temporary[0], ignore_errors=True)
        base = f"file://{_temporary[0]}"
    return f"{base.rstrip('/')}/lorewell/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The table, written and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_markdown(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """source, filename, text, mtime of every .md file below the roots (by source); absent roots are skipped."""
    out = spark.createDataFrame([], FILE_SCHEMA)
    for source, root in roots.items():
        if not exists(spark, root):
            continue
        base = spark._jvm.org.apache.hadoop.fs.Path(root)
        whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
        path = F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z]+:(//[^/]*)?(?=/)", "")
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
        rel = F.substring(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), len(whole) + 2, 1 << 20)
        out = out.unionByName(files.select(F.lit(source).alias("source"), rel.alias("filename"), F.col("value").alias("text"), F.unix_seconds("_metadata.file_modification_time").alias("mtime")))
    return out


def list_markdown(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """source, filename, mtime, size of every .md file below the roots, listed by Spark without reading them."""
    out = spark.createDataFrame([], "source string, filename string, mtime long, size long")
    for source, root in roots.items():
        if exists(spark, root):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
            out = out.unionByName(files.select(F.lit(source).alias("source"), relative(spark, F.col("path"), root).alias("filename"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size")))
    return out


def relative(spark: SparkSession, path: Column, root: str) -> Column:
    """A file's path below a root, from its URI."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    return F.substring(F.regexp_replace(path, "^[A-Za-z]+:(//[^/]*)?(?=/)", ""), len(whole) + 2, 1 << 20)


def read_some(spark: SparkSession, roots: dict[str, str], files: list[tuple[str, str]]) -> DataFrame:
    """The rows of ``read_markdown`` of a few files (source, filename), without walking the folders; absent ones are left out."""
    out = spark.createDataFrame([], FILE_SCHEMA)
    for source, name in files:
        path = f"{roots[source].rstrip('/')}/{name}"
        if exists(spark, path):
            escaped = path  # a name with characters that globs use is taken as it is
            for c in "\\{}[]*?":
                escaped = escaped.replace(c, "\\" + c)
            text = spark.read.text(escaped, wholetext=True)
            out = out.unionByName(text.select(F.lit(source).alias("source"), F.lit(name).alias("filename"), F.col("value").alias("text"), F.unix_seconds("_metadata.file_modification_time").alias("mtime")))
    return out


def read_file(files: DataFrame, path: str) -> DataFrame:
    """A file by relative path: from knowledge if it is there, else from canon."""
    own = files.filter(F.col("filename") == path)
    return own.orderBy(F.when(F.col("source") == "knowledge", 0).otherwise(1)).limit(1)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table by source and tier; only partitions that occur are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "tier").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table; a table without tiers gets them by rule, vectors stay."""
    from lorewell.functions.text import tier

    if not exists(spark, path):
        return spark.createDataFrame([], CHUNK_SCHEMA)
    found = spark.read.option("mergeSchema", True).parquet(path)
    return found if "tier" in found.columns else found.withColumn("tier", tier(F.col("source"), F.col("filename")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "parquet") -> None:
    nodes.write.mode("overwrite").format(form).save(f"{path}/nodes")
    edges.write.mode("overwrite").format(form).save(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    read = lambda part: spark.read.format(form).load(f"{path}/{part}")
    return read("nodes"), read("edges")


def read_graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one JSON document {nodes: [...], edges: [...]}; missing attributes are empty."""
    schema = f"nodes array<struct<{_fields(NODE_SCHEMA)}>>, edges array<struct<{_fields(EDGE_SCHEMA)}>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    none = F.create_map().cast("map<string,string>")
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*").withColumn("attributes", F.coalesce("attributes", none))
    edges = doc.select(F.explode("edges").alias("e")).select("e.*").withColumn("attributes", F.coalesce("attributes", none))
    return nodes, edges.withColumnsRenamed({"source_id": "src", "target_id": "dst"})


def _fields(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.split(", "):
        out.append(part if depth else part.replace(" ", ": ", 1))
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session documents, one JSON file each; files that cannot be read are sessions without turns."""
    return spark.read.schema(SESSION_SCHEMA).option("mode", "PERMISSIVE").json(path, multiLine=True)


def turns_of_sessions(sessions: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, tool_calls: one row per turn."""
    turns = sessions.select(F.col("id").alias("conv_id"), F.posexplode("turns").alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", F.col("t.content").alias("text"), "t.tool_calls")


def new_session(spark: SparkSession, title: str = "New Chat") -> DataFrame:
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.range(1).select(F.expr("uuid()").alias("id"), F.lit(title).alias("title"), now.alias("created_at"), now.alias("updated_at"), F.from_json(F.lit("[]"), SESSION_SCHEMA.split("turns ", 1)[1]).alias("turns"))


def add_turn(sessions: DataFrame, conv_id: str, role: str, content: str) -> DataFrame:
    """Sessions with one more turn; the first user turn gives a new chat its title."""
    from lorewell.functions.text import title

    kind = sessions.schema["turns"].dataType.simpleString()
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    turn = F.array(F.struct(F.lit(role).alias("role"), F.lit(content).alias("content"), now.alias("timestamp"), F.lit(None).alias("tool_calls"), F.lit(None).alias("tool_results"))).cast(kind)
    mine = F.col("id") == conv_id
    named = mine & (F.col("title") == "New Chat") & F.lit(role == "user")
    return sessions.withColumns({"turns": F.when(mine, F.concat("turns", turn)).otherwise(F.col("turns")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at")), "title": F.when(named, title(F.lit(content))).otherwise(F.col("title"))})


def delete_session(sessions: DataFrame, conv_id: str) -> DataFrame:
    return sessions.filter(F.col("id") != conv_id)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def mutation_log(changes: DataFrame) -> DataFrame:
    """A line for each change (ts, action, target, tags)."""
    tags = F.when(F.coalesce("tags", F.lit("")) != "", F.concat(F.lit(" | tags: "), "tags")).otherwise("")
    return changes.select(F.concat(F.lit("## ["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "action", F.lit(" | "), "target", tags).alias("value"))
