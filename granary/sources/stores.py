"""Stored objects, manifests and record streams, as sources and sinks."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import integrity

MANIFEST = (
    "id string, job_id string, target_id string, storage_id string, type string, parent_id string, started_at timestamp_ntz, finished_at timestamp_ntz, version int, "
    "objects array<struct<schema:string,name:string,chunks:array<struct<key:string,hash:string,size:bigint,stored_size:bigint,algo:string>>>>, key_id string, signature struct<algorithm:string,value:string>"
)
RECORD = "Object struct<Schema:string,Name:string,Kind:string>, Payload string, Rows bigint, Done boolean"
MAX_MANIFEST_BYTES = 64 << 20


def objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(object_key, size, modified) below a folder, without reading contents. What is still being written (.tmp, .lock, hidden) is no object; Spark's file sources pass over objects without bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    base = F.regexp_extract("path", rf"{_tail(root)}/(.*)$", 1)
    out = df.select(base.alias("object_key"), "size", "modified").where(~F.col("object_key").rlike(r"\.(tmp|lock)$")).orderBy("object_key")
    return out.where(F.col("object_key").startswith(prefix)) if prefix else out


def _tail(root: str) -> str:
    import re

    return re.escape(root.rstrip("/").split("://")[-1].removeprefix("file:"))


def object_bytes(spark: SparkSession, root: str, key: str, offset: int = 0, length: int | None = None) -> DataFrame:
    """One object, or a range of it."""
    df = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{key}")
    cut = F.expr(f"substring(content, {offset + 1}, {length if length is not None else 'length'})")
    return df.select(F.lit(key).alias("object_key"), cut.alias("content"))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Committed manifests, one a row, and `problem` for those that are too long (their content is not read), unreadable or of another version; nothing is dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.manifest").load(root)
    content = lambda c: F.from_json(c, MANIFEST).alias("m")
    short = files.where(F.col("length") <= MAX_MANIFEST_BYTES).select("path", content(F.col("content").cast("string")), F.lit(None).cast("string").alias("problem"))
    long = files.where(F.col("length") > MAX_MANIFEST_BYTES).select("path", content(F.lit(None).cast("string")), F.lit("too long").alias("problem"))
    problem = F.coalesce("problem", F.when(F.col("m.id").isNull(), "unreadable").when(F.col("m.version") != 1, "version"))
    return short.union(long).select("path", "m.*", problem.alias("problem"))


def manifest_body() -> F.Column:
    """The canonical form that is signed: all fields of a manifest but its signature, in their order, without blanks; null fields are left out."""
    names = [f.name for f in T._parse_datatype_string(MANIFEST).fields if f.name != "signature"]
    return F.to_json(F.struct(*names))


def load_manifests(spark: SparkSession, root: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests that may be trusted, (path, problem) of all others): readable, of the right version, and signed by a key of `keys` (key_id, public_key)."""
    read = read_manifests(spark, root)
    judged = integrity.signature_problems(read.withColumnRenamed("problem", "__read"), keys, manifest_body())
    judged = judged.withColumn("problem", F.coalesce("__read", "problem")).drop("__read")
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null").select("path", "problem")


def _path(spark: SparkSession, root: str, key: str):
    """(file system, path) of an object."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{key}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def head(spark: SparkSession, root: str, key: str) -> tuple[int, datetime] | None:
    """(size, time of the last change) of one object, asked for by its own path; None if it isn't there or is a folder."""
    system, path = _path(spark, root, key)
    if not system.exists(path):
        return None
    found = system.getFileStatus(path)
    return (found.getLen(), datetime.fromtimestamp(found.getModificationTime() / 1000, UTC)) if found.isFile() else None


def exists(spark: SparkSession, root: str, key: str) -> bool:
    return head(spark, root, key) is not None


def manifest_refs(manifests: DataFrame) -> DataFrame:
    """(manifest_id, object_no, sequence, key, hash, size): a reference's place in the array is its sequence."""
    df = manifests.select(F.col("id").alias("manifest_id"), F.posexplode("objects").alias("object_no", "o"))
    return df.select("manifest_id", "object_no", F.col("o.name").alias("object"), F.posexplode("o.chunks").alias("sequence", "c")).select("manifest_id", "object_no", "object", "sequence", "c.*")


def manifest_path() -> F.Column:
    return F.concat(F.lit("manifests/"), F.date_format("finished_at", "yyyy/MM/dd"), F.lit("/"), F.col("id"), F.lit(".manifest"))


def put_if_absent(df: DataFrame, existing: DataFrame, key: str = "object_key") -> tuple[DataFrame, DataFrame]:
    """(rows to write, keys refused): only objects whose key is not there; of repeated keys within df one is written."""
    return df.dropDuplicates([key]).join(existing.select(key), key, "left_anti"), df.join(existing.select(key), key, "left_semi").select(key).distinct()


def write_new_objects(df: DataFrame, existing: DataFrame, path: str, key: str = "object_key") -> DataFrame:
    """Append only objects whose key is not there; returns the refused keys."""
    fresh, refused = put_if_absent(df, existing, key)
    fresh.write.mode("append").parquet(path)
    return refused


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def without(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti").select(old.columns)


def records_to_json(df: DataFrame) -> DataFrame:
    """(schema, name, kind, payload, rows, done) to lines; the payload in base64."""
    record = F.struct(F.struct(F.col("schema").alias("Schema"), F.col("name").alias("Name"), F.col("kind").alias("Kind")).alias("Object"), F.base64("payload").alias("Payload"), F.col("rows").alias("Rows"), F.col("done").alias("Done"))
    return df.select(F.to_json(record).alias("value"))


def records_from_json(lines: DataFrame) -> DataFrame:
    r = lines.select(F.from_json("value", RECORD).alias("r"))
    return r.select(F.col("r.Object.Schema").alias("schema"), F.col("r.Object.Name").alias("name"), F.col("r.Object.Kind").alias("kind"), F.unbase64("r.Payload").alias("payload"), F.col("r.Rows").alias("rows"), F.col("r.Done").alias("done"))


def restorable(records: DataFrame, kinds: tuple[str, ...] = ("database", "globals"), dry_run: bool = False, replace: bool = False) -> DataFrame:
    """Records that a restore applies: no end marks, only known kinds; nothing on a dry run; refused without leave to replace."""
    wanted = records.where(~F.coalesce("done", F.lit(False)) & F.col("kind").isin(*kinds))
    if dry_run:
        return wanted.limit(0)
    if not replace:
        raise ValueError("a restore into a database needs replace=True")
    return wanted
