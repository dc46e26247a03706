"""Reading and writing record folders: one JSON document a file, validated; append-only and generation sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the record kinds with their JSON types; ``?`` marks those that may be absent.
KINDS = {
    "raw": {"schema_version": "BIGINT", "event_id": "STRING", "session_id": "STRING", "project_id": "STRING", "seq_id": "BIGINT", "turn_id": "STRING", "role": "STRING", "timestamp": "STRING", "source_agent": "STRING", "source_model?": "STRING", "content": "STRING", "content_hash": "STRING", "savepoint_status": "STRING", "capture_status": "STRING", "sensitivity": "STRING", "raw_ref": "STRING"},
    "queue": {"schema_version": "BIGINT", "task_id": "STRING", "event_id": "STRING", "project_id": "STRING", "priority": "STRING", "status": "STRING", "attempts": "BIGINT", "created_at": "STRING", "updated_at": "STRING", "error?": "STRING"},
    "control": {"schema_version": "BIGINT", "event_id": "STRING", "kind": "STRING", "project_id": "STRING", "target_memory_id": "STRING", "replacement_memory_id?": "STRING", "reason?": "STRING", "evidence_refs": "ARRAY<STRING>", "timestamp": "STRING"},
}
#: What some fields may say.
ENUMS = {
    "raw": {"role": ("user", "assistant", "system"), "savepoint_status": ("pending", "complete", "partial"), "capture_status": ("captured",), "sensitivity": ("normal", "sensitive", "secret")},
    "queue": {"priority": ("normal", "explicit"), "status": ("pending", "processing", "failed", "done")},
    "control": {"kind": ("forget", "correct", "delete")},
}
SAFE_ID = "^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}$"


def scan(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(path, body) of every ``.json`` file below ``folder``; with ``most`` only the first by path (a limit on scans that
    the archive's settings define)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return rows.orderBy("path").limit(most) if most else rows


def decode(files: DataFrame, kind: str) -> DataFrame:
    """Typed columns of a record kind, the path, and ``fault``: why a record is invalid, or null.

    A JSON value of another type is a fault and is never converted; unknown further fields are tolerated.
    """
    doc = F.try_parse_json("body")
    columns, faults = [], []
    for field, kind_of in KINDS[kind].items():
        name, optional = field.rstrip("?"), field.endswith("?")
        value = F.try_variant_get(F.col("doc"), f"$.{name}", "variant")
        given = F.schema_of_variant(value)
        right = given == kind_of if not kind_of.startswith("ARRAY") else given.isin(kind_of, "ARRAY<VOID>")
        absent = value.isNull()
        faults.append(F.when((absent & F.lit(not optional)) | (~absent & ~right), F.lit(name)))
        columns.append(F.when(right, F.try_variant_get(F.col("doc"), f"$.{name}", kind_of.lower())).alias(name))
    rows = files.withColumn("doc", doc)
    for name, values in ENUMS.get(kind, {}).items():
        faults.append(F.when(~F.coalesce(F.try_variant_get(F.col("doc"), f"$.{name}", "string").isin(*values), F.lit(False)), F.lit(name)))
    fault = F.when(F.col("doc").isNull(), F.lit("not JSON")).otherwise(F.get(F.array_compact(F.array(*faults)), F.lit(0)))
    return rows.select("path", *columns, fault.alias("fault"))


def canonical(kind: str) -> Column:
    """The path below the archive at which a record of this kind belongs."""
    part = {"raw": ("raw", "project_id", "session_id", "event_id"), "queue": ("queue", "project_id", "task_id"), "control": ("registry/memory-events", "project_id", "event_id")}[kind]
    return F.concat(F.concat_ws("/", F.lit(part[0]), *map(F.col, part[1:])), F.lit(".json"))


def split(decoded: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid records. A record elsewhere than at its own path, or with an unsafe id, is invalid."""
    misplaced = ~F.endswith(F.col("path"), F.concat(F.lit("/"), canonical(kind)))
    unsafe = ~F.coalesce(F.col("project_id").rlike(SAFE_ID), F.lit(False))
    checked = decoded.withColumn("fault", F.coalesce("fault", F.when(unsafe, "unsafe id"), F.when(F.coalesce(misplaced, F.lit(True)), "misplaced")))
    return checked.where("fault IS NULL").drop("fault"), checked.where("fault IS NOT NULL").select("path", "fault")


def append(df: DataFrame, folder: str, by: str = "project_id") -> None:
    """Append-only event log, partitioned for pruning."""
    df.write.mode("append").partitionBy(by).parquet(folder)


def publish(df: DataFrame, folder: str) -> str:
    """Writes a new generation and then points to it; readers of the one before are not disturbed."""
    spark, new = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{folder}/generation={new}")
    known = pointers(spark, folder)
    spark.createDataFrame([(len(known), new)], "number bigint, generation string").coalesce(1).write.mode("append").json(f"{folder}/active")
    return new


def pointers(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/active")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    return [r.generation for r in spark.read.schema("number bigint, generation string").json(f"{folder}/active").orderBy("number").collect()]


def active(spark: SparkSession, folder: str) -> DataFrame:
    """The generation that was published last."""
    return spark.read.parquet(f"{folder}/generation={pointers(spark, folder)[-1]}")


def markdown(memories: DataFrame) -> DataFrame:
    """(id, text): front matter of all fields as JSON, then title and summary."""
    fields = [c for c in memories.columns if c not in ("title", "summary")]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), '^\\{"v":|\\}$', ""))) for c in fields]
    return memories.select("id", F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), F.concat(F.lit("# "), "title"), F.lit(""), "summary").alias("text"))
