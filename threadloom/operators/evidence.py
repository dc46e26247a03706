"""Whether the evidence behind memories and decisions holds: descriptors of each source and an assessment of each set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.sensitivity import LEVELS
from threadloom.functions.text import fold
from threadloom.operators.delivery import kept_copies


def memories(processed: DataFrame) -> DataFrame:
    """One row a memory id: of repeated rows the one updated last."""
    fields = [c for c in processed.columns if c not in ("id", "updated_at", "title", "summary", "tags")]
    last = F.max(F.struct("updated_at", "title", "summary", "tags", *fields)).alias("m")
    return processed.where("id IS NOT NULL").groupBy("id").agg(last).select("id", "m.*")


def sources(deliveries: DataFrame) -> DataFrame:
    """What is known of each event: project, hash as declared and as computed, savepoint, sensitivity, path. The content
    is hashed where it is read; it is not shuffled."""
    path = F.concat(F.lit("raw/"), F.col("project_id"), F.lit("/"), F.col("session_id"), F.lit("/"), F.col("event_id"), F.lit(".json"))
    computed = F.sha2(F.col("content").cast("binary"), 256)
    return kept_copies(
        deliveries, F.col("project_id").alias("found_project"), F.lower("content_hash").alias("declared_hash"), computed.alias("computed_hash"), F.col("savepoint_status").alias("savepoint"),
        F.col("sensitivity").alias("level"), F.coalesce(F.lower("raw_ref") == F.lower(path), F.lit(False)).alias("path_verified"),
    )


def descriptors(refs: DataFrame, found: DataFrame) -> DataFrame:
    """``refs`` (owner, project_id, source) with the status of each source; one row a distinct source of an owner."""
    keyed = refs.select("owner", "project_id", fold(F.col("source")).alias("event_key")).where("event_key IS NOT NULL").distinct()
    joined = keyed.join(found, "event_key", "left")
    status = F.when(F.col("delivery_id").isNull(), "missing").when(~F.col("found_project").eqNullSafe(F.col("project_id")), "wrong_project").when(~F.col("path_verified"), "invalid_path")
    status = status.when(F.col("declared_hash").eqNullSafe(F.col("computed_hash")), "verified").otherwise("tampered")
    return joined.select("owner", "project_id", "event_key", status.alias("status"), "computed_hash", "savepoint", "level")


def memory_refs(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("owner"), "project_id", F.explode("source_events").alias("source"))


def assess(rows: DataFrame, described: DataFrame) -> DataFrame:
    """Per memory (owner): integrity, the strongest sensitivity and savepoint of its sources, and how many there are.

    Of several faults the gravest names the integrity; a single source must have the hash that the memory recorded.
    """
    has = lambda s: F.bool_or(F.col("status") == s).alias(s)
    level = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), F.lit(1))
    sums = described.groupBy("owner").agg(
        F.count("*").alias("distinct"), *(has(s) for s in ("wrong_project", "invalid_path", "tampered", "missing")), F.max(level).alias("rank"),
        F.bool_or(F.col("savepoint") == "pending").alias("pending"), F.bool_or(F.col("savepoint") == "partial").alias("partial"), F.max("computed_hash").alias("only_hash"),
    )
    joined = rows.select(F.col("id").alias("owner"), F.coalesce(F.size("source_events"), F.lit(0)).alias("listed"), "source_hash", "type").join(sums, "owner", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    hash_fault = (F.col("distinct") == 1) & (F.col("type") != "correction") & F.col("source_hash").isNotNull() & ~F.lower("source_hash").eqNullSafe(F.col("only_hash"))
    repeated = F.greatest("listed", F.lit(0)) != F.coalesce("distinct", F.lit(0))
    savepoint = F.when(flag("pending"), "pending").when(flag("partial"), "partial").otherwise("complete")
    integrity = F.when(flag("wrong_project"), "wrong_project").when(flag("invalid_path"), "invalid_path").when(flag("tampered"), "tampered")
    integrity = integrity.when(F.coalesce(hash_fault, F.lit(False)) | (repeated & (F.col("listed") > 0)), "mismatch").when(flag("missing") | (F.col("listed") <= 0), "missing")
    return joined.select(
        "owner", integrity.otherwise(F.when(savepoint == "complete", "verified").otherwise("partial")).alias("integrity"),
        F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce("rank", F.lit(1)).cast("int")).alias("evidence_level"), savepoint.alias("savepoint"), F.coalesce("distinct", F.lit(0)).alias("sources"),
    )
