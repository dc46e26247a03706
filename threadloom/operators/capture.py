"""Capturing messages: one immutable record an event, with its own hash, sensitivity, identity and sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import sensitivity
from threadloom.functions.decisions import explicit_request
from threadloom.functions.instants import instant, micros
from threadloom.functions.text import fold, sha256_id
from threadloom.operators.delivery import kept_copies
from threadloom.operators.numbering import numbered

ROLES = ("user", "assistant", "system")


def captured(deliveries: DataFrame) -> DataFrame:
    """The kept copies with a known role: secrets redacted, the level and hash of what is stored, and a stable id."""
    columns = ("project_id", "session_id", "turn_id", "seq_id", "role", "timestamp", "content", "content_hash", "savepoint_status", "raw_ref", "schema_version")
    kept = kept_copies(deliveries, *map(F.col, columns)).withColumn("role", fold(F.col("role")))
    level = sensitivity.level(F.col("content"))
    stored = F.when(level == "secret", sensitivity.redact(F.col("content"))).otherwise(F.col("content"))
    known = kept.where(F.col("role").isin(*ROLES) & F.col("content").isNotNull())
    return known.withColumn("sensitivity", level).withColumn("content", stored).withColumn("computed_hash", F.sha2(stored.cast("binary"), 256)).withColumn("capture_id", sha256_id("evt_", 24, F.coalesce("project_id", F.lit("")), "event_key"))


def sequenced(events: DataFrame) -> DataFrame:
    """Per project the events numbered by instant (unreadable ones first), then id; hot projects spread over tasks."""
    at = F.coalesce(micros(instant(F.col("timestamp"))), F.lit(-(1 << 62)))
    return numbered(events.select("event_key", "project_id", at.alias("at")), "project_id", ["at", "event_key"], "sequence")


def queued(events: DataFrame) -> DataFrame:
    """The processing queue of captured events: explicit requests of users come first."""
    priority = F.when((F.col("role") == "user") & explicit_request(F.col("content")), "explicit").otherwise("normal")
    return events.select(sha256_id("task_", 24, "event_key").alias("task_id"), "event_key", "project_id", priority.alias("priority"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.col("timestamp").alias("created_at"))
