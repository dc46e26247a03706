"""Queries of the general problems: the change feed (5) and repeated deliveries (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators import change_feed
from threadloom.session import table
from threadloom.streaming.seen_store import SeenStore, repeated_deliveries

_COUNTING = """
SELECT target_memory_id, kind, lower(trim(event_id)) AS event_id, replacement_memory_id, try_cast(timestamp AS TIMESTAMPTZ) AS instant
FROM memory_control_events
WHERE try_cast(timestamp AS TIMESTAMPTZ) IS NOT NULL AND target_memory_id IN (SELECT id FROM processed_memories)
  AND (kind = 'forget' OR (len(evidence_refs) > 0 AND (kind = 'delete' OR (kind = 'correct' AND trim(coalesce(replacement_memory_id, '')) <> ''))))
"""
_LAST = f"""
SELECT target_memory_id, arg_max(kind, (instant, event_id)) AS kind, max((instant, event_id))[2] AS last_event_id,
       arg_max(coalesce(replacement_memory_id, ''), (instant, event_id)) AS replacement
FROM ({_COUNTING}) GROUP BY target_memory_id
"""
_STATUS = "CASE kind WHEN 'forget' THEN 'revoked' WHEN 'correct' THEN 'superseded' WHEN 'delete' THEN 'deleted' ELSE 'active' END"


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed.final_states(table(spark, sf_dir, "memory_control_events"), table(spark, sf_dir, "processed_memories"))


def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed.current_memories(table(spark, sf_dir, "memory_control_events"), table(spark, sf_dir, "processed_memories"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(spark, f"{sf_dir}/raw_events.parquet")


def stream_capture_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept copy of each event that has an id, as a stream of deliveries leaves it."""
    path = f"{sf_dir}/raw_events.parquet"
    deliveries = spark.read.parquet(path).select("event_id", "delivery_id", "received_at", "content", "content_hash")
    store = SeenStore(spark)
    store.run(path, deliveries.schema)
    return store.kept().where("NOT startswith(event_key, '\\0')")


QUERIES = {"p5_found": p5_found, "p5_current": p5_current, "p6_found": p6_found, "stream_capture_dedupe": stream_capture_dedupe}

ORACLES = {
    "p5_found": f"SELECT target_memory_id, {_STATUS} AS final_status, last_event_id FROM ({_LAST})",
    "p5_current": f"""
SELECT m.id AS memory_id, {_STATUS} AS current_status,
       CASE WHEN kind = 'correct' THEN replacement END AS replacement_memory_id, last_event_id
FROM (SELECT DISTINCT id FROM processed_memories WHERE id IS NOT NULL) m LEFT JOIN ({_LAST}) l ON l.target_memory_id = m.id""",
    "stream_capture_dedupe": """
SELECT event_key, delivery_id FROM (
  SELECT lower(trim(event_id)) AS event_key, delivery_id,
         row_number() OVER (PARTITION BY lower(trim(event_id))
           ORDER BY CASE WHEN lower(content_hash) = sha256(content) THEN 0 ELSE 1 END, received_at, delivery_id) AS n
  FROM raw_events WHERE event_id IS NOT NULL)
WHERE n = 1""",
    "p6_found": """
SELECT event_id, delivery_id FROM (
  SELECT lower(trim(event_id)) AS event_id, delivery_id,
         row_number() OVER (PARTITION BY lower(trim(event_id))
           ORDER BY CASE WHEN lower(content_hash) = sha256(content) THEN 0 ELSE 1 END, received_at, delivery_id) AS n
  FROM raw_events WHERE event_id IS NOT NULL)
WHERE n > 1""",
}
