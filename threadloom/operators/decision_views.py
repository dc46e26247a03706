"""Views of decision events by topic: the current decision, conflicts, the timeline, and what superseded what.

The events of a topic are never collected: views are aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.decisions import NOW, has, state_setting


def _setting():
    return state_setting(F.col("source"), F.col("confidence"), F.col("status"), F.col("kind"))


def views(events: DataFrame) -> DataFrame:
    """Per topic: its name, number of events, the current event with status and confidence, and the last activity.

    Current is the last event that may set the state; what users said goes before what agents inferred.
    """
    order = F.struct(F.col("source") == "user_explicit", "timestamp", "event_id", "status", "confidence")
    out = events.groupBy("canonical_id").agg(
        F.min(F.struct("timestamp", "event_id", "topic")).alias("first"), F.count("*").alias("events"), F.max(F.when(_setting(), order)).alias("current"), F.max("timestamp").alias("updated_at")
    )
    return out.select("canonical_id", "first.topic", "events", F.col("current.event_id").alias("current_event_id"), F.coalesce("current.status", F.lit("unknown")).alias("current_status"), F.coalesce("current.confidence", F.lit(0.0)).alias("confidence"), "updated_at")


def conflicts(events: DataFrame) -> DataFrame:
    """Topics with more than one different current statement among the events that may be current."""
    explicit = events.where(_setting()).withColumn("explicit", F.col("source") == "user_explicit")
    current = explicit.where(F.col("status").isin("current", "accepted"))
    by_source = current.groupBy("canonical_id", "explicit").agg(F.count("*").alias("conflicting"), F.countDistinct(F.lower(F.trim("statement"))).alias("statements"))
    any_explicit = explicit.groupBy("canonical_id").agg(F.bool_or("explicit").alias("any_explicit"))
    mine = by_source.join(any_explicit, "canonical_id").where("explicit OR NOT any_explicit")
    return mine.where("statements > 1").select("canonical_id", "conflicting", "statements")


def timeline(events: DataFrame) -> DataFrame:
    """All events with whether each is its topic's current one; order by (canonical_id, timestamp, event_id)."""
    current = views(events).select("canonical_id", "current_event_id")
    return events.join(current, "canonical_id").select("canonical_id", "event_id", "timestamp", "kind", "status", F.col("event_id").eqNullSafe(F.col("current_event_id")).alias("current"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams through events sorted by topic and time; holds the standing state-setting events of one topic."""
    topic, explicit, inferred = None, [], []
    for batch in batches:
        by, gone = [], []
        for t, event, setting, user, now in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if t != topic:
                topic, explicit, inferred = t, [], []
            standing = explicit or inferred
            if now and standing:
                by.append(event)
                gone.append(standing.pop())
            if setting:
                (explicit if user else inferred).append(event)
        yield pa.RecordBatch.from_pydict({"superseded_by": pa.array(by, pa.string()), "event_id": pa.array(gone, pa.string())})


def superseded(events: DataFrame) -> DataFrame:
    """(event_id, superseded_by): a statement of what holds now supersedes the event that was current just before it."""
    rows = events.select("canonical_id", "event_id", _setting().alias("setting"), (F.col("source") == "user_explicit").alias("user"), has(F.col("statement"), NOW).alias("now"), "timestamp")
    ordered = rows.repartition("canonical_id").sortWithinPartitions("canonical_id", "timestamp", "event_id")
    return ordered.mapInArrow(_fold, "superseded_by string, event_id string").select("event_id", "superseded_by")
