"""Effective search documents: memories with their control state, evidence and canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import sensitivity
from threadloom.functions.text import fold, normalize_text
from threadloom.operators import evidence

#: The status that a control event gives, and the longest canonical text.
CONTROL = {"forget": "revoked", "correct": "superseded", "delete": "deleted"}
MAX_TEXT = 12_000


def effective_states(feed: DataFrame) -> DataFrame:
    """Per target the status by the last event in the order of timestamp texts and event ids, and how many there are."""
    known = feed.where(F.col("kind").isin(*CONTROL) & F.col("target_memory_id").isNotNull() & F.col("event_id").isNotNull())
    once = known.groupBy("target_memory_id", fold(F.col("event_id")).alias("event_id")).agg(F.max(F.struct("timestamp", "kind")).alias("e"))
    last = once.groupBy("target_memory_id").agg(F.max(F.struct("e.timestamp", "event_id", "e.kind")).alias("last"), F.count("*").alias("events"))
    status = F.create_map(*[F.lit(x) for p in CONTROL.items() for x in p])[F.col("last.kind")]
    return last.select("target_memory_id", status.alias("status"), F.col("last.event_id").alias("last_event_id"), "events")


def _sorted(values: str) -> Column:
    """Distinct normalised values in byte order, without blanks."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: normalize_text(v))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda v: F.coalesce(v != "", F.lit(False)))))


def canonical_text() -> Column:
    """Labelled lines of title, summary, tags and phrases. The labels are words of the text like any other."""
    one = lambda c: F.array(F.coalesce(normalize_text(F.col(c)), F.lit("")))
    fields = {"title": one("title"), "summary": one("summary"), "tags": _sorted("tags"), "predictive_tags": _sorted("predictive_tags"), "retrieval_phrases": _sorted("retrieval_phrases")}

    def labelled(label: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(f"deterministic.{label}: "), v))

    lines = F.concat(*(labelled(label, values) for label, values in fields.items()))
    return F.substring(F.concat_ws("\n", lines), 1, MAX_TEXT)


def effective(processed: DataFrame, deliveries: DataFrame, feed: DataFrame) -> DataFrame:
    """One row a memory: canonical text, effective status, integrity, level, and what it is eligible for."""
    rows = evidence.memories(processed)
    described = evidence.descriptors(evidence.memory_refs(rows), evidence.sources(deliveries))
    assessed = evidence.assess(rows, described)
    states = effective_states(feed).select(F.col("target_memory_id").alias("id"), F.col("status").alias("control"))
    joined = rows.join(assessed.withColumnRenamed("owner", "id"), "id", "left").join(states, "id", "left")
    status = F.coalesce("control", "status")
    level = sensitivity.strongest(F.col("sensitivity"), F.col("evidence_level"))
    base = (status == "active") & F.col("integrity").isin("verified", "partial")
    return joined.select(
        F.col("id").alias("memory_id"), "project_id", canonical_text().alias("text"), status.alias("effective_status"), "integrity", level.alias("level"),
        (base & (level == "normal")).alias("lexical"), (base & (level != "secret")).alias("lexical_sensitive"), (base & (F.col("integrity") == "verified") & (level == "normal")).alias("index"),
        "created_at", "confidence", "source", F.col("summary").alias("display"), _sorted("tags").alias("search_tags"), "savepoint", "source_events", "source_hash", "type",
    )
