"""What users do to memories: look at them, correct them, delete them; and what enrichment adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import fold, keywords, normalize_tag, normalize_text, sha256_id, strip, utf16_slice
from threadloom.operators.documents import effective_states


def inspect(memories: DataFrame, feed: DataFrame) -> DataFrame:
    """(memory_id, effective_status, control_events): the events that name a memory, in order of time text and id."""
    states = effective_states(feed).select(F.col("target_memory_id").alias("id"), F.col("status").alias("control"))
    known = feed.where(F.col("kind").isin("forget", "correct", "delete") & F.col("target_memory_id").isNotNull() & F.col("event_id").isNotNull())
    once = known.groupBy(F.col("target_memory_id").alias("id"), fold(F.col("event_id")).alias("event_id")).agg(F.max("timestamp").alias("timestamp"))
    named = once.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "event_id"))).alias("e"))  # a memory's controls are few
    rows = memories.select("id", "status").join(states, "id", "left").join(named, "id", "left")
    return rows.select(F.col("id").alias("memory_id"), F.coalesce("control", "status").alias("effective_status"), F.coalesce(F.col("e.event_id"), F.array().cast("array<string>")).alias("control_events"))


def corrected(memories: DataFrame, corrections: DataFrame) -> DataFrame:
    """The memories that corrections (event_id, target_memory_id, summary, evidence_refs, timestamp) put in the place of
    others. Without a text or evidence there is none."""
    usable = corrections.where((strip(F.col("summary")) != "") & (F.size("evidence_refs") > 0))
    text = strip(F.col("summary"))
    rows = usable.join(memories.select(F.col("id").alias("target_memory_id"), "project_id"), "target_memory_id")
    tags = keywords(text, stops=())
    return rows.select(
        sha256_id("mem_", 32, "event_id").alias("memory_id"), "project_id", F.lit("correction").alias("type"), utf16_slice(text, 80).alias("title"), text.alias("summary"), tags.alias("tags"),
        F.transform(tags, lambda t: F.concat(F.lit("关于 "), t, F.lit(" 的纠正"))).alias("retrieval_phrases"), F.array_distinct("evidence_refs").alias("source_events"), F.array("target_memory_id").alias("supersedes"), F.col("timestamp").alias("created_at"),
    )


def deletions(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The control events that deleting ``ids`` (memory_id) appends: evidence are a memory's sources, or itself."""
    gone = memories.join(ids.select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi")
    evidence = F.when(F.size("source_events") > 0, F.col("source_events")).otherwise(F.array("id"))
    return gone.select(F.lit("delete").alias("kind"), "project_id", F.col("id").alias("target_memory_id"), evidence.alias("evidence_refs"))


def without(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """``memories`` without the deleted ones."""
    return memories.join(ids.select(F.col("memory_id").alias("id")).distinct(), "id", "left_anti")


def last_records(memories: DataFrame, events: DataFrame) -> DataFrame:
    """Per project the memory and the message that deleting the last one would delete."""
    memory = memories.groupBy("project_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("last_memory"))
    message = events.groupBy("project_id").agg(F.max_by("event_key", F.struct("seq_id", "timestamp", "event_key")).alias("last_event"))
    return memory.join(message, "project_id", "full_outer")


def enrichment_status(documents: DataFrame, feed: DataFrame, enriched: DataFrame) -> DataFrame:
    """Per project how many memories wait for enrichment and how many have it: active, normal, verified, with a source
    hash, and named by no control event."""
    named = feed.where("target_memory_id IS NOT NULL").select(F.col("target_memory_id").alias("memory_id")).distinct()
    open_ = documents.where("index AND source_hash IS NOT NULL").join(named, "memory_id", "left_anti")
    flagged = open_.join(enriched.select("memory_id", F.lit(True).alias("has")).distinct(), "memory_id", "left")
    return flagged.groupBy("project_id").agg(F.count_if(F.col("has").isNull()).alias("pending"), F.count_if(F.col("has")).alias("enriched"))


def additions(memories: DataFrame, overlay: str, baseline: str) -> DataFrame:
    """(memory_id, added): what an overlay's list says that the memory's own does not, as normalised."""
    clean = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: normalize_text(v))
    added = F.array_sort(F.filter(F.array_except(clean(F.col(overlay)), clean(F.col(baseline))), lambda v: v != ""))
    return memories.select(F.col("id").alias("memory_id"), added.alias("added")).where(F.size("added") > 0)


def tag_candidates(registry: DataFrame, documents: DataFrame, term: str, most: int = 128) -> DataFrame:
    """Per project the tags that may be suggested for ``term``: only those an eligible document bears, whatever the
    registry says; equal ones first, then the most used. ``evidence`` is the first such document."""
    from pyspark.sql.window import Window

    borne = documents.where("index").select("project_id", "memory_id", F.explode("search_tags").alias("t")).select("project_id", "memory_id", normalize_tag(F.col("t")).alias("tag"))
    first = borne.groupBy("project_id", "tag").agg(F.min("memory_id").alias("evidence"))
    exact = F.col("tag") == normalize_tag(F.lit(term))
    order = Window.partitionBy("project_id").orderBy(F.desc("exact"), F.desc("usage_count"), "tag")
    ranked = registry.select("project_id", "tag", "usage_count").join(first, ["project_id", "tag"]).withColumn("exact", exact).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most)
