"""Processing captured events: order and budget of a run, memories, decisions, and when a run is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import decisions
from threadloom.functions.instants import instant
from threadloom.functions.text import keywords, normalize_text, sha256_id, utf16_slice

#: Limits of a processing run.
POLICY = {"threshold_bytes": 51_200, "max_wait_minutes": 30, "max_runs_per_hour": 4, "max_items": 100, "max_tokens": 16_000, "min_characters": 20}
PROCESSOR = "deterministic-processor"


def estimated_tokens(text: Column) -> Column:
    """A quarter of the length in UTF-16 units, rounded up, one at least."""
    units = F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))
    return F.greatest(F.lit(1), F.ceil(units / 4)).cast("bigint")


def first_in_queue(queue: DataFrame, most: int = POLICY["max_items"]) -> DataFrame:
    """Of each project the up to ``most`` items that come first: explicit ones, then by time and event.

    A project's order is a top-k: the bounded rank filter keeps ``most`` rows a project in each task before the shuffle.
    """
    order = Window.partitionBy("project_id").orderBy((F.col("priority") != "explicit"), "created_at", "event_key")
    due = queue.where(F.col("status").isin("pending", "failed"))
    return due.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def within_budget(queue: DataFrame, events: DataFrame, most: int = POLICY["max_items"], tokens: int = POLICY["max_tokens"]) -> DataFrame:
    """The items of each project's next run: as many as the token budget holds; the first runs whatever its size.

    Items without an event fail before they are counted; after a failure the first pass is gone.
    """
    first = first_in_queue(queue, most)
    joined = first.join(events.select("event_key", estimated_tokens(F.col("content")).alias("tokens")), "event_key", "left")
    before = Window.partitionBy("project_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = joined.withColumn("spent", F.sum(F.coalesce("tokens", F.lit(0))).over(before))
    fits = F.col("tokens").isNull() | (F.col("spent") <= tokens) | (F.col("position") == 1)
    return running.where(fits).select("project_id", "event_key", "position", "tokens", "spent", F.when(F.col("tokens").isNull(), "failed").otherwise("processing").alias("outcome"))


def _clean(events: DataFrame) -> Column:
    """The normalised text of each event: as stored with it, where it is."""
    return F.col("clean") if "clean" in events.columns else normalize_text(F.col("content"))


def memories(events: DataFrame) -> DataFrame:
    """The memory of each event that deserves one: not secret, and not a short answer that decides nothing."""
    clean = _clean(events)
    rows = events.where(F.col("sensitivity") != "secret").withColumn("clean", clean).withColumn("kind", decisions.kind(F.col("clean")))
    explicit = (F.col("role") == "user") & decisions.explicit_request(F.col("content"))
    durable = F.col("kind").isNotNull() | decisions.has(F.col("clean"), "记住|remember")
    worth = ~((F.col("role") == "assistant") & ~explicit & (F.length("clean") < POLICY["min_characters"]) & ~durable)
    return rows.where(worth).select(
        sha256_id("mem_", 24, "event_key").alias("memory_id"), "project_id", F.coalesce("kind", F.lit("conversation")).alias("type"),
        utf16_slice(F.col("clean"), 80).alias("title"), utf16_slice(F.col("clean"), 1000).alias("summary"), keywords(F.col("clean")).alias("tags"),
        F.col("event_key").alias("source_event"), F.when(explicit, 1.0).otherwise(0.65).alias("confidence"),
        F.when(explicit, "user_explicit").otherwise("agent_inferred").alias("source"), "sensitivity", F.col("timestamp").alias("created_at"),
    )


def decision_events(events: DataFrame) -> DataFrame:
    """The decision event of each event that decides something."""
    clean = _clean(events)
    rows = events.where(F.col("sensitivity") != "secret").withColumn("statement", clean).withColumn("kind", decisions.kind(F.col("statement"))).where("kind IS NOT NULL")
    current = decisions.has(F.col("statement"), decisions.CURRENT)
    status = F.when(F.col("kind") == "rejection", "rejected").when(F.col("kind").isin("decision", "current_state", "correction") & current, "current").otherwise("proposed")
    user = F.col("role") == "user"
    confidence = F.when(user, F.when(decisions.explicit_request(F.col("content")), 1.0).otherwise(0.95)).otherwise(0.7)
    topic = decisions.topic(F.col("statement"))
    return rows.select(
        sha256_id("de_", 24, "event_key").alias("event_id"), sha256_id("d_", 20, F.coalesce("project_id", F.lit("")), F.lower(F.trim(topic))).alias("canonical_id"),
        "project_id", topic.alias("topic"), decisions.aliases(F.col("statement")).alias("aliases"), "kind", status.alias("status"), "statement",
        F.when(user, "user_explicit").otherwise("agent_inferred").alias("source"), confidence.alias("confidence"), F.array("event_key").alias("evidence_refs"), "timestamp",
    )


def run_due(queue: DataFrame, sizes: DataFrame, now: str, runs: DataFrame | None = None, trigger: str = "automatic") -> DataFrame:
    """Whether each project's queue should be processed, and why: the first rule that applies.

    ``sizes`` (event_key, bytes); ``runs`` (project_id, at): runs so far. ``trigger`` is automatic, manual or startup.
    """
    pending = queue.where(F.col("status").isin("pending", "failed")).join(sizes, "event_key", "left")
    stats = pending.groupBy("project_id").agg(F.count("*").alias("pending_items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("pending_bytes"), F.min(instant(F.col("created_at"))).alias("oldest"), F.bool_or(F.col("priority") == "explicit").alias("explicit"))
    at = F.to_timestamp(F.lit(now))
    if runs is None:
        stats = stats.withColumn("recent", F.lit(0))
    else:
        recent = runs.where(F.col("at") >= at - F.expr("INTERVAL 1 HOUR")).groupBy("project_id").agg(F.count("*").alias("recent"))
        stats = stats.join(recent, "project_id", "left").fillna(0, ["recent"])
    waited = F.col("oldest") <= at - F.make_dt_interval(mins=F.lit(POLICY["max_wait_minutes"]))
    reason = F.when(F.lit(trigger == "manual"), "manual").when(F.col("recent") >= POLICY["max_runs_per_hour"], "rate_limited").when(F.lit(trigger == "startup"), "startup")
    reason = reason.when(F.col("explicit"), "explicit").when(F.col("pending_bytes") >= POLICY["threshold_bytes"], "size_threshold").when(waited, "max_wait").otherwise("below_threshold")
    return stats.select("project_id", "pending_items", "pending_bytes", reason.alias("reason"), (~reason.isin("rate_limited", "below_threshold")).alias("should_run"))
