"""Packaging hits for a reader: budgets, the decision behind them, how sure the answer is; ranking topics; staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.instants import instant
from threadloom.functions.text import normalize_topic


#: What a query says that asks for reasons or for the current state, and what a text says that gives reasons.
ASKS_WHY = "为什么|原因|理由|why|reason"
ASKS_NOW = "当前|现在|目前|current|currently|now"
GIVES_REASON = "因为|由于|(?<=[A-Za-z0-9_])因|because|reason|cost|complexity|constraint"


def _says(text: str, pattern: str) -> Column:
    return F.coalesce(F.col(text).rlike(f"(?i)(?:{pattern})"), F.lit(False))


def _if_any(hits: DataFrame, asked: Column, flag: Column) -> DataFrame:
    """Where a query asks for it, only the hits with ``flag``, if there are any. A query's hits of a project are few."""
    mine = Window.partitionBy("query_id", "project_id")
    marked = hits.withColumn("_flag", flag).withColumn("_any", F.bool_or("_flag").over(mine))
    return marked.where(~asked | F.col("_flag") | ~F.col("_any")).drop("_flag", "_any")


def with_reasons(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Of the hits (query_id, project_id, snippet) of queries that ask why, those that give a reason, if any do."""
    asked = hits.join(F.broadcast(queries.select("query_id", _says("query", ASKS_WHY).alias("_asked"))), "query_id")
    return _if_any(asked, F.col("_asked"), _says("snippet", GIVES_REASON)).drop("_asked")


def with_current_evidence(hits: DataFrame, best: DataFrame, current: DataFrame, queries: DataFrame) -> DataFrame:
    """Of the hits (query_id, project_id, memory_id, source_events) of queries that ask why or what holds now, those that
    cite the current evidence of the decision behind the answer, if any do.

    ``best`` (query_id, project_id, canonical_id), ``current`` (canonical_id, event_key).
    """
    evidence = best.join(current, "canonical_id").select("query_id", "project_id", "event_key")
    cited = hits.select("query_id", "project_id", "memory_id", F.explode("source_events").alias("s")).withColumn("event_key", F.lower(F.trim("s")))
    citing = cited.join(evidence, ["query_id", "project_id", "event_key"]).select("query_id", "project_id", "memory_id").distinct().withColumn("_cites", F.lit(True))
    asked = hits.join(F.broadcast(queries.select("query_id", _says("query", f"{ASKS_WHY}|{ASKS_NOW}").alias("_asked"))), "query_id")
    marked = asked.join(citing, ["query_id", "project_id", "memory_id"], "left")
    return _if_any(marked, F.col("_asked"), F.coalesce("_cites", F.lit(False))).drop("_asked", "_cites")


def candidates(answers: DataFrame, registry: DataFrame, months: DataFrame, most: int = 8) -> DataFrame:
    """What may be asked instead where nothing was found: (query_id, project_id, kind, value, rank) of the project's most
    used tags and latest months."""
    order = Window.partitionBy("project_id").orderBy(F.desc("usage_count"), "tag")
    tags = registry.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("project_id", F.lit("tag").alias("kind"), F.col("tag").alias("value"), "rank")
    offered = tags.unionByName(months.select("project_id", F.lit("month").alias("kind"), F.col("month").alias("value"), "rank"))
    return answers.where("hits = 0").select("query_id", "project_id").join(offered, "project_id")


def within_characters(hits: DataFrame, budget: int) -> DataFrame:
    """Hits (query_id, project_id, rank, memory_id, snippet) in order of rank as far as ``budget`` characters go; the one
    that exceeds it is cut, and says so. A query's hits of a project are few: the search has limited them."""
    before = Window.partitionBy("query_id", "project_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = hits.withColumn("spent", F.coalesce(F.sum(F.length("snippet")).over(before), F.lit(0)))
    kept = spent.where(F.col("spent") < budget).withColumn("cut", F.substring("snippet", F.lit(1), (F.lit(budget) - F.col("spent")).cast("int")))
    return kept.select("query_id", "project_id", "rank", "memory_id", F.col("cut").alias("snippet"), (F.length("cut") < F.length("snippet")).alias("truncated"))


def best_decision(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per query and project the topic whose evidence the best hit cites; of equals the one updated last.

    ``hits`` (query_id, project_id, rank, source_events), ``decisions`` (canonical_id, event_key, updated_at).
    """
    cited = hits.select("query_id", "project_id", "rank", F.explode("source_events").alias("source")).withColumn("event_key", F.lower(F.trim("source")))
    matched = cited.join(decisions, "event_key").groupBy("query_id", "project_id", "canonical_id").agg(F.min("rank").alias("rank"), F.max("updated_at").alias("updated_at"))
    best = F.min_by(F.struct("canonical_id", "rank"), F.struct("rank", (-F.unix_micros(instant(F.col("updated_at")))).alias("age"), "canonical_id"))
    return matched.groupBy("query_id", "project_id").agg(best.alias("b")).select("query_id", "project_id", "b.canonical_id", "b.rank")


def classify(hits: DataFrame, asked: DataFrame, conflicting: DataFrame) -> DataFrame:
    """One row per query and project of ``asked``: how well the hits answer.

    ``hits`` (query_id, project_id, tier; 0 for messages that were not processed), ``conflicting`` (query_id, project_id): where the decision behind is disputed.
    """
    best = hits.groupBy("query_id", "project_id").agg(F.max("tier").alias("tier"), F.count("*").alias("hits"))
    joined = asked.join(best, ["query_id", "project_id"], "left").join(conflicting.select("query_id", "project_id").distinct().withColumn("disputed", F.lit(True)), ["query_id", "project_id"], "left")
    answer = F.when(F.col("tier").isNull(), "no_reliable_memory_found").when(F.col("disputed"), "conflicting_memories_found").when(F.col("tier") == 3, "exact_record_found").when(F.col("tier") == 2, "similar_record_found").when(F.col("tier") == 0, "unprocessed_raw_match").otherwise("possible_match")
    return joined.select("query_id", "project_id", answer.alias("classification"), F.coalesce("hits", F.lit(0)).alias("hits"))


def rank_topics(views: DataFrame, topic: str, limit: int = 8) -> DataFrame:
    """Per project the up to ``limit`` topics nearest to ``topic``: exact, prefix, contained, or by common words; and
    whether the first is selected, which takes 60 points and no equal."""
    asked = F.lit(topic)
    q, name = normalize_topic(asked), normalize_topic(F.col("topic"))
    overlap = F.size(F.array_intersect(F.filter(F.split(q, " "), lambda t: t != ""), F.split(name, " ")))
    prefix, contains = F.startswith(name, q) | F.startswith(q, name), F.contains(name, q) | F.contains(q, name)
    score = F.when(name == q, 100).when(prefix, 60 + overlap).when(contains, 40 + overlap).otherwise(overlap * 10)
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), "topic", "canonical_id")
    ranked = views.select("project_id", "canonical_id", "topic", score.alias("score")).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    top = ranked.where("rank <= 2").groupBy("project_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    chosen = (F.col("rank") == 1) & (F.col("first") >= 60) & ~F.col("first").eqNullSafe(F.col("second"))
    return ranked.join(top, "project_id").select("project_id", "canonical_id", "topic", "score", "rank", chosen.alias("selected"))


def trail_classes(asked: DataFrame, ranked: DataFrame, views: DataFrame, unreliable: DataFrame, disputed: DataFrame) -> DataFrame:
    """One row a project of ``asked`` (project_id): how reliable the trail of the topic is that ``rank_topics`` selected.

    ``views`` (canonical_id, current_event_id), ``unreliable`` (event_id): those whose evidence does not hold, ``disputed``
    (canonical_id)."""
    sums = ranked.groupBy("project_id").agg(F.count("*").alias("topics"), F.max(F.when(F.col("selected"), F.col("canonical_id"))).alias("canonical_id"))
    trail = sums.join(views.select("canonical_id", F.col("current_event_id").alias("event_id")), "canonical_id", "left")
    trail = trail.join(unreliable.select("event_id").distinct().withColumn("weak", F.lit(True)), "event_id", "left").join(disputed.select("canonical_id").distinct().withColumn("disputed", F.lit(True)), "canonical_id", "left")
    known = asked.join(trail, "project_id", "left")
    named = F.when(F.col("topics").isNull(), "no_reliable_trail").when(F.col("canonical_id").isNull(), "ambiguous_topic").when(F.col("event_id").isNull(), "no_reliable_trail")
    named = named.when(F.col("weak"), "incomplete_trail").when(F.col("disputed"), "conflicting_trail").otherwise("exact_trail")
    return known.select("project_id", "canonical_id", F.coalesce("topics", F.lit(0)).alias("topics"), named.alias("classification"))


def staleness(views: DataFrame, current_at: DataFrame, now: str, threshold_days: int = 90) -> DataFrame:
    """Per topic the age of its current decision in days, and whether it may be stale: unknown in the future or without a
    readable time, not applicable without a current decision. ``current_at`` (current_event_id, timestamp)."""
    at, asked = instant(F.col("timestamp")), F.to_timestamp(F.lit(now))
    elapsed = F.unix_micros(asked) - F.unix_micros(at)
    day = 86_400_000_000
    status = F.when(F.col("current_event_id").isNull(), "not_applicable").when(at.isNull() | (elapsed < 0), "unknown").when(elapsed >= threshold_days * day, "possibly_stale").otherwise("fresh")
    joined = views.join(current_at, "current_event_id", "left")
    return joined.select("canonical_id", status.alias("staleness"), F.when(elapsed >= 0, F.floor(elapsed / day)).alias("age_days"))
