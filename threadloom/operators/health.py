"""Health and upkeep: statistics, capture health, diagnosis, enrichment, settings, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States from best to worst.
STATES = ("healthy", "unknown", "degraded", "broken")


def collection_counts(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, rows)."""
    out: DataFrame | None = None
    for name, df in collections.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("collection"), "rows")
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return out


def capture_health(records: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Per project, from lifecycle records (project_id, at, outcome, operation_id, kind) of the last ``hours``.

    Without a fresh record the state is unknown; a failure as the last word is broken, earlier ones degrade, and so does
    an operation that began and never ended.
    """
    fresh = records.withColumn("fresh", (F.col("at") >= now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("at") <= now))
    ended = records.where("kind = 'ended'").select("project_id", "operation_id").distinct()
    unfinished = fresh.where("fresh AND kind = 'started'").join(ended, ["project_id", "operation_id"], "left_anti").groupBy("project_id").agg(F.count("*").alias("unfinished"))
    seen = F.col("fresh")
    sums = fresh.groupBy("project_id").agg(F.count_if(seen).alias("recent"), F.count_if(seen & (F.col("outcome") == "failure")).alias("failures"), F.max_by(F.when(seen, F.col("outcome")), F.when(seen, F.struct("at", "operation_id"))).alias("last"))
    state = F.when(F.col("recent") == 0, "unknown").when(F.col("last") == "failure", "broken").when((F.col("failures") > 0) | (F.coalesce("unfinished", F.lit(0)) > 0), "degraded").otherwise("healthy")
    return sums.join(unfinished, "project_id", "left").select("project_id", state.alias("state"), "recent", "failures", F.coalesce("unfinished", F.lit(0)).alias("unfinished"))


def overall(states: DataFrame) -> DataFrame:
    """The worst state and how many projects are in it."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return states.groupBy("state").agg(F.count("*").alias("projects")).orderBy(F.desc(rank)).limit(1)


def diagnose(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, faults, state) of data sets of faulty rows: any fault is broken."""
    return collection_counts(checks).select(F.col("collection").alias("check"), F.col("rows").alias("faults"), F.when(F.col("rows") > 0, "broken").otherwise("healthy").alias("state"))


def enrichment_candidates(documents: DataFrame, feed: DataFrame, overlays: DataFrame, limit: int = 6) -> DataFrame:
    """Per project the first memories to enrich: eligible for the index, with a source hash, without control event or
    overlay."""
    touched = feed.select(F.col("target_memory_id").alias("memory_id")).where("memory_id IS NOT NULL")
    open_ = documents.where("index AND source_hash IS NOT NULL").join(touched, "memory_id", "left_anti").join(overlays.select("memory_id"), "memory_id", "left_anti")
    order = Window.partitionBy("project_id").orderBy("created_at", "memory_id")
    return open_.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("project_id", "memory_id", "position")


def evidence_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """Candidates (project_id, position, memory_id, length) as far as ``budget`` characters of evidence go; the one that
    exhausts it is the last."""
    before = Window.partitionBy("project_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    spent = candidates.withColumn("before", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return spent.where(F.col("before") < budget).select("project_id", "memory_id", "position", F.least(F.col("length"), F.lit(budget) - F.col("before")).alias("granted"))


def apply_overlays(documents: DataFrame, overlays: DataFrame) -> DataFrame:
    """Search tags with those of a valid overlay (memory_id, source_hash, source_events, tags); a stale one is reported.

    An overlay is valid while its memory still has the same source hash and the same set of sources.
    """
    o = overlays.select("memory_id", F.col("source_hash").alias("o_hash"), F.col("source_events").alias("o_events"), F.col("tags").alias("o_tags"))
    joined = documents.join(o, "memory_id", "left")
    same = (F.size("o_events") == F.size("source_events")) & (F.size(F.array_except("o_events", "source_events")) == 0) & (F.size(F.array_distinct("o_events")) == F.size("o_events"))
    valid = F.col("o_hash").eqNullSafe(F.col("source_hash")) & F.coalesce(same, F.lit(False))
    status = F.when(F.col("o_events").isNull(), "none").when(valid, "applied").otherwise("stale_overlay")
    tags = F.when(status == "applied", F.array_sort(F.array_union("search_tags", "o_tags"))).otherwise(F.col("search_tags"))
    return joined.select("memory_id", status.alias("overlay"), F.size(tags).alias("tags"))


def resolve_settings(spark: SparkSession, layers: dict[str, dict[str, str]]) -> DataFrame:
    """(key, value, source) from layers of settings, later ones going before earlier ones."""
    rows = [(k, v, name, i) for i, (name, values) in enumerate(layers.items()) for k, v in values.items()]
    df = spark.createDataFrame(rows, "key string, value string, source string, layer int")
    return df.groupBy("key").agg(F.max(F.struct("layer", "value", "source")).alias("s")).select("key", "s.value", "s.source")


def scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per query the scores of a prediction, a missing one scoring zero.

    ``expected`` (query_id, classification, required, forbidden), ``predicted`` (query_id, classification, evidence).
    """
    p = predicted.select("query_id", F.col("classification").alias("got"), F.array_distinct("evidence").alias("evidence"))
    joined = expected.join(p, "query_id", "left")
    ev, req = F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("required", F.array().cast("array<string>"))
    hit = F.size(F.array_intersect(ev, req))
    recall = F.when(F.size(req) == 0, 1.0).otherwise(hit / F.size(req))
    precision = F.when(F.size(ev) == 0, F.when(F.size(req) == 0, 1.0).otherwise(0.0)).otherwise(hit / F.size(ev))
    right = F.coalesce((F.col("got") == F.col("classification")).cast("double"), F.lit(0.0))
    safe = F.when(F.size(F.array_intersect(ev, F.coalesce("forbidden", F.array().cast("array<string>")))) > 0, 0.0).otherwise(1.0)
    zero = F.col("got").isNull()
    out = {"evidence_recall": recall, "evidence_precision": precision, "classification_accuracy": right, "forbidden_safety": safe}
    rows = joined.select("query_id", *(F.when(zero, 0.0).otherwise(v).alias(k) for k, v in out.items()))
    mean = sum((F.col(k) for k in out), F.lit(0.0)) / len(out)
    return rows.withColumn("composite", F.round(mean, 6))
