"""The tag registry of each project, and suggestions from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import normalize_tag


def registry(memories: DataFrame, feed: DataFrame, examples: int = 5) -> DataFrame:
    """Per project and normalised tag of the memories that no control event names: usage, last use, confidence,
    spellings, the first spelling, and the first ``examples`` memories."""
    live = memories.join(feed.select(F.col("target_memory_id").alias("id")).where("id IS NOT NULL"), "id", "left_anti")
    used = live.select("project_id", "id", "updated_at", "confidence", F.explode(F.array_distinct("tags")).alias("raw_tag")).withColumn("tag", normalize_tag(F.col("raw_tag"))).where("tag <> ''")
    spellings = F.array_sort(F.filter(F.collect_set("raw_tag"), lambda r: r.isNotNull()))
    sums = used.groupBy("project_id", "tag").agg(F.count("*").alias("usage_count"), F.max("updated_at").alias("last_used"), F.max("confidence").alias("confidence"), F.min(F.struct("id", "raw_tag"))["raw_tag"].alias("raw_tag"), spellings.alias("spellings"))
    order = Window.partitionBy("project_id", "tag").orderBy("id")
    first = used.select("project_id", "tag", "id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= examples)
    shown = first.groupBy("project_id", "tag").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return sums.join(shown, ["project_id", "tag"]).withColumn("aliases", F.filter("spellings", lambda s: s != F.col("tag"))).drop("spellings")


def suggest(tags: DataFrame, words: list[str], considered: int = 128, limit: int = 8) -> DataFrame:
    """Per project up to ``limit`` tags: those equal to one of ``words`` first, then the most used."""
    exact = F.col("tag").isin(*words) if words else F.lit(False)
    order = Window.partitionBy("project_id").orderBy(F.desc("exact"), F.desc("usage_count"), "tag")
    ranked = tags.withColumn("exact", exact).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(limit, considered))
    return ranked.select("project_id", "tag", "usage_count", "exact", "rank")


def month_buckets(tags: DataFrame, most: int = 5) -> DataFrame:
    """Per project the latest months in which tags were used."""
    months = tags.select("project_id", F.substring("last_used", 1, 7).alias("month")).where(F.col("month").rlike(r"^\d{4}-\d{2}$")).distinct()
    order = Window.partitionBy("project_id").orderBy(F.desc("month"))
    return months.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
