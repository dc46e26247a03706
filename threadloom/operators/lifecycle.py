"""Evidence of what hooks did: sessions that are proven to be captured, and the latest records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def verified_sessions(records: DataFrame, captured: DataFrame) -> DataFrame:
    """(session_id, project_id, runtime, latest): sessions that were started, and of which the last prompt and the last
    reply that a hook captured are stored, sound, in their role and session.

    ``records`` (session_id, project_id, runtime, event, outcome, event_key, at); ``captured`` (event_key, session_id,
    role, sound). Sums are made before the shuffle: a long session does not meet in one task.
    """
    keys = ("session_id", "project_id", "runtime")
    last = lambda event: F.max(F.when((F.col("event") == event) & (F.col("outcome") == "success"), F.struct("at", "event_key")))["event_key"]
    sums = records.where("session_id IS NOT NULL").groupBy(*keys).agg(
        F.bool_or((F.col("event") == "SessionStart") & (F.col("outcome") == "success")).alias("started"), last("UserPromptSubmit").alias("prompt"), last("Stop").alias("reply"), F.max("at").alias("latest")
    )
    ends = sums.where("started AND prompt IS NOT NULL AND reply IS NOT NULL")
    sound = captured.where("sound")
    stored = lambda c, role: sound.where(F.col("role") == role).select(F.col("event_key").alias(c), "session_id")
    return ends.join(stored("prompt", "user"), ["prompt", "session_id"], "left_semi").join(stored("reply", "assistant"), ["reply", "session_id"], "left_semi").select(*keys, "latest")


def tail(records: DataFrame, most: int = 2_000) -> DataFrame:
    """Of each project's records (project_id, observed_at, record_id) the last ``most``, in order."""
    order = Window.partitionBy("project_id").orderBy(F.desc("observed_at"), F.desc("record_id"))
    return records.withColumn("from_last", F.row_number().over(order)).where(F.col("from_last") <= most)
