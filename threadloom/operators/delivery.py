"""Deliveries and the kept copy of each event.

An event may be delivered many times. Its kept copy is the delivery received first among those whose ``content_hash``
is the SHA-256 of their content; where none is, the one received first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import fold

RANK = "struct<unsound:int,received_at:timestamp,delivery_id:bigint>"


def unsound() -> Column:
    """0 where the hash vouches for the content, else 1 (null content or hash, or another hash)."""
    good = F.lower(F.col("content_hash")) == F.sha2(F.col("content").cast("binary"), 256)
    return F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1)


def rank(*payload: Column) -> Column:
    """Orders the deliveries of one event, best first. A null ``received_at`` comes last."""
    late = F.coalesce(F.col("received_at"), F.timestamp_micros(F.lit(253_402_300_799_000_000)))
    return F.struct(unsound().alias("unsound"), late.alias("received_at"), F.col("delivery_id"), *payload)


def ranked(deliveries: DataFrame, *payload: Column) -> DataFrame:
    """Narrow rows (event_key, rank). Rows without an event id can repeat nothing: each is an event of its own."""
    own = F.concat(F.lit("\0delivery "), F.col("delivery_id").cast("string"))
    return deliveries.select(F.coalesce(fold(F.col("event_id")), own).alias("event_key"), rank(*payload).alias("rank"))


def kept_copies(deliveries: DataFrame, *payload: Column) -> DataFrame:
    """One row per event: event_key, delivery_id and the payload columns of its kept copy.

    The content is judged where it is read; only the rank and the payload are shuffled. Copies within a map task are
    combined before the shuffle, so one event that makes up a third of all deliveries costs one row a task.
    """
    best = ranked(deliveries, *payload).groupBy("event_key").agg(F.min("rank").alias("rank"))
    return best.select("event_key", "rank.*").drop("unsound", "received_at")
