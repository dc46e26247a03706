"""Applying a change feed: inserts, updates and deletes in the right order, whatever the order of arrival.

Changes are hashed by key into buckets. Each bucket is an embedded DuckDB table with a primary key; a change is an
upsert that takes effect only where its sequence (instant, change id) is greater than the stored one. Deletes stay as
tombstones, so that an older change which arrives later cannot bring a key back. Buckets export their rows into a
staging folder; one pointer, which only one writer can create, makes them the table's next version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.instants import instant, micros
from threadloom.functions.text import fold
from threadloom.session import materialise, scratch

CHANGE = "target string, op string, sequence bigint, change_id string, payload string"
STATE = CHANGE + ", deleted boolean"
_ARROW = pa.schema([("target", pa.string()), ("op", pa.string()), ("sequence", pa.int64()), ("change_id", pa.string()), ("payload", pa.string()), ("deleted", pa.bool_())])
_UPSERT = """
INSERT INTO state
SELECT target, op, sequence, change_id, payload, op = ? FROM incoming
QUALIFY row_number() OVER (PARTITION BY target ORDER BY sequence DESC, change_id DESC, op DESC, payload DESC NULLS LAST) = 1
ON CONFLICT (target) DO UPDATE SET op = excluded.op, sequence = excluded.sequence, change_id = excluded.change_id, payload = excluded.payload, deleted = excluded.deleted
WHERE (excluded.sequence, excluded.change_id, excluded.op, coalesce(excluded.payload, '')) > (state.sequence, state.change_id, state.op, coalesce(state.payload, ''))
"""


def thin(changes: DataFrame, salts: int = 16) -> DataFrame:
    """At most ``salts`` rows a key: of the changes of one key and salt only the last can matter. Runs as a partial
    aggregate before the shuffle, so a key with a third of all changes never meets in one task."""
    salted = changes.withColumn("salt", F.pmod(F.xxhash64("change_id", "sequence"), F.lit(salts)))
    last = F.max(F.struct("sequence", "change_id", "op", "payload")).alias("last")
    return salted.groupBy("target", "salt").agg(last).select("target", "last.op", "last.sequence", "last.change_id", "last.payload")


def _bucket(delete_op: str, memory: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"memory_limit": memory, "threads": 1, "preserve_insertion_order": False, "temp_directory": ""})
        db.execute("CREATE TABLE state (target VARCHAR PRIMARY KEY, op VARCHAR, sequence BIGINT, change_id VARCHAR, payload VARCHAR, deleted BOOLEAN)")
        for batch in batches:
            incoming = pa.Table.from_batches([batch])  # noqa: F841 (DuckDB reads it by name)
            db.execute(_UPSERT, [delete_op])
        for batch in db.sql("SELECT * FROM state").to_arrow_reader(20_000):
            yield from pa.Table.from_batches([batch]).cast(_ARROW).to_batches()
        db.close()

    return apply


class Conflict(RuntimeError):
    """Another writer has published a version since the one that was read."""


@dataclass
class ChangeTable:
    """A table of current rows at ``root``, versioned; readers follow the pointer and never see half a version.

    A version is a pointer, numbered by the successor of the version that was read, which names the folder of each
    bucket. An apply reads and writes only the buckets that its changes touch; a pointer of a number that exists is a
    conflict, and nothing is published. ``buckets`` is fixed for the life of the table; a bucket must fit
    ``bucket_memory``, as DuckDB is given no folder to spill to."""

    spark: SparkSession
    root: str
    buckets: int = 64
    delete_op: str = "delete"
    bucket_memory: str = "512MB"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, dict[int, str]]:
        """The number of the current version, 0 before the first, and the folder of each of its buckets."""
        jvm, fs = self._fs()
        found = sorted((s.getPath().getName(), s.getPath()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/current-*")) or [])
        if not found:
            return 0, {}
        name, path = found[-1]
        stream = fs.open(path)
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return int(name.split("-")[1]), {int(b): at for b, at in json.loads(text).items()}

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(*folders) if folders else self.spark.createDataFrame([], STATE)

    def read(self) -> DataFrame:
        """The current state, tombstones included; empty before the first apply."""
        return self._rows([f"{self.root}/{at}" for _, at in sorted(self.version()[1].items())])

    def apply(self, changes: DataFrame, salts: int = 16) -> DataFrame:
        """Applies ``changes`` (target, op, sequence, change_id, payload) and returns the new state.

        Applying the same changes again, in any order or split, gives the same state.
        """
        number, folders = self.version()
        bucket = F.pmod(F.xxhash64("target"), F.lit(self.buckets)).cast("int").alias("bucket")
        fresh = materialise(thin(changes, salts).select("*", bucket), "changes")
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        before = self._rows([f"{self.root}/{folders[b]}" for b in touched if b in folders]).drop("deleted").select("*", bucket)
        new = f"v-{uuid.uuid4().hex}"
        done = fresh.unionByName(before).repartitionById(self.buckets, "bucket").drop("bucket").mapInArrow(_bucket(self.delete_op, self.bucket_memory), STATE)
        done.select("*", bucket).write.partitionBy("bucket").parquet(f"{self.root}/{new}")  # staged: no pointer names it yet
        self._publish(number + 1, folders | {b: f"{new}/bucket={b}" for b in touched})
        return self.read()

    def _publish(self, number: int, folders: dict[int, str]) -> None:
        jvm, fs = self._fs()
        hadoop = jvm.org.apache.hadoop.fs
        staged, pointer = hadoop.Path(f"{self.root}/.staged-{uuid.uuid4().hex}"), hadoop.Path(f"{self.root}/current-{number:08d}")
        out = fs.create(staged)
        out.writeBytes(json.dumps(folders))
        out.close()
        nothing = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:  # unlike that of a FileSystem, this rename never replaces a file
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, pointer, nothing)
        except Py4JJavaError as error:
            fs.delete(staged, False)
            raise Conflict(f"version {number} of {self.root} was published by another writer") from error


#: What a control event does to its memory.
STATUS = {"forget": "revoked", "correct": "superseded", "delete": "deleted"}


def control_changes(feed: DataFrame) -> DataFrame:
    """The counting events of a control feed as changes.

    An event counts if its kind is known, its timestamp is a readable instant, a correction names its replacement and
    corrections and deletions have evidence. Null in any of these makes an event not count; it never fails.
    """
    at = micros(instant(F.col("timestamp")))
    replaced = F.coalesce(fold(F.col("replacement_memory_id")) != "", F.lit(False))
    evidence = F.coalesce(F.size(F.filter(F.col("evidence_refs"), lambda r: F.coalesce(fold(r) != "", F.lit(False)))) > 0, F.lit(False))
    kind = F.col("kind")
    counts = (kind == "forget") | ((kind == "correct") & replaced & evidence) | ((kind == "delete") & evidence)
    return feed.where(counts).select(F.col("target_memory_id").alias("target"), kind.alias("op"), at.alias("sequence"), fold(F.col("event_id")).alias("change_id"), F.col("replacement_memory_id").alias("payload")).where("target IS NOT NULL AND sequence IS NOT NULL AND change_id IS NOT NULL")


def apply_control_feed(feed: DataFrame, root: str | None = None, buckets: int | None = None) -> DataFrame:
    """The state of every target of a control feed: target, op, sequence, change_id, payload, deleted."""
    spark = feed.sparkSession
    buckets = buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ChangeTable(spark, root or scratch(spark, "change-table"), buckets).apply(control_changes(feed))


def _status() -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("op")]


def final_states(feed: DataFrame, memories: DataFrame) -> DataFrame:
    """(target_memory_id, final_status, last_event_id) of every memory with a counting event."""
    ids = memories.select(F.col("id").alias("target")).where("target IS NOT NULL")
    state = apply_control_feed(feed).join(ids, "target", "left_semi")
    return state.select(F.col("target").alias("target_memory_id"), _status().alias("final_status"), F.col("change_id").alias("last_event_id"))


def current_memories(feed: DataFrame, memories: DataFrame) -> DataFrame:
    """Every memory with its current state: ``active`` where no counting event names it."""
    ids = memories.select(F.col("id").alias("memory_id")).where("memory_id IS NOT NULL").distinct()
    state = apply_control_feed(feed).withColumnRenamed("target", "memory_id")
    return ids.join(state, "memory_id", "left").select("memory_id", F.coalesce(_status(), F.lit("active")).alias("current_status"), F.when(F.col("op") == "correct", F.col("payload")).alias("replacement_memory_id"), F.col("change_id").alias("last_event_id"))
