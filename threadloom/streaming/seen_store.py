"""Messages delivered more than once: exactly one sound copy of each.

A keyed streaming state store holds, per identifier, the best delivery seen so far, and decides: each delivery comes out
of the stream once, as ``repeated`` if the store holds a better one of its identifier, else as ``kept`` (or ``late``,
where the identifier may have been seen and forgotten). An identifier is forgotten when the event-time watermark has left
its best delivery ``stretch`` behind. Every micro-batch writes its decisions into a folder named after the batch; a batch
that is run again after a failure overwrites its own folder, and the checkpoint moves on only afterwards, so state and
output agree.

A kept delivery may lose its place to a better one that comes later: within the store's memory, or, after it was
forgotten, to a late arrival. Such identifiers were published as kept more than once, and the published table tells: of
an identifier's kept and late deliveries the best stands (``replaced``, ``kept``). Nothing reads the deliveries again.

State is kept in ``buckets`` of identifiers, one value a bucket, so that a state update is one call for some thousand
identifiers. Copies that one task reads at a time are decided there, so of an identifier with a third of all deliveries a
bucket gets one a task and Arrow batch.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from threadloom.operators.delivery import ranked
from threadloom.session import scratch

DECISIONS = "event_key string, unsound int, at bigint, delivery_id bigint, verdict string"
_ROWS = "event_key string, unsound int, at bigint, delivery_id bigint, seen_at timestamp, verdict string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _decide_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks deliveries as repeated of which a better one stands in the same batch, and those without an identifier as
    kept; the others are for the state to decide."""
    for batch in batches:
        keys, unsound, at, ids = (batch.column(i).to_pylist() for i in range(4))
        best: dict[str, tuple] = {}
        for row in zip(keys, unsound, at, ids, strict=True):
            held = best.get(row[0])
            if held is None or row[1:] < held:
                best[row[0]] = row[1:]
        verdicts = ["kept" if k.startswith("\0") else None if best[k] == (u, t, d) else "repeated" for k, u, t, d in zip(keys, unsound, at, ids, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(verdicts, pa.string())], names=[*batch.schema.names[:5], "verdict"])


def _decide(stretch_ms: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = pickle.loads(state.get[0]) if state.exists else {}
        horizon = (state.getCurrentWatermarkMs() - stretch_ms) * 1000
        changed = False
        for frame in frames:
            out = []
            for k, u, at, d, verdict in zip(frame["event_key"], frame["unsound"], frame["at"], frame["delivery_id"], frame["verdict"], strict=True):
                if verdict is None:
                    rank, mine = (int(u), int(at), int(d)), held.get(k)
                    if mine is None:
                        verdict = "late" if at < horizon else "kept"
                    else:
                        verdict = "kept" if rank < mine else "repeated"
                    if verdict != "repeated":
                        held[k] = rank
                        changed = True
                out.append(verdict)
            yield frame[["event_key", "unsound", "at", "delivery_id"]].assign(verdict=out)
        gone = [k for k, rank in held.items() if rank[1] < horizon]
        for k in gone:
            del held[k]
        if changed or gone:
            state.update((pickle.dumps(held, protocol=5),))

    return update


class SeenStore:
    """``stretch_days``: how long, in event time, an identifier is remembered. ``delay``: how far the watermark stays
    behind the latest delivery. ``buckets``: groups of identifiers; fixed for the life of the store, by default one for
    each half megabyte that is there at first. ``trigger_bytes``: most input of one micro-batch (one file is never
    divided); by default a sixteenth of what is there, 32 MB at least."""

    def __init__(self, spark: SparkSession, root: str | None = None, stretch_days: float = 45, delay: str = "2 days", trigger_bytes: int | None = None, buckets: int | None = None):
        self.spark, self.root = spark, root or scratch(spark, "seen")
        self.stretch_days, self.delay, self.trigger_bytes, self.buckets = stretch_days, delay, trigger_bytes, buckets

    @property
    def published(self) -> str:
        return f"{self.root}/seen"

    def _path(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _length(self, path: str) -> int:
        hadoop, fs = self._path(path)
        return fs.getContentSummary(hadoop).getLength()

    def _fixed_buckets(self, path: str) -> int:
        """The number of buckets that the store began with."""
        hadoop, fs = self._path(f"{self.root}/buckets")
        if fs.exists(hadoop):
            return int(fs.listStatus(hadoop)[0].getPath().getName())
        buckets = self.buckets or max(8, self._length(path) // 500_000)
        fs.create(self._path(f"{self.root}/buckets/{buckets}")[0]).close()
        return buckets

    def stream(self, path: str, schema) -> DataFrame:
        size = self.trigger_bytes or max(32 << 20, self._length(path) // 16)
        reader = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", size)
        if path.endswith(".parquet") and os.path.isfile(path.removeprefix("file://")):
            reader = reader.option("pathGlobFilter", os.path.basename(path))
            path = os.path.dirname(path)
        return reader.parquet(path)

    def decisions(self, deliveries: DataFrame, buckets: int) -> DataFrame:
        """The stateful part: every delivery with its verdict."""
        rows = ranked(deliveries, F.col("received_at").alias("seen_at"))
        flat = rows.select("event_key", "rank.unsound", F.unix_micros("rank.received_at").alias("at"), "rank.delivery_id", "rank.seen_at")
        # what is decided already only passes through, wherever it goes
        bucket = F.pmod(F.when(F.col("verdict").isNull(), F.xxhash64("event_key")).otherwise(F.xxhash64("delivery_id")), F.lit(buckets)).cast("int")
        here = flat.mapInArrow(_decide_here, _ROWS).withWatermark("seen_at", self.delay).withColumn("bucket", bucket)
        out = T._parse_datatype_string(DECISIONS)
        return here.groupBy("bucket").applyInPandasWithState(_decide(int(self.stretch_days * 86_400_000)), out, T._parse_datatype_string("ids binary"), "append", GroupStateTimeout.NoTimeout)

    def run(self, path: str, schema) -> None:
        """Feeds everything that ``path`` holds and that was not fed before, then stops."""

        def publish(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.published}/batch={batch_id}")

        conf = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
        before = {key: self.spark.conf.get(key, None) for key in conf}
        for key, value in conf.items():
            self.spark.conf.set(key, value)
        try:
            stream = self.decisions(self.stream(path, schema), self._fixed_buckets(path))
            query = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(publish).start()
            query.awaitTermination()
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)

    def read(self) -> DataFrame:
        """All decisions so far; none before the first run."""
        hadoop, fs = self._path(self.published)
        if not fs.exists(hadoop):
            decided = self.spark.createDataFrame([], DECISIONS)
        else:
            decided = self.spark.read.schema(DECISIONS).parquet(self.published)
        return decided.select("event_key", F.struct("unsound", "at", "delivery_id").alias("rank"), "delivery_id", "verdict")

    def kept(self) -> DataFrame:
        """(event_key, delivery_id): the kept copy of each identifier."""
        best = self.read().where("verdict <> 'repeated'").groupBy("event_key").agg(F.min("rank").alias("best"))
        return best.select("event_key", "best.delivery_id")

    def repeated(self) -> DataFrame:
        """(event_key, delivery_id) of every delivery that is not the kept copy of its identifier: those the stream has
        called repeated, and those it has called kept that a better one replaced."""
        decided = self.read()
        said = decided.where("verdict = 'repeated'").select("event_key", "delivery_id")
        kept = decided.where("verdict <> 'repeated'")
        twice = kept.groupBy("event_key").agg(F.min("rank").alias("best"), F.count("*").alias("n")).where("n > 1")
        replaced = kept.join(twice, "event_key").where(F.col("rank") > F.col("best")).select("event_key", "delivery_id")
        return said.unionByName(replaced)


def repeated_deliveries(spark: SparkSession, path: str, **options) -> DataFrame:
    """(event_id, delivery_id) of every delivery that is not the kept copy of its event.

    Defined results: an empty table gives no row; rows without an event id repeat nothing; null content or hash is
    unsound; exact ties cannot occur as ``delivery_id`` is unique; extra columns are never read.
    """
    needed = spark.read.parquet(path).select("event_id", "delivery_id", "received_at", "content", "content_hash")
    store = SeenStore(spark, **options)
    store.run(path, needed.schema)
    return store.repeated().select(F.col("event_key").alias("event_id"), "delivery_id")
