"""Ingesting message files as they arrive: captured records exactly once, and decision views kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import capture, decision_views, delivery, processing


class Ingest:
    """Turns a folder of message files into a table of captured records below ``root``.

    No delivery is dropped for its age: each batch looks its events up in the records already written, and writes those
    that are new or of which it brings a better copy (``delivery.rank``). Of the records of an event the best stands. A
    batch that runs again overwrites its own folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @property
    def records(self) -> str:
        return f"{self.root}/records"

    def _written(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.records)
        exists = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.records) if exists else None

    def read(self) -> DataFrame | None:
        """The record of each event, of the best copy so far."""
        written = self._written()
        if written is None:
            return None
        best = written.groupBy("event_key").agg(F.min("copy").alias("copy"))
        return written.join(best, ["event_key", "copy"], "left_semi").drop("copy")

    def run(self, folder: str, schema) -> None:
        incoming = self.spark.readStream.schema(schema).parquet(folder)

        def write(batch: DataFrame, batch_id: int) -> None:
            copies = delivery.ranked(batch).groupBy("event_key").agg(F.min("rank").alias("copy"))
            rows = capture.captured(batch).join(copies, "event_key")
            known = self._written()
            if known is not None:
                best = known.where(F.col("batch") != batch_id).groupBy("event_key").agg(F.min("copy").alias("best"))
                rows = rows.join(best, "event_key", "left").where(F.col("best").isNull() | (F.col("copy") < F.col("best"))).drop("best")
            rows.write.mode("overwrite").parquet(f"{self.records}/batch={batch_id}")

        query = incoming.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()

    def decision_views(self) -> DataFrame:
        """Views of all decisions so far; late events take their place by time, as views are made of all events."""
        records = self.read()
        if records is None:
            raise FileNotFoundError(self.records)
        return decision_views.views(processing.decision_events(records))
