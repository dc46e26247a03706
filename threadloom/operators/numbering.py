"""Numbering rows within groups without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.session import materialise


def _local(group: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, current, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            numbers = []
            for value in batch.column(batch.schema.get_field_index(group)).to_pylist():
                n = n + 1 if value == current else 0
                current = value
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(numbers), pa.int64()), pa.array(numbers, pa.int64())], names=[*batch.schema.names, "_part", "_number"])

    return run


def numbered(rows: DataFrame, group: str, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``rows`` with their number (from ``first``) within ``group`` in ``order``, which must be total.

    Rows are range-partitioned by group and order and numbered within each partition; only the counts by group and
    partition are then summed. A group with a third of all rows spreads over many partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_number", T.LongType())])
    spread = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    local = materialise(spread.mapInArrow(_local(group), schema), "numbered")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = local.groupBy(group, "_part").agg(F.count("*").alias("_size"))  # at most one row a group and partition
    offsets = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    joined = local.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(name, F.col("_start") + F.col("_number") + first).drop("_part", "_number", "_group", "_at", "_start")
