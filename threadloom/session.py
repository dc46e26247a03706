"""Sessions, table reading and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(master).appName("threadloom")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or, where unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/threadloom/{label}-{uuid.uuid4().hex[:12]}"
    owner = os.getpid()

    def remove() -> None:
        with contextlib.suppress(Exception):
            if os.getpid() == owner:
                delete_path(spark, path)

    atexit.register(remove)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Drops the shuffle files of each query that runs within as soon as it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared folder and reads it back, so that a lost executor costs
    only its own tasks."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with tidy(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of ``value``, whose classes travel along; the result, called in a task, gives the value, which the task
    unpacks once."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list[object] = []

    def value_here() -> object:
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return value_here
