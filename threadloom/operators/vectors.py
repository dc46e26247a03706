"""Exact vector search, staleness of an index, and fusing ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import ship


def _best(ids: list[str], matrix: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, near = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), "", object)
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and len(v) == matrix.shape[1] and None not in v]
            if not rows:
                continue
            x = np.array([v for _, v in rows], np.float64)
            size = np.linalg.norm(x, axis=1)
            ok = np.isfinite(size) & (size > 0)
            x, own = x[ok] / size[ok, None], np.array([i for i, _ in rows], object)[ok]
            far = np.concatenate([far, -(matrix @ x.T)], axis=1)
            near = np.concatenate([near, np.broadcast_to(own, (len(ids), len(own)))], axis=1)
            order = np.array([np.lexsort((near[q].astype(str), np.round(far[q], 9)))[:k] for q in range(len(ids))])
            far, near = np.take_along_axis(far, order, axis=1), np.take_along_axis(near, order, axis=1)
        n = far.shape[1]
        yield pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(np.array(ids, object), n), pa.string()), "id": pa.array(near.ravel(), pa.string()), "similarity": pa.array(-far.ravel(), pa.float64())})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2_048) -> DataFrame:
    """(query, id, similarity, rank): the ``k`` most similar of ``vectors`` (id, vector) for each of ``queries``
    (query, vector), by cosine; equal ones by id. Exact.

    Queries go along in blocks of bounded size; every task keeps its ``k`` best for each, and only these are shuffled.
    """
    from pyspark.sql.window import Window

    spark, parts, held = vectors.sparkSession, [], []
    rows = vectors.select(F.col("id").cast("string"), F.col("vector").cast("array<double>"))

    def send() -> None:
        ids = [q for q, _ in held]
        matrix = np.array([v for _, v in held], np.float64)
        sent = ship(spark, (ids, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))
        parts.append(rows.mapInArrow(lambda b: _best(*sent(), k)(b), "query string, id string, similarity double"))
        held.clear()

    for row in queries.select(F.col("query").cast("string"), F.col("vector").cast("array<double>")).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            send()
    if held:
        send()
    if not parts:
        return spark.createDataFrame([], "query string, id string, similarity double, rank int")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stale_rows(index: DataFrame, manifests: DataFrame, documents: DataFrame) -> DataFrame:
    """Per completed generation its rows, and how many of them no longer stand for an eligible document."""
    done = manifests.where("completed_at IS NOT NULL").select("generation_id")
    rows = index.select("generation_id", "ordinal", "memory_id").distinct().join(done, "generation_id", "left_semi")
    live = documents.where("index").select("memory_id", F.lit(1).alias("live"))
    return rows.join(live, "memory_id", "left").groupBy("generation_id").agg(F.count("*").alias("rows"), F.count_if(F.col("live").isNull()).alias("stale"))


def nearest_to_first(index: DataFrame, manifests: DataFrame, limit: int = 50, least: float = 0.82) -> DataFrame:
    """Per project, in its last completed generation, the ``limit`` memories nearest to the first usable vector: a stored
    vector stands for an embedded query. (project_id, memory_id, similarity, rank), of at least ``least``."""
    from pyspark.sql.window import Window

    done = manifests.where("completed_at IS NOT NULL").groupBy("project_id").agg(F.max_by(F.struct("generation_id", "dimension"), F.struct("completed_at", "generation_id")).alias("g")).select("g.*")
    rows = index.select("generation_id", "project_id", "ordinal", "memory_id", F.col("vector").cast("array<double>").alias("v")).join(done, "generation_id")
    sized = rows.where((F.size("v") == F.col("dimension")) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    once = sized.where("size > 0").groupBy("project_id", "ordinal").agg(F.min_by(F.struct("memory_id", "v", "size"), "memory_id").alias("r")).select("project_id", "ordinal", "r.*")
    asked = once.groupBy("project_id").agg(F.min_by(F.struct("v", "size"), "ordinal").alias("q"))
    dot = F.aggregate(F.zip_with("v", "q.v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = once.join(asked, "project_id").select("project_id", "memory_id", F.round(dot / (F.col("size") * F.col("q.size")), 6).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("project_id", "memory_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("project_id").orderBy(F.desc("similarity"), "memory_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fuse(lexical: DataFrame, semantic: DataFrame, documents: DataFrame, weight: float = 0.7, constant: int = 60, limit: int = 8) -> DataFrame:
    """Reciprocal rank fusion of a project's lexical hits (project_id, memory_id, rank, tier, score, confidence) with its
    semantic ones (project_id, memory_id, rank). Hits that only the vectors tell must be eligible for the index, and are
    at most half sure. Exact records come first, then the fused score, the match tier, the lexical score, the id."""
    from pyspark.sql.window import Window

    one = lexical.select("project_id", "memory_id", F.col("rank").alias("lexical_rank"), "tier", "score", F.col("confidence").alias("sure"))
    two = semantic.select("project_id", "memory_id", F.col("rank").alias("semantic_rank"))
    known = documents.where("index").select("memory_id", F.col("confidence").alias("of_memory"))
    both = one.join(two, ["project_id", "memory_id"], "full_outer").join(known, "memory_id", "left").where("lexical_rank IS NOT NULL OR of_memory IS NOT NULL")
    part = lambda c, w: F.coalesce(F.lit(float(w)) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    fused = F.floor((part("lexical_rank", 1) + part("semantic_rank", weight)) * 1e6 + 0.5) / 1e6
    only = F.col("lexical_rank").isNull()
    branch = F.when(F.col("semantic_rank").isNull(), "lexical").when(only, "semantic").otherwise("hybrid")
    rows = both.withColumn("fused", fused).withColumn("branch", branch).withColumn("match", F.coalesce("tier", F.lit(1))).withColumn("confidence", F.when(only, F.least(F.lit(0.5), F.col("of_memory"))).otherwise(F.col("sure")))
    order = Window.partitionBy("project_id").orderBy(F.desc(F.coalesce(F.col("tier") == 3, F.lit(False))), F.desc("fused"), F.desc("match"), F.desc(F.coalesce("score", F.lit(0.0))), "memory_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("project_id", "memory_id", "fused", "branch", "confidence", "rank")
