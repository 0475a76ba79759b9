"""Exact and sketched nearest-neighbour search over vector tables (vector_id, embedding, ...)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import batches

DIGITS = 6


def nearest(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", scope=None) -> DataFrame:
    """vector_id, distance of the k nearest; a bounded top-k per task, no full sort.  scope: a predicate applied before."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if scope is None else vectors.where(scope)
    scored = rows.where(V.usable(F.col("embedding"), len(query))).select("vector_id", F.round(V.distance(F.col("embedding"), q, metric), DIGITS).alias("distance"))
    return scored.orderBy("distance", "vector_id").limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """query_id, rank, vector_id, distance for every row of queries (query_id, embedding).

    Queries travel to the vectors, which stay where they lie: a task compares them with its vectors
    as matrices and gives its k best of each.  Distances that are no numbers come after all numbers,
    those of null vectors last.
    """
    spark, ids = vectors.sparkSession, lambda name: F.col(name).cast("long").alias(name)
    given = queries.select(ids("query_id"), V.as_doubles(F.col("embedding"))).toArrow()
    passes = batches.query_passes(given.column(0), given.column(1))
    rows = vectors.select(ids("vector_id"), V.as_doubles(F.col("embedding")).alias("embedding"))
    found = [rows.mapInArrow(batches.best_of(q, k, metric, DIGITS), batches.FOUND) for q in passes]
    scored = functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], batches.FOUND)
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), F.asc_nulls_last("vector_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vector_id", "distance")


def hamming_candidates(vectors: DataFrame, query: list[float], dim: int, budget: int) -> DataFrame:
    """vector_id, hamming of the vectors whose sign sketches are nearest to the query's."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vector_id", "embedding", V.hamming(V.sign_sketch(F.col("embedding"), dim), V.sign_sketch(q, dim)).alias("hamming"))
    return scored.orderBy("hamming", "vector_id").limit(budget)


def candidate_budget(k: int, total: int, channel_k: int | None = None) -> int:
    """How many candidates a sketch scan keeps."""
    return min(total, channel_k if channel_k is not None else max(4 * k, 2048))


def sketch_then_rerank(vectors: DataFrame, query: list[float], k: int, total: int, channel_k: int | None = None, metric: str = "cosine") -> DataFrame:
    """Candidates by sign sketch, then exact distances among them."""
    some = hamming_candidates(vectors, query, len(query), candidate_budget(k, total, channel_k))
    return nearest(some, query, k, metric)
