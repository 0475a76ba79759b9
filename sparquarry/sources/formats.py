"""Sources and sinks: evaluation corpora, raw vectors, run files, JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """key, title, text of a corpus of JSON lines (_id, title, text)."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("key"), "title", "text")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """query, text of JSON lines (_id, text)."""
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query, key, rel of a tab-separated file with a header."""
    return spark.read.option("sep", "\t").option("header", True).schema("query string, key string, rel int").csv(path)


def read_f32(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """vector_id, embedding of files of little-endian 32-bit floats, row after row; ids follow path order and row.

    Files are read as fixed-length records, so a large file is split.
    """
    records = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    rows = records.toDF("vector_id long, raw binary")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"vector_id": f["vector_id"], "embedding": [np.frombuffer(x, "<f4") for x in f["raw"]]})

    return rows.mapInPandas(unpack, "vector_id long, embedding array<float>")


def write_run(run: DataFrame, path: str, tag: str = "run") -> None:
    """A run (query_id, rank, doc, score) as lines: query Q0 doc rank score tag."""
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("score")), F.lit(tag))
    run.orderBy("query_id", "rank").select(line.alias("value")).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", " ")
    return spark.read.text(path).select(f[0].alias("query_id"), f[3].cast("int").alias("rank"), f[2].alias("doc"), f[4].cast("double").alias("score"), f[5].alias("tag"))


def synthetic_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """vector_id, embedding: unit vectors of Gaussian components with a scale of their own per component; the same for a seed at any number of partitions."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = np.random.default_rng(seed).uniform(0.5, 1.5, dim)
        for f in frames:
            x = np.stack([np.random.default_rng((seed, int(i))).normal(size=dim) for i in f["id"]]) * scale if len(f) else np.zeros((0, dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"vector_id": f["id"], "embedding": list(x.astype(np.float32))})

    return spark.range(0, n, numPartitions=partitions).mapInPandas(make, "vector_id long, embedding array<float>")
