"""Keyed, versioned records as plain tables: latest version, deletion, lookups, trees, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest order; an aggregate with map-side combine, so hot keys are no problem."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in others])).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in [order, *others]])


def survivors(frames: DataFrame, tombstones: DataFrame, frame_id: str = "frame_id") -> DataFrame:
    return frames.join(tombstones.select(frame_id), frame_id, "left_anti")


def get_many(rows: DataFrame, keys: list, key: str) -> DataFrame:
    """pos and the row of each key in the order given; nulls where there is none."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"pos int, {key} {dict(rows.dtypes)[key]}")
    return wanted.join(rows, key, "left").orderBy("pos")


def children_of(frames: DataFrame, parents: DataFrame, parent: str = "parent_frame_id", frame_id: str = "frame_id") -> DataFrame:
    return frames.join(parents.select(F.col(frame_id).alias(parent)), parent, "left_semi")


def orphans(frames: DataFrame, parent: str = "parent_frame_id", frame_id: str = "frame_id") -> DataFrame:
    """Rows whose parent does not exist."""
    own = frames.select(F.col(frame_id).alias(parent))
    return frames.where(F.col(parent).isNotNull()).join(own, parent, "left_anti")


def reparented(frames: DataFrame, tombstones: DataFrame, parent: str = "parent_frame_id", frame_id: str = "frame_id") -> DataFrame:
    """What compaction keeps: active rows, those of tombstoned parents as roots."""
    gone = tombstones.select(F.col(frame_id).alias(parent), F.lit(True).alias("gone"))
    active = survivors(frames, tombstones, frame_id)
    return active.join(gone, parent, "left").withColumn(parent, F.when(F.col("gone").isNull(), F.col(parent))).drop("gone")


def out_of_order(frames: DataFrame, group: str | None = None, frame_id: str = "frame_id", time: str = "created_at") -> DataFrame:
    """Rows created before the one ahead of them; with a group, within each."""
    order = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(frame_id)
    return frames.withColumn("before", F.lag(time).over(order)).where(F.col(time) < F.col("before")).drop("before")


def storage_stats(frames: DataFrame, tombstones: DataFrame, frame_id: str = "frame_id") -> DataFrame:
    """frames, active_frames, tombstone_ratio in one row."""
    marked = frames.join(tombstones.select(frame_id, F.lit(1).alias("dead")), frame_id, "left")
    total, dead = F.count(F.lit(1)), F.coalesce(F.sum("dead"), F.lit(0))
    return marked.agg(total.alias("frames"), (total - dead).alias("active_frames"), F.when(total > 0, dead / total).otherwise(F.lit(0.0)).alias("tombstone_ratio"))
