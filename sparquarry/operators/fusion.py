"""Fusing ranked channels, and the influence of time.

A channel is a table (frame_id, score), higher is better, at most over_fetch() rows
after its own top-k, so ranking it in one window is bounded.
"""

from __future__ import annotations

import dataclasses
import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
EPS = 1.1920929e-07
NONE, ZSCORE, MINMAX, RRF = "none", "zscore", "minmax", "rrf"


def over_fetch(k: int, kind: str, scoped: bool = False, ranged: bool = False) -> int:
    """How many rows of a channel enter the fusion."""
    if kind == "text":
        return min(max(64 * k, 1000), 50_000) if scoped else max(4 * k, 100)
    return max(8 * k, 100) if ranged else max(2 * k, 50)


def ranked(channel: DataFrame) -> DataFrame:
    """With pos: 0 for the best, ties by frame."""
    order = Window.orderBy(F.desc("score"), "frame_id")
    return channel.withColumn("pos", F.row_number().over(order) - 1)


def _stack(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _best(sums: DataFrame, k: int | None) -> DataFrame:
    out = sums.withColumn("score", F.round("score", DIGITS)).orderBy(F.desc("score"), "frame_id")
    return out if k is None else out.limit(k)


def rrf(channels: list[DataFrame], k: int | None = 10, c: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal ranks: the sum of weight / (c + pos + 1) over the channels that have the frame."""
    weights = weights or [1.0] * len(channels)
    parts = [ranked(x).select("frame_id", (F.lit(w) / (F.lit(float(c)) + F.col("pos") + 1.0)).alias("score")) for x, w in zip(channels, weights)]
    return _best(_stack(parts).groupBy("frame_id").agg(F.sum("score").alias("score")), k)


def min_max(channel: DataFrame, tied: float, floor: float = 0.0) -> DataFrame:
    """Scores scaled to 0..1; a channel whose scores are all equal gets tied."""
    whole = Window.partitionBy()
    lo, hi = F.min("score").over(whole), F.max("score").over(whole)
    span = hi - lo
    return channel.select("frame_id", F.when(span > floor, (F.col("score") - lo) / span).otherwise(F.lit(tied)).alias("score"))


def weighted(channels: list[DataFrame], weights: list[float], k: int | None = 10) -> DataFrame:
    """Weighted sum of channels scaled to 0..1; tied channels count one half."""
    parts = [min_max(x, 0.5).select("frame_id", (F.col("score") * w).alias("score")) for x, w in zip(channels, weights)]
    return _best(_stack(parts).groupBy("frame_id").agg(F.sum("score").alias("score")), k)


@dataclasses.dataclass(frozen=True)
class FusionProfile:
    """Weights of the channels bm25, tfidf, jaccard, vector, and how each channel is scaled."""

    weights: tuple[float, float, float, float]
    normalization: str = NONE
    rrf_k: int = 60

    def __post_init__(self):
        if len(self.weights) != 4 or not all(math.isfinite(w) and w >= 0 for w in self.weights) or sum(self.weights) <= 0:
            raise ValueError("weights must be four finite numbers of at least 0, not all 0")
        if self.normalization not in (NONE, ZSCORE, MINMAX, RRF):
            raise ValueError("unknown normalization")
        if self.normalization == RRF and self.rrf_k < 1:
            raise ValueError("rrf_k must be at least 1")


def fuse(profile: FusionProfile, channels: dict[str, DataFrame], k: int | None = 10) -> DataFrame:
    """channels: bm25, tfidf, jaccard (scores) and vector (score holds distances, which are negated)."""
    parts = []
    for name, w in zip(("bm25", "tfidf", "jaccard", "vector"), profile.weights):
        if w == 0 or name not in channels:
            continue
        x = channels[name].select("frame_id", (-F.col("score") if name == "vector" else F.col("score")).cast("double").alias("score"))
        if profile.normalization == ZSCORE:
            whole = Window.partitionBy()
            x = x.select("frame_id", ((F.col("score") - F.avg("score").over(whole)) / F.greatest(F.stddev_pop("score").over(whole), F.lit(EPS))).alias("score"))
        elif profile.normalization == MINMAX:
            x = min_max(x, 0.0, EPS)
        elif profile.normalization == RRF:
            x = ranked(x).select("frame_id", (F.lit(1.0) / (F.lit(float(profile.rrf_k)) + F.col("pos") + 1.0)).alias("score"))
        parts.append(x.select("frame_id", (F.col("score") * w).alias("score")))
    return _best(_stack(parts).groupBy("frame_id").agg(F.sum("score").alias("score")), k)


def in_range(channel: DataFrame, times: DataFrame, start: int, end: int) -> DataFrame:
    """The rows of a channel whose frame was created from start to end, both included; ranks come afterwards.  times: frame_id, created_at."""
    return channel.join(times.where(F.col("created_at").between(start, end)).select("frame_id"), "frame_id", "left_semi")


def decay(age_seconds: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0)) / F.lit(max(half_life_days * 86400.0, 1.0)))


def half_life(fused: DataFrame, times: DataFrame, now: int, days: float, k: int | None = 10) -> DataFrame:
    """Fused scores times 0.5 to the power of age over half-life."""
    both = fused.join(times.select("frame_id", "created_at"), "frame_id")
    return _best(both.select("frame_id", (F.col("score") * decay(F.lit(now) - F.col("created_at"), days)).alias("score")), k)


def recency_channel(channels: list[DataFrame], times: DataFrame) -> DataFrame:
    """All candidates of the channels as a channel of its own, newest first."""
    some = _stack([x.select("frame_id") for x in channels]).distinct()
    return some.join(times.select("frame_id", "created_at"), "frame_id").select("frame_id", F.col("created_at").cast("double").alias("score"))
