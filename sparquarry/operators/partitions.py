"""Time partitions of a collection: routing, windows, views, retention."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UnsupportedError

DAY, MONTH, CUSTOM = "day", "month", "custom"
SECONDS = 86_400


@dataclasses.dataclass(frozen=True)
class Partitioning:
    """kind: DAY, MONTH or CUSTOM; a custom route is a column expression or a function of a DataFrame's columns."""

    base: str
    kind: str = DAY
    custom: Column | Callable[[], Column] | None = None

    def period(self, created_at: Column) -> Column:
        if self.kind == CUSTOM:
            return self.custom() if callable(self.custom) else self.custom
        day = F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(created_at / F.lit(SECONDS)).cast("int"))
        return F.date_format(day, "yyyy-MM-dd" if self.kind == DAY else "yyyy-MM")

    def name(self, created_at: Column) -> Column:
        return F.concat(F.lit(self.base + ":"), self.period(created_at))

    def bounds(self, name: Column) -> tuple[Column, Column]:
        """Start and end (not included) of a partition, in seconds, from its name."""
        if self.kind == CUSTOM:
            raise UnsupportedError("custom partitions have no bounds")
        text = F.substring(name, len(self.base) + 2, 10)
        first = F.to_date(text if self.kind == DAY else F.concat(text, F.lit("-01")))
        after = F.date_add(first, 1) if self.kind == DAY else F.add_months(first, 1)
        return F.unix_date(first).cast("long") * SECONDS, F.unix_date(after).cast("long") * SECONDS


def route(rows: DataFrame, parts: Partitioning, created_at: str = "created_at") -> DataFrame:
    """Adds collection, the partition that a row belongs to."""
    return rows.withColumn("collection", parts.name(F.col(created_at)))


@dataclasses.dataclass(frozen=True)
class TimeWindow:
    """All times, the last days before now, a closed range, or named partitions."""

    start: int | None = None
    end: int | None = None
    names: tuple[str, ...] | None = None

    @classmethod
    def all(cls) -> TimeWindow:
        return cls()

    @classmethod
    def last_days(cls, n: int, now: int) -> TimeWindow:
        return cls(now - n * SECONDS, now)

    @classmethod
    def range(cls, start: int, end: int) -> TimeWindow:
        return cls(start, end)

    @classmethod
    def partitions(cls, names: list[str]) -> TimeWindow:
        return cls(names=tuple(names))


def members(collections: DataFrame, parts: Partitioning, window: TimeWindow) -> DataFrame:
    """The partitions (collection) of the base that the window touches: a half-open period meets a closed window."""
    own = collections.select("collection").distinct().where(F.col("collection").startswith(parts.base + ":"))
    if window.names is not None:
        return own.where(F.col("collection").isin(list(window.names)))
    if window.start is None:
        return own
    start, end = parts.bounds(F.col("collection"))
    return own.where((end > window.start) & (start <= window.end))


def view(rows: DataFrame, parts: Partitioning, window: TimeWindow) -> DataFrame:
    """The rows of the partitions that the window touches; a predicate on collection alone, so partitions are pruned."""
    if window.names is not None:
        return rows.where(F.col("collection").isin(list(window.names)))
    base = F.col("collection").startswith(parts.base + ":")
    if window.start is None:
        return rows.where(base)
    start, end = parts.bounds(F.col("collection"))
    return rows.where(base & (end > window.start) & (start <= window.end))


def forgotten(rows: DataFrame, parts: Partitioning, cutoff: int) -> DataFrame:
    """The rows of the partitions that have ended by cutoff."""
    _, end = parts.bounds(F.col("collection"))
    return rows.where(F.col("collection").startswith(parts.base + ":") & (end <= cutoff))


def time_range(rows: DataFrame, start: int, end: int, collection: str | None = None) -> DataFrame:
    """Rows created from start to end, both included, by time and frame."""
    out = rows.where(F.col("created_at").between(start, end))
    out = out if collection is None else out.where(F.col("collection") == collection)
    return out.orderBy("created_at", "frame_id")
