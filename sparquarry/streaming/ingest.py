"""Streams into a store: each micro-batch becomes one commit; late rows go to their own period."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.schema import Record
from ..plans.store import Store


def record_of(row) -> Record:
    return Record(row["key"], {"body": row["text"]}, row["created_at"])


def ingest(stream: DataFrame, store: Store, base: str, checkpoint: str, record: Callable = record_of, available_now: bool = True) -> StreamingQuery:
    """Puts the rows of a stream (key, text, created_at) into the partitions of a base.

    A micro-batch is one generation, so its rows become visible together.  Batches
    carry their number in the manifest's collection of batches; one that comes again
    after a failure is skipped.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.refresh()
        if number <= store.manifest["bases"].get(base, {}).get("batch", -1):
            return
        with store.writer() as w:
            for row in batch.orderBy("created_at").toLocalIterator():
                w.put_into(base, record(row))
            spec = store.manifest["bases"] | store.declared.get("bases", {})
            store.declared.setdefault("bases", {})[base] = spec[base] | {"batch": number}
            w.commit()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; windows close when the watermark passes them."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
