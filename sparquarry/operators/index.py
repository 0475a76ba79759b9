"""The statistics every lexical scorer reads: postings, document statistics, term dictionary."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer, normalise, stem_column


#: Given terms that are written into a filter at most.
GIVEN = 10_000


@dataclasses.dataclass(frozen=True)
class CorpusStats:
    n_docs: int
    total_terms: int

    @property
    def avgdl(self) -> float:
        return self.total_terms / self.n_docs if self.n_docs else 0.0


class TextIndex:
    """postings (term, frame_id, tf), doc_stats (frame_id, total_terms, unique_terms), and tombstones (frame_id) or None.

    Tombstoned frames leave N and the average length at once, document frequencies only when the index is rebuilt.
    """

    def __init__(self, postings: DataFrame, doc_stats: DataFrame, analyzer: Analyzer, tombstones: DataFrame | None = None):
        self.postings, self.doc_stats, self.analyzer, self.tombstones = postings, doc_stats, analyzer, tombstones

    @classmethod
    def build(cls, docs: DataFrame, analyzer: Analyzer, frame_id: str = "frame_id", text: str = "text", tombstones: DataFrame | None = None) -> TextIndex:
        """One pass over texts; terms are counted within each frame with map-side combine.  Stems are made of distinct terms."""
        if analyzer.stemmer and not analyzer.fold_accents:
            return cls._stemmed(docs, analyzer, F.col(frame_id), F.col(text), tombstones)
        tokens = docs.select(F.col(frame_id).alias("frame_id"), analyzer.tokens(F.col(text)).alias("tokens"))
        postings = tokens.select("frame_id", F.explode("tokens").alias("term")).groupBy("term", "frame_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        stats = tokens.select("frame_id", F.size("tokens").alias("total_terms"), F.size(F.array_distinct("tokens")).alias("unique_terms"))
        return cls(postings, stats, analyzer, tombstones)

    @classmethod
    def _stemmed(cls, docs: DataFrame, analyzer: Analyzer, frame_id: Column, text: Column, tombstones: DataFrame | None) -> TextIndex:
        plain = dataclasses.replace(analyzer, form=None, stemmer=None, min_length=0, max_length=0)
        tokens = docs.select(frame_id.alias("frame_id"), plain.tokens(normalise(text, analyzer.form) if analyzer.form else text).alias("tokens"))
        words = tokens.select("frame_id", F.explode("tokens").alias("word")).groupBy("word", "frame_id").agg(F.count(F.lit(1)).alias("n"))
        stems = words.select("word").distinct().withColumn("term", stem_column(F.col("word"))).where((F.col("term") != "") & analyzer.fits(F.char_length("term")))
        postings = words.join(stems, "word").groupBy("term", "frame_id").agg(F.sum("n").cast("int").alias("tf"))
        sizes = postings.groupBy("frame_id").agg(F.sum("tf").cast("int").alias("total_terms"), F.count(F.lit(1)).cast("int").alias("unique_terms"))
        stats = docs.select(frame_id.alias("frame_id")).join(sizes, "frame_id", "left").fillna(0, ["total_terms", "unique_terms"])
        return cls(postings, stats, analyzer, tombstones)

    def write(self, path: str) -> None:
        """Postings in ranges of terms, sorted, so that a filter on terms reads few row groups; statistics beside them.

        Statistics come from the written postings, so rows with the same frame id are one frame in both; those without an id are one, too.
        """
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "frame_id").write.parquet(f"{path}/postings")
        count = lambda c, name: F.coalesce(c, F.lit(0)).cast("int").alias(name)
        sizes = self.postings.sparkSession.read.parquet(f"{path}/postings").groupBy("frame_id").agg(F.sum("tf").alias("t"), F.count(F.lit(1)).alias("u")).withColumnRenamed("frame_id", "id")
        frames = self.doc_stats.select("frame_id").distinct()
        frames.join(sizes, F.col("frame_id").eqNullSafe(F.col("id")), "left").select("frame_id", count(F.col("t"), "total_terms"), count(F.col("u"), "unique_terms")).write.parquet(f"{path}/doc_stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str, analyzer: Analyzer, tombstones: DataFrame | None = None) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats"), analyzer, tombstones)

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """The postings of the terms of a table; by a filter at the scan where the terms are given ones."""
        words = getattr(terms, "given", None)
        if words is not None and len(words) <= GIVEN:
            return self.postings.where(F.col("term").isin(words)) if words else self.postings.limit(0)
        return self.postings.join(terms.select("term").distinct(), "term", "left_semi")

    def with_tombstones(self, tombstones: DataFrame) -> TextIndex:
        return TextIndex(self.postings, self.doc_stats, self.analyzer, tombstones)

    def cache(self) -> TextIndex:
        return TextIndex(self.postings.cache(), self.doc_stats.cache(), self.analyzer, self.tombstones)

    def active(self, frames: DataFrame) -> DataFrame:
        return frames if self.tombstones is None else frames.join(self.tombstones.select("frame_id"), "frame_id", "left_anti")

    @functools.cached_property
    def stats(self) -> CorpusStats:
        """Frames with at least one token that aren't tombstoned, and their tokens."""
        row = self.active(self.doc_stats).where("total_terms > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total_terms"), F.lit(0)).alias("t")).first()
        return CorpusStats(row["n"], row["t"])

    def term_dictionary(self) -> DataFrame:
        """term, df, cf; df counts all indexed frames."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def impact_postings(self) -> DataFrame:
        """Postings with their place when a term's postings stand by falling tf, then frame."""
        order = Window.partitionBy("term").orderBy(F.desc("tf"), "frame_id")
        return self.postings.withColumn("impact_rank", F.row_number().over(order))
