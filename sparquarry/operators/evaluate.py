"""Retrieval quality: recall, nDCG, average precision, reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(run: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of the first k true ids that are among the first k found.  Both: query_id, rank, doc."""
    want = truth.where(F.col("rank") <= k).select("query_id", "doc")
    got = run.where(F.col("rank") <= k).select("query_id", "doc", F.lit(1.0).alias("hit"))
    return want.join(got, ["query_id", "doc"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0.0))) / F.count(F.lit(1))).alias("recall"))


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels.select("query_id", "doc", "rel"), ["query_id", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ndcg_at(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg for every query of qrels with a relevant document."""
    gain = F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0))
    got = _judged(run.where(F.col("rank") <= k), qrels).groupBy("query_id").agg(gain.alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc")
    best = qrels.where("rel > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(gain.alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, ap for every query of qrels with a relevant document."""
    # a relevant document that occurs twice counts twice, one after the other
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (F.col("rel") > 0).cast("int")
    seen = _judged(run, qrels).withColumn("p", F.sum(hit).over(order) / F.col("rank") * hit)
    total = qrels.where("rel > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return total.join(seen.groupBy("query_id").agg(F.sum("p").alias("p")), "query_id", "left").select("query_id", (F.coalesce("p", F.lit(0.0)) / F.col("n")).alias("ap"))


def reciprocal_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, rr for every query of qrels with a relevant document."""
    first = _judged(run, qrels).where("rel > 0").groupBy("query_id").agg(F.min("rank").alias("r"))
    all_ = qrels.where("rel > 0").select("query_id").distinct()
    return all_.join(first, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("rr"))


def recall_of_relevant(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of relevant documents among the first k."""
    got = _judged(run.where(F.col("rank") <= k), qrels).groupBy("query_id").agg(F.sum((F.col("rel") > 0).cast("double")).alias("h"))
    total = qrels.where("rel > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return total.join(got, "query_id", "left").select("query_id", (F.coalesce("h", F.lit(0.0)) / F.col("n")).alias("recall"))


def cheapest_budget(overlaps: dict[int, list[float]], target: float) -> int | None:
    """The smallest candidate budget whose mean overlap, plus two standard errors or 0.001, reaches the target."""
    import statistics

    for budget in sorted(overlaps):
        xs = overlaps[budget]
        sigma = statistics.pstdev(xs) / len(xs) ** 0.5 if len(xs) > 1 else 0.0
        if statistics.fmean(xs) + max(0.001, 2 * sigma) >= target:
            return budget
    return None
