"""Lexical scorers over a TextIndex.

Every scorer takes queries as {query id: text or tokens} and scores all of them in
one plan: query terms meet postings in one join and scores add up per (query,
frame) with map-side combine.  Given terms are a filter at the scan of postings and
a local table in the join; terms of queries that are rows themselves are joined.
Frames rank by their exact scores; digits rounds them first where a caller asks.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UnsupportedError
from .index import TextIndex

BM25_DEFAULT_TOP, POOL = 1024, 4
RAW, LOG = "raw", "log"


@dataclasses.dataclass(frozen=True)
class Scorer:
    """name: a key of SCORERS; the other fields as the scorer reads them."""

    name: str
    k1: float = 1.2
    b: float = 0.75
    tf: str = RAW
    norm: str | None = None

    def __post_init__(self):
        if self.name in ("jaccard_weighted", "jaccard_shingles"):
            raise UnsupportedError(f"{self.name} is reserved")
        if self.name not in SCORERS:
            raise ValueError(f"unknown scorer {self.name}")
        if not (math.isfinite(self.k1) and self.k1 >= 0):
            raise ValueError("k1 must be finite and at least 0")
        if not 0 <= self.b <= 1:
            raise ValueError("b must be between 0 and 1")
        if self.tf not in (RAW, LOG) or self.norm not in (None, "l2"):
            raise ValueError("unknown tf mode or norm")


def tf_weight(tf: Column, mode: str) -> Column:
    tf = tf.cast("double")
    return tf if mode == RAW else F.lit(1.0) + F.ln(tf)


def query_terms(index: TextIndex, queries: dict) -> DataFrame:
    """query_id, term, qf."""
    spark, rows = index.postings.sparkSession, []
    for qid, q in queries.items():
        counts = Counter(index.analyzer.analyze(q) if isinstance(q, str) else q)
        rows += [(int(qid), t, n) for t, n in counts.items()]
    out = spark.createDataFrame(rows, "query_id long, term string, qf int")
    out.given = sorted({t for _, t, _ in rows})
    return out


def document_terms(index: TextIndex, queries: DataFrame, text: str = "text", query_id: str = "query_id") -> DataFrame:
    """query_id, term, qf of queries that are rows themselves; any number of them."""
    tokens = queries.select(F.col(query_id).alias("query_id"), F.explode(index.analyzer.tokens(F.col(text))).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("int").alias("qf"))


def _hits(index: TextIndex, terms: DataFrame) -> DataFrame:
    """query_id, term, qf, frame_id, tf, df for terms of the dictionary."""
    postings = index.of_terms(terms)
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = terms.join(df, "term")
    return index.active(postings).join(known, "term")


def _idf(index: TextIndex) -> Column:
    return F.ln(F.lit(1.0) + F.lit(float(index.stats.n_docs)) / F.col("df"))


def _query_side(index: TextIndex, terms: DataFrame, weight: Column) -> DataFrame:
    """query_id, qnorm: over the query's terms that the dictionary has."""
    df = index.of_terms(terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.join(df, "term").withColumn("w", weight).groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qnorm"), F.count(F.lit(1)).alias("qn"))


def doc_norms(index: TextIndex, mode: str, idf: bool) -> DataFrame:
    """frame_id, dnorm over all terms of the frame."""
    w = tf_weight(F.col("tf"), mode)
    if not idf:
        return index.postings.groupBy("frame_id").agg(F.sqrt(F.sum(w * w)).alias("dnorm"))
    weighted = index.postings.join(index.term_dictionary().select("term", "df"), "term").withColumn("w", w * _idf(index))
    return weighted.groupBy("frame_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dnorm"))


def _bm25(index: TextIndex, terms: DataFrame, s: Scorer) -> DataFrame:
    n, avgdl = float(index.stats.n_docs), index.stats.avgdl or 1.0
    idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    room = F.lit(s.k1) * (F.lit(1.0 - s.b) + F.lit(s.b) * F.col("total_terms") / F.lit(avgdl))
    # an idf of N far below df may have no logarithm; such a term gives nothing
    part = F.col("qf") * F.coalesce(idf, F.lit(0.0)) * F.lit(s.k1 + 1.0) * F.col("tf") / (F.col("tf") + room)
    return _hits(index, terms).join(index.doc_stats.select("frame_id", "total_terms"), "frame_id").groupBy("query_id", "frame_id").agg(F.sum(part).alias("score"))


def _tfidf(index: TextIndex, terms: DataFrame, s: Scorer) -> DataFrame:
    part = tf_weight(F.col("tf"), s.tf) * _idf(index)
    sums = _hits(index, terms).groupBy("query_id", "frame_id").agg(F.sum(part).alias("score"))
    if s.norm is None:
        return sums
    return sums.join(doc_norms(index, s.tf, True), "frame_id").withColumn("score", F.col("score") / F.col("dnorm")).drop("dnorm")


def _cosine(index: TextIndex, terms: DataFrame, s: Scorer, idf: bool, exact: bool) -> DataFrame:
    i = _idf(index) if idf else F.lit(1.0)
    qw, dw = tf_weight(F.col("qf"), s.tf) * i, tf_weight(F.col("tf"), s.tf) * i
    sums = _hits(index, terms).groupBy("query_id", "frame_id").agg(F.sum(qw * dw).alias("dot"))
    norms = doc_norms(index, s.tf, idf) if exact else index.doc_stats.select("frame_id", F.sqrt(F.col("total_terms").cast("double")).alias("dnorm"))
    q = _query_side(index, terms, qw)
    both = sums.join(norms, "frame_id").join(q, "query_id")
    return both.select("query_id", "frame_id", (F.col("dot") / (F.col("qnorm") * F.col("dnorm"))).alias("score"))


def _sets(measure: Callable[[Column, Column, Column], Column]):
    def score(index: TextIndex, terms: DataFrame, s: Scorer) -> DataFrame:
        sums = _hits(index, terms).groupBy("query_id", "frame_id").agg(F.count(F.lit(1)).cast("double").alias("i"))
        q = _query_side(index, terms, F.lit(1.0))
        both = sums.join(index.doc_stats.select("frame_id", "unique_terms"), "frame_id").join(q, "query_id")
        return both.select("query_id", "frame_id", measure(F.col("i"), F.col("qn"), F.col("unique_terms")).alias("score"))

    return score


SCORERS: dict[str, Callable[[TextIndex, DataFrame, Scorer], DataFrame]] = {
    "bm25": _bm25,
    "tfidf": _tfidf,
    "tfidf_cosine": lambda x, t, s: _cosine(x, t, s, True, True),
    "tfidf_cosine_approx": lambda x, t, s: _cosine(x, t, s, True, False),
    "count_cosine": lambda x, t, s: _cosine(x, t, dataclasses.replace(s, tf=RAW), False, True),
    "count_cosine_approx": lambda x, t, s: _cosine(x, t, dataclasses.replace(s, tf=RAW), False, False),
    "jaccard": _sets(lambda i, q, d: i / (q + d - i)),
    "dice": _sets(lambda i, q, d: 2 * i / (q + d)),
    "overlap": _sets(lambda i, q, d: i / F.least(q, d)),
    "containment": _sets(lambda i, q, d: i / q),
}


def register_scorer(name: str, score: Callable[[TextIndex, DataFrame, Scorer], DataFrame]) -> None:
    """Adds a scorer: (index, query terms, Scorer) -> query_id, frame_id, score."""
    SCORERS[name] = score


def top(scores: DataFrame, k: int | None, digits: int | None = None) -> DataFrame:
    """The k best frames of each query by score, then frame; zeros drop out, negative scores stay."""
    kept = scores.where(F.col("score") != 0) if digits is None else scores.withColumn("score", F.round("score", digits)).where(F.col("score") != 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "frame_id")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "frame_id", "score")


def search(index: TextIndex, queries: dict | DataFrame, scorer: Scorer, k: int | None = 10, scope: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """query_id, rank, frame_id, score.  queries: texts or tokens by id, or rows of document_terms().  scope: frame_id."""
    terms = query_terms(index, queries) if isinstance(queries, dict) else queries
    scores = SCORERS[scorer.name](index, terms, scorer)
    if scope is not None:
        scores = scores.join(scope.select("frame_id"), "frame_id", "left_semi")
    return top(scores, BM25_DEFAULT_TOP if k is None and scorer.name == "bm25" else k, digits)


def water_fill(df: dict[str, int], n_docs: int, budget: int) -> dict[str, int]:
    """How many postings of each term to read: by falling idf, in proportion to idf, at most df, what is left flowing on."""
    idf = {t: math.log(1 + n_docs / d) for t, d in df.items()}
    rest, weight, out = budget, sum(idf.values()), {}
    order = sorted(df, key=lambda t: (-idf[t], t))
    for i, t in enumerate(order):
        share = idf[t] / weight if weight > 0 else 1 / (len(order) - i)
        out[t] = max(0, min(round(share * rest), df[t], rest))
        rest -= out[t]
        weight -= idf[t]
    return out


def approximate_search(index: TextIndex, query, scorer: Scorer, k: int, channel_k: int, digits: int | None = None) -> DataFrame:
    """Votes from the best postings of each term choose a pool of 4 k frames, which is then scored exactly."""
    terms = query_terms(index, {0: query})
    wanted = [r[0] for r in terms.select("term").distinct().collect()]
    found = index.postings.where(F.col("term").isin(wanted)) if wanted else index.postings.limit(0)
    df = {r[0]: r[1] for r in found.groupBy("term").count().collect()}
    budget = water_fill(df, index.stats.n_docs, channel_k * max(1, len(df)))
    if not budget:
        return top(SCORERS[scorer.name](index, terms, scorer), k, digits)
    limits = found.sparkSession.createDataFrame(list(budget.items()), "term string, most int")
    order = Window.partitionBy("term").orderBy(F.desc("tf"), "frame_id")
    read = index.active(found).withColumn("r", F.row_number().over(order)).join(F.broadcast(limits), "term").where("r <= most")
    votes = SCORERS[scorer.name](TextIndexView(index, read.select("term", "frame_id", "tf"), df), terms, scorer)
    pool = top(votes, POOL * k).select("frame_id")
    exact = SCORERS[scorer.name](index, terms, scorer).join(F.broadcast(pool), "frame_id", "left_semi")
    return top(exact, k, digits)


class TextIndexView(TextIndex):
    """An index read through some of its postings; statistics stay those of the whole index."""

    def __init__(self, index: TextIndex, postings: DataFrame, df: dict[str, int]):
        super().__init__(postings, index.doc_stats, index.analyzer, None)
        self.whole = index

    @property
    def stats(self):
        return self.whole.stats

    def term_dictionary(self) -> DataFrame:
        return self.whole.term_dictionary()
