import math

import pytest

from sparquarry.functions.text import Analyzer, UnsupportedError
from sparquarry.operators.index import TextIndex
from sparquarry.operators.scorers import Scorer, approximate_search, register_scorer, search, water_fill

RAW = Analyzer.raw()


def index(spark, docs, dead=()):
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "frame_id long, text string")
    return TextIndex.build(df, RAW, tombstones=spark.createDataFrame([(d,) for d in dead], "frame_id long") if dead else None)


def hits(x, query, scorer, k=10):
    return [(r["frame_id"], r["score"]) for r in search(x, {0: query.split()}, scorer, k).orderBy("rank").collect()]


@pytest.mark.parametrize("name, docs, query, expected", [
    ("jaccard", {4: "oak elm ash", 6: "oak fir", 7: "yew", 9: "elm oak ash fir yew"}, "oak elm fir", [(6, 2 / 3), (9, 3 / 5), (4, 2 / 4)]),
    ("dice", {4: "oak elm ash", 6: "oak fir fir"}, "oak elm fir", [(6, 4 / 5), (4, 4 / 6)]),
    ("overlap", {4: "oak elm ash yew", 6: "fir ash", 8: "yew"}, "oak yew fir", [(8, 1.0), (4, 2 / 3), (6, 1 / 2)]),
    ("containment", {4: "oak ash yew", 6: "oak elm fir ash"}, "oak elm fir yew", [(6, 3 / 4), (4, 2 / 4)]),
    ("tfidf_cosine", {5: "oak fir yew", 6: "elm"}, "yew oak fir", [(5, 1.0)]),
    ("count_cosine", {5: "oak oak oak fir", 6: "fir yew"}, "oak fir", [(5, 4 / 20**0.5), (6, 1 / 2)]),
])
def test_hand_computed(spark, name, docs, query, expected):
    got = hits(index(spark, docs), query, Scorer(name))
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-4)


def test_bm25_orders(spark):
    # ln(1 + (N - df + 0.5) / (df + 0.5)) * 2.2 tf / (tf + 1.2 (0.25 + 0.75 dl / avgdl)), by hand: N 4, avgdl 3
    docs = {11: "oak oak elm", 12: "oak fir fir yew ash", 13: "elm yew", 14: "ash ash"}
    idf = math.log(1 + 2.5 / 2.5)
    room = {11: 1.2 * (0.25 + 0.75 * 3 / 3), 12: 1.2 * (0.25 + 0.75 * 5 / 3), 13: 1.2 * (0.25 + 0.75 * 2 / 3)}
    got = dict(hits(index(spark, docs), "oak", Scorer("bm25")))
    assert got == pytest.approx({11: idf * 2.2 * 2 / (2 + room[11]), 12: idf * 2.2 / (1 + room[12])}, abs=1e-6)
    both = hits(index(spark, docs), "oak elm", Scorer("bm25"))
    assert [i for i, _ in both] == [11, 13, 12] and dict(both)[13] == pytest.approx(idf * 2.2 / (1 + room[13]), abs=1e-6)
    more = {30 + n: " ".join(["oak"] * n + ["elm"]) for n in (3, 1, 6)}
    assert [i for i, _ in hits(index(spark, more), "oak", Scorer("bm25"), 1)] == [36]


def test_bm25_keeps_negative_scores_of_tombstoned_corpora(spark):
    docs = {i: "yew " + "oak " * (i % 3) for i in range(20, 26)}
    got = hits(index(spark, docs, dead=[20, 22, 23, 25]), "yew", Scorer("bm25"))
    assert {i for i, _ in got} == {21, 24} and all(s < 0 for _, s in got)


def test_small_scores_and_near_ties_keep_their_order(spark):
    docs = {i: " ".join(["oak"] * 3 + ["fir"] * (200_000 - i)) for i in (1, 2)} | {9: "fir"}
    got = hits(index(spark, docs), "oak", Scorer("count_cosine"))
    assert [i for i, _ in got] == [2, 1] and got[0][1] > got[1][1] > 0 and got[0][1] - got[1][1] < 1e-8


def test_tf_modes(spark):
    x = index(spark, {5: " ".join(["oak"] * 6), 8: "oak oak oak fir"})
    raw, log = (dict(hits(x, "oak", Scorer("tfidf", tf=m))) for m in ("raw", "log"))
    assert raw[5] / raw[8] == pytest.approx(2) and log[5] / log[8] == pytest.approx((1 + math.log(6)) / (1 + math.log(3)))


def test_index_is_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ships' captains were sailing"), (2, "the ship sails"), (3, None)], "frame_id long, text string")
    TextIndex.build(docs, Analyzer.english()).write(str(tmp_path / "x"))
    x = TextIndex.read(spark, str(tmp_path / "x"), Analyzer.english())
    expected = {(t, i) for i, text in ((1, "Ships' captains were sailing"), (2, "the ship sails")) for t in Analyzer.english().analyze(text)}
    assert {(r["term"], r["frame_id"]) for r in x.postings.collect()} == expected
    assert {(r["frame_id"], r["total_terms"]) for r in x.doc_stats.collect()} == {(i, sum(f == i for _, f in expected)) for i in (1, 2, 3)}
    assert "PushedFilters: [In(term" in x.of_terms(type("T", (), {"given": ["ship", "sail"]})())._jdf.queryExecution().toString()


def test_errors():
    for bad, words in (({"b": 1.5}, "b must be"), ({"k1": -1.0}, "k1 must be")):
        with pytest.raises(ValueError, match=words):
            Scorer("bm25", **bad)
    with pytest.raises(UnsupportedError):
        Scorer("jaccard_weighted")


def test_unknown_terms_and_empty_queries(spark):
    x = index(spark, {1: "alpha beta", 2: ""})
    assert hits(x, "zz", Scorer("bm25")) == [] and hits(x, "", Scorer("jaccard")) == []
    assert hits(x, "alpha zz", Scorer("containment")) == [(1, 1.0)]


def test_water_fill():
    assert water_fill({"a": 10, "b": 1}, 100, 8) == {"b": 1, "a": 7}
    assert sum(water_fill({"a": 5, "b": 5, "c": 5}, 10, 6).values()) == 6


def test_votes_then_exact_scores(spark):
    docs = {i: " ".join(["alpha"] * (i % 7 + 1) + ["beta"] * (i % 3)) for i in range(1, 60)}
    x = index(spark, docs)
    approx = [(r["frame_id"], r["score"]) for r in approximate_search(x, "alpha beta", Scorer("bm25"), 5, 1000).collect()]
    assert approx == hits(x, "alpha beta", Scorer("bm25"), 5)


def test_own_scorer(spark):
    from pyspark.sql import functions as F

    register_scorer("matches", lambda x, t, s: x.postings.join(t, "term").groupBy("query_id", "frame_id").agg(F.count("*").cast("double").alias("score")))
    assert hits(index(spark, {1: "a b", 2: "b"}), "a b", Scorer("matches")) == [(1, 2.0), (2, 1.0)]
