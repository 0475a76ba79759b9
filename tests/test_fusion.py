import math

import pytest

from sparquarry.functions.text import UnsupportedError
from sparquarry.operators import fusion as X
from sparquarry.plans.search import HalfLife, Rrf, RrfChannel, Search, Weighted


def ch(spark, d):
    return spark.createDataFrame(list(d.items()), "frame_id long, score double")


def rows(df):
    return [(r["frame_id"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize("profile, channels, expected", [
    (X.FusionProfile((1, 0, 0, 1)), {"bm25": {4: 2.0, 9: 7.5, 11: 3.0}, "vector": {4: 1.25, 9: 0.5, 11: 2.0}}, [(9, 7.0), (11, 1.0), (4, 0.75)]),
    (X.FusionProfile((1, 0, 0, 0), X.MINMAX), {"bm25": {3: 2.0, 5: 4.0, 8: 12.0, 13: 7.0}}, [(8, 1.0), (13, 0.5), (5, 0.2), (3, 0.0)]),
    (X.FusionProfile((1, 0, 0, 1), X.RRF), {"bm25": {7: 6.0, 2: 4.0, 5: 1.0}, "vector": {5: 0.2, 7: 0.3}}, [(7, 1 / 61 + 1 / 62), (5, 1 / 63 + 1 / 61), (2, 1 / 62)]),
    (X.FusionProfile((0, 0, 0, 1)), {"bm25": {6: 8.0}, "vector": {3: 0.25, 9: 1.5}}, [(3, -0.25), (9, -1.5)]),
    (X.FusionProfile((1, 0, 0, 0), X.MINMAX), {"bm25": {14: 0.5, 21: 0.5, 30: 0.5}}, [(14, 0.0), (21, 0.0), (30, 0.0)]),
])
def test_profiles(spark, profile, channels, expected):
    got = rows(X.fuse(profile, {k: ch(spark, v) for k, v in channels.items()}))
    assert [i for i, _ in got] == [i for i, _ in expected] and [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-6)


def test_zscores_are_finite(spark):
    got = rows(X.fuse(X.FusionProfile((1, 0, 0, 1), X.ZSCORE), {"bm25": ch(spark, {5: 2.0, 6: 2.0, 7: 2.0, 8: -4.0}), "vector": ch(spark, {5: 3.0, 8: 3.0})}))
    assert len(got) == 4 and all(math.isfinite(s) for _, s in got)


def test_profile_checks():
    for bad in ((0, 0, 0, 0), (-1, 0, 0, 1), (math.nan, 0, 0, 1)):
        with pytest.raises(ValueError):
            X.FusionProfile(bad)
    with pytest.raises(ValueError):
        X.FusionProfile((1, 0, 0, 0), X.RRF, 0)


def test_tied_channels_count_half(spark):
    assert rows(X.weighted([ch(spark, {1: 2.0, 2: 2.0})], [1.0])) == [(1, 0.5), (2, 0.5)]


def test_one_channel_gets_reciprocal_ranks(spark):
    assert rows(X.rrf([ch(spark, {5: 9.0, 6: 7.0})])) == [(5, round(1 / 61, 6)), (6, round(1 / 62, 6))]


def test_over_fetch():
    assert X.over_fetch(10, "text") == 100 and X.over_fetch(10, "text", scoped=True) == 1000 and X.over_fetch(1000, "text", scoped=True) == 50_000
    assert X.over_fetch(10, "vector") == 50 and X.over_fetch(20, "vector", ranged=True) == 160


def test_search_is_checked():
    with pytest.raises(ValueError, match="no channels"):
        Search().check()
    with pytest.raises(UnsupportedError):
        Search().text("body", "x").fuse(Weighted()).recency(RrfChannel(30)).check()
    s = Search().text("body", "a").text("body", "b").fuse(Rrf(10)).recency(HalfLife(3)).top_k(4)
    assert s.text_channel.query == "b" and s.k == 4
