import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparquarry.functions.text import UnsupportedError
from sparquarry.operators import evaluate, versions
from sparquarry.operators.partitions import CUSTOM, Partitioning, TimeWindow, forgotten, members, route, view

DAY = 86_400


@pytest.mark.parametrize("day", ["1970-01-01", "2000-02-29", "2026-05-25", "1969-12-31", "2024-12-31"])
def test_civil_dates(spark, day):
    seconds = (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days * DAY
    parts = Partitioning("mem")
    row = spark.createDataFrame([(seconds + 7,)], "created_at long").select(parts.name(F.col("created_at")).alias("c"))
    row = row.select("c", *[b.alias(n) for b, n in zip(parts.bounds(F.col("c")), ("s", "e"))]).first()
    assert (row["c"], row["s"], row["e"]) == (f"mem:{day}", seconds, seconds + DAY)


def test_windows_touch_half_open_periods(spark):
    rows = route(spark.createDataFrame([(i, i * DAY) for i in range(6)], "frame_id long, created_at long"), Partitioning("mem"))
    got = view(rows, Partitioning("mem"), TimeWindow.last_days(2, 5 * DAY + 50_000))
    assert sorted(r["collection"] for r in got.collect()) == ["mem:1970-01-04", "mem:1970-01-05", "mem:1970-01-06"]
    assert members(rows, Partitioning("mem"), TimeWindow.range(DAY, 4 * DAY - 1)).count() == 3
    assert forgotten(rows, Partitioning("mem"), 2 * DAY).count() == 2
    with pytest.raises(UnsupportedError):
        forgotten(rows, Partitioning("mem", CUSTOM, F.lit("x")), 5)
    month = Partitioning("m", "month")
    assert {r[0] for r in rows.select(month.name(F.col("created_at"))).collect()} == {"m:1970-01"}


def test_versions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, v int, t string")
    assert sorted(tuple(r) for r in versions.latest_by_key(rows, "k", "v").collect()) == [("a", 2, None), ("b", 1, "y")]
    assert [r["t"] for r in versions.get_many(rows.where("v = 1"), ["b", "zz", "a"], "k").collect()] == ["y", None, "x"]
    empty = rows.where("false")
    assert versions.latest_by_key(empty, "k", "v").collect() == []
    frames = spark.createDataFrame([(1, None, 5), (2, 1, 6), (3, 9, 4)], "frame_id long, parent_frame_id long, created_at long")
    assert [r["frame_id"] for r in versions.orphans(frames).collect()] == [3] and [r["frame_id"] for r in versions.out_of_order(frames).collect()] == [3]
    dead = spark.createDataFrame([(1,)], "frame_id long")
    assert {(r["frame_id"], r["parent_frame_id"]) for r in versions.reparented(frames, dead).collect()} == {(2, None), (3, 9)}


def test_measures(spark):
    run = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id long, rank int, doc string")
    qrels = spark.createDataFrame([(1, "b", 1), (1, "c", 1), (1, "z", 1), (2, "q", 1)], "query_id long, doc string, rel int")
    one = lambda df: {r[0]: r[1] for r in df.collect()}
    assert one(evaluate.average_precision(run, qrels)) == pytest.approx({1: (1 / 2 + 2 / 3) / 3, 2: 0.0})
    assert one(evaluate.reciprocal_rank(run, qrels)) == {1: 0.5, 2: 0.0} and one(evaluate.recall_of_relevant(run, qrels, 3)) == pytest.approx({1: 2 / 3, 2: 0.0})
    assert one(evaluate.recall_at(run, run, 2)) == {1: 1.0} and one(evaluate.ndcg_at(run, qrels, 10))[1] == pytest.approx((0.63093 + 0.5) / (1 + 0.63093 + 0.5), abs=1e-4)
    assert evaluate.cheapest_budget({10: [0.5, 0.6], 20: [0.95, 0.95], 40: [1.0, 1.0]}, 0.95) == 20 and evaluate.cheapest_budget({10: [0.1]}, 0.9) is None
