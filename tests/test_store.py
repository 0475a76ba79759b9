import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquarry.cli import main
from sparquarry.functions.text import Analyzer, UnsupportedError
from sparquarry.operators.fusion import FusionProfile
from sparquarry.operators.partitions import TimeWindow
from sparquarry.operators.scorers import Scorer
from sparquarry.plans.schema import Busy, NotCalibrated, Record, Schema, SchemaMismatch, StoreError, decode_key, encode_key
from sparquarry.plans.search import HalfLife, Range, Rrf, RrfChannel, Search, Weighted
from sparquarry.plans.store import Loader, Store
from sparquarry.sources import formats

DAY = 86_400
TEXT = Schema().text("body", Analyzer())
BOTH = TEXT.vector("dense", 64)


def unit(seed):
    x = np.random.default_rng(seed).normal(size=64)
    return (x / np.linalg.norm(x)).astype(np.float32).tolist()


def keys(hits):
    return [decode_key(h["key"]) for h in hits.orderBy("rank").collect()]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def put(store, name, rows, schema=TEXT):
    store.collection(name, schema)
    with store.writer() as w:
        for r in rows:
            w.put(name, r)
        return w.commit()


def test_keys_of_kinds_never_collide():
    raw = [encode_key(k) for k in ("1", 1, b"1")]
    assert len(set(raw)) == 3 and [decode_key(r) for r in raw] == ["1", 1, b"1"]
    for bad in (True, -1, 1.5, None):
        with pytest.raises(TypeError):
            encode_key(bad)


def test_upsert_delete_and_lookups(store):
    put(store, "c", [Record("a", {"body": "first version"}, 1), Record("b", {"body": ""}, 2)])
    put(store, "c", [Record("a", {"body": "second version"}, 3)])
    snap = store.reader()
    assert snap.get("c", "a")["text"] == "second version" and snap.get("c", "b")["text"] is None and snap.get("c", "zz") is None
    assert [x and x["key"] for x in snap.get_many("c", ["b", "zz", "a", "b"])] == ["b", None, "a", "b"]
    with pytest.raises(StoreError):
        snap.get("unknown", "a")
    with store.writer() as w:
        assert w.delete("c", "a") and not w.delete("c", "zz")
        w.commit()
    assert store.reader().get("c", "a") is None and snap.get("c", "a") is not None  # a reader keeps its generation
    assert sorted(store.reader().keys("c")) == ["b"] and store.reader().stats()["tombstone_ratio"] == pytest.approx(2 / 3)
    assert store.reader().needs_compaction(2 / 3)


def test_leaving_without_commit_drops_what_is_staged(store):
    store.collection("c", TEXT)
    with store.writer() as w:
        w.put("c", Record("a", {"body": "x"}))
    assert store.reader().collections() == []
    with store.writer() as w:
        assert w.commit()["changed"] and not w.commit()["changed"]
    assert Store(store.spark, store.root, create=False).reader().collections() == ["c"]


def test_schemas_only_grow(store):
    put(store, "c", [Record("a", {"body": "x"}, 1)])
    store.collection("c", BOTH)
    with pytest.raises(SchemaMismatch, match="body"):
        store.collection("c", Schema().text("body", Analyzer.english()))
    for bad in (lambda: TEXT.text("more"), lambda: Schema().vector("v", 65), lambda: Schema().text("~x"), lambda: BOTH.vector("dense", 64)):
        with pytest.raises(StoreError):
            bad()
    assert Schema.from_json(json.loads(json.dumps(BOTH.to_json()))) == BOTH and Schema.from_json({"version": 9}) is None


def test_records_are_checked(store):
    store.collection("c", BOTH)
    with store.writer() as w:
        for fields, words in (({"nope": "x"}, "unknown field"), ({"body": [1.0]}, "takes text"), ({"dense": "x"}, "takes a vector"), ({"dense": [1.0]}, "components"), ({"dense": [float("nan")] * 64}, "not finite")):
            with pytest.raises(StoreError, match=words):
                w.put("c", Record("a", fields))
        with pytest.raises(StoreError, match="parent"):
            w.put("c", Record("a", {"body": "x"}, parent="none"))
        with pytest.raises(TypeError):
            w.put_many("c", ["a"], np.zeros((1, 64)))
        with pytest.raises(ValueError):
            w.put_many("c", ["a"], np.zeros((2, 64), np.float32))


def test_frames_must_come_in_order(store):
    put(store, "c", [Record("a", {"body": "x"}, 10)])
    with store.writer() as w:
        w.put("c", Record("b", {"body": "x"}, 5))
        with pytest.raises(StoreError, match="created_at"):
            w.commit()


def test_one_writer_and_one_commit_at_a_time(store, spark):
    put(store, "c", [Record("a", {"body": "x"}, 1)])
    other = Store(spark, store.root)
    with store.writer() as w:
        assert other.try_writer() is None
        with pytest.raises(Busy):
            other.writer()
        w.put("c", Record("b", {"body": "x"}, 2))
        w.commit()
    with other.writer() as w, pytest.raises(Busy):  # other still stands on the old generation
        w.put("c", Record("z", {"body": "x"}, 3))
        w.commit()


def test_recovery_takes_the_newest_whole_generation(store, spark):
    put(store, "c", [Record("a", {"body": "x"}, 1)])
    put(store, "c", [Record("b", {"body": "x"}, 2)])
    lost = store.manifest["tables"]["frames"][-1]
    store.files.delete(f"{store.root}/{lost}")
    store.files.write(f"{store.root}/_commits/999999999999.json", "{ half")
    assert sorted(Store(spark, store.root).reader().keys("c")) == ["a"]


def test_text_search(store):
    put(store, "c", [Record(1, {"body": "Red kites circle above the grey mill"}, 100), Record(2, {"body": "Nothing here is of any use"}, 200), Record(3, {"body": "A grey heron stands by the mill"}, 300)])
    put(store, "other", [Record(9, {"body": "grey mill"}, 400)])
    snap = store.reader()
    assert set(keys(snap.search("c", Search().text("body", "grey mill")))) == {1, 3}
    assert keys(snap.search("c", Search().text("body", "grey mill").recency(Range(250, 350)))) == [3]
    assert snap.search("c", Search().text("body", "grey mill").top_k(0)).collect() == []
    for bad, words in ((Search().text("nope", "x"), "unknown field"), (Search(), "no channels")):
        with pytest.raises(ValueError, match=words):
            snap.search("c", bad)


def test_vectors_and_hybrid_search(store):
    rows = [Record(f"f{i}", {"body": "filler text", "dense": unit(i)}, i) for i in range(20)]
    rows += [Record("X", {"body": "special match", "dense": unit(500)}, 30), Record("Y", {"body": "nothing", "dense": unit(501)}, 31)]
    store.collection("c", BOTH)
    with pytest.raises(StoreError):
        store.reader().search("c", Search().vector("dense", unit(1)))
    put(store, "c", rows, BOTH)
    snap = store.reader()
    for s in (Search().vector("dense", unit(7)).accurate(), Search().vector("dense", unit(7)).fast()):
        assert keys(snap.search("c", s))[0] == "f7"
    near = (np.array(unit(501)) * 0.6 + np.array(unit(500)) * 0.59).tolist()
    assert keys(snap.search("c", Search().text("body", "special").vector("dense", near).fuse(Rrf(60))))[0] == "X"
    assert keys(snap.search("c", Search().text("body", "special").vector("dense", unit(500)).fuse(Weighted(0.5, 0.5))))[0] == "X"
    with pytest.raises(StoreError, match="vector field"):
        snap.search("c", Search().text("dense", "x"))
    with pytest.raises(StoreError, match="components"):
        snap.search("c", Search().vector("dense", [1.0]))
    back = {r["frame_id"]: r["embedding"] for r in snap.read_vectors("c", "dense").collect()}
    assert len(back) == 22 and np.dot(back[1], unit(0)) > 0.99
    with store.writer() as w:  # a staged version in a calibrated space can't be replaced
        w.put("c", Record("new", {"dense": unit(3)}, 40))
        with pytest.raises(UnsupportedError):
            w.put("c", Record("new", {"dense": unit(4)}, 41))
    assert [s["name"] for s in snap.spaces()] == ["~auto/c/dense"]


def test_profiles_and_engine_queries(store):
    store.register_profile("lex", Scorer("bm25", k1=1.5))
    store.register_profile("mix", FusionProfile((1.0, 0.0, 0.0, 1.0), "rrf", 60))
    with pytest.raises(StoreError):
        store.register_profile("lex", Scorer("bm25"))
    put(store, "c", [Record(i, {"body": "alpha " * (i + 1) + "beta", "dense": unit(i)}, i) for i in range(12)], BOTH)
    snap = Store(store.spark, store.root).reader()
    assert snap.profile("lex") == Scorer("bm25", k1=1.5) and snap.profile("mix").rrf_k == 60
    exact = [tuple(r) for r in snap.query_text("c", "alpha", "lex", 5).collect()]
    assert [tuple(r) for r in snap.query_text("c", "alpha", "lex", 5, channel_k=100).orderBy("rank").collect()] == sorted(exact) and len(exact) == 5
    assert snap.query_vector("c", "dense", unit(4), 3).first()["frame_id"] == 5
    both = snap.query_hybrid("c", "alpha", "lex", "dense", unit(4), "mix", 4).collect()
    assert len(both) == 4 and both[0]["score"] <= round(2 / 61, 6)
    assert "Scan parquet" in snap.explain("c", Search().text("body", "alpha"))
    with pytest.raises(StoreError, match="unknown profile"):
        snap.query_text("c", "alpha", "nope")
    with pytest.raises(StoreError, match="no scorer"):
        snap.query_text("c", "alpha", "mix")


def test_uncalibrated_spaces(store):
    put(store, "c", [Record("a", {"body": "x"}, 1)], BOTH)
    with pytest.raises(NotCalibrated, match="not calibrated"):
        store.reader().search("c", Search().vector("dense", unit(1)))


def test_recency(store):
    # equal texts, four weeks apart; at a half-life of 14 days the oldest counts a sixteenth
    put(store, "c", [Record(f"week {w}", {"body": "letter home"}, 7 * DAY * w) for w in (2, 6, 10)] + [Record("off", {"body": "bill"}, 71 * DAY)])
    snap = store.reader()
    halved = snap.search("c", Search().text("body", "letter home").recency(HalfLife(14)).now(70 * DAY)).orderBy("rank").collect()
    assert [decode_key(h["key"]) for h in halved] == ["week 10", "week 6", "week 2"]
    # reciprocal ranks of equal scores go by frame, so the newest starts from 1 / 63
    assert [h["score"] * 2**n * (60 + r) for h, n, r in zip(halved, (0, 2, 4), (3, 2, 1))] == pytest.approx([1, 1, 1], abs=2e-2)
    assert keys(snap.search("c", Search().text("body", "letter home").recency(RrfChannel(14, 3.0)))) == ["week 10", "week 6", "week 2"]


def test_compaction_keeps_survivors_and_trees(store):
    put(store, "c", [Record("p", {"body": "parent words", "dense": unit(1)}, 1), Record("k", {"body": "child words"}, 2, parent="p"), Record("t", {"body": "trash words"}, 3)], BOTH)
    assert [r["key"] for r in store.reader().children("c", "p").collect()] == [encode_key("k")]
    with store.writer() as w:
        w.delete("c", "p")
        w.commit()
    report = store.compact(recalibrate=True)
    snap = store.reader()
    assert report["changed"] and report["dropped_frames"] == 1 and not store.compact()["changed"]
    assert sorted(snap.keys("c")) == ["k", "t"] and snap.get("c", "k")["parent_frame_id"] is None and snap.stats()["tombstone_ratio"] == 0
    assert set(keys(snap.search("c", Search().text("body", "words")))) == {"k", "t"}


def test_partitions(store):
    store.partitioned("mem", TEXT, "day")
    with store.writer() as w:
        names = [w.put_into("mem", Record(f"k{i}", {"body": "log entry"}, t)) for i, t in enumerate((0, DAY, DAY + 60, 2 * DAY, 3 * DAY))]
        w.commit()
    assert names[:3] == ["mem:1970-01-01", "mem:1970-01-02", "mem:1970-01-02"]
    snap = store.reader()
    s = Search().text("body", "entry")
    assert set(keys(snap.search_view("mem", TimeWindow.range(DAY, 3 * DAY - 1), s))) == {"k1", "k2", "k3"}
    assert set(keys(snap.search_view("mem", TimeWindow.all(), s))) == {f"k{i}" for i in range(5)}
    assert keys(snap.search_view("mem", TimeWindow.partitions(["mem:1999-01-01"]), s)) == []
    assert set(keys(snap.search_view("mem", TimeWindow.last_days(1, 3 * DAY + 50), s))) == {"k3", "k4"}
    with store.writer() as w:
        assert w.forget_before("mem", 2 * DAY) == 3
        w.commit()
    with store.writer() as w:
        assert w.forget_before("mem", 2 * DAY) == 0
        assert w.put_into("mem", Record("late", {"body": "log entry"}, 3 * DAY)) == "mem:1970-01-04"
        w.commit()
    assert set(keys(store.reader().search_view("mem", TimeWindow.all(), s))) == {"k3", "k4", "late"}


def test_loader_export_and_command_line(store, spark, capsys):
    store.collection("c", TEXT)
    with store.writer() as w:
        loader = Loader(w, every=2)
        for i, k in enumerate(["a", "b", "c", "c"]):
            loader.put("c", Record(k, {"body": f"text {i}"}, i))
        loader.flush()
    snap = store.reader()
    assert snap.get("c", "c")["text"] == "text 3" and [r["frame_id"] for r in snap.time_range(1, 2).collect()] == [2]
    lines = [json.loads(r[0]) for r in snap.export("c").collect()]
    assert sorted(x["key"] for x in lines) == ["a", "b", "c"] and lines[0]["vectors"] == []
    assert main(["--json", "get", store.root, "c", "a"], spark) == 0 and main(["--json", "search", store.root, "c", "text"], spark) == 0
    assert main(["info", store.root], spark) == 0 and main(["get", store.root, "c", "zz"], spark) == 1
    assert "text 0" in capsys.readouterr().out


def test_whole_tables_in_one_commit(store, spark):
    store.collection("c", BOTH)
    rows = [(f"k{i % 25}", i, f"alpha {'beta ' * (i % 5)}", unit(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, created_at long, body string, dense array<float>").repartition(5)
    assert store.load("c", df)["rows"] == 25
    snap = store.reader()
    assert snap.get("c", "k3")["created_at"] == 28 and snap.get("c", "k20")["created_at"] == 20
    frames = snap.frames("c").orderBy("frame_id").collect()
    assert [r["frame_id"] for r in frames] == list(range(1, 26)) and [r["created_at"] for r in frames] == sorted(r["created_at"] for r in frames)
    assert keys(snap.search("c", Search().vector("dense", unit(30))))[0] == "k5" and len(keys(snap.search("c", Search().text("body", "beta")))) == 10
    with pytest.raises(StoreError, match="created_at"):
        store.load("c", df.where("created_at < 3").withColumn("key", F.concat("key", F.lit("x"))))
    with pytest.raises(StoreError, match="dense"):
        store.load("c", df.withColumn("dense", F.slice("dense", 1, 3)))
    more = df.where("created_at = 39").withColumn("created_at", F.lit(50).cast("long"))
    assert store.load("c", more)["rows"] == 1 and store.reader().get("c", "k14")["created_at"] == 50 and store.reader().stats()["active_frames"] == 25


def test_stream_into_partitions(store, spark, tmp_path):
    from sparquarry.streaming.ingest import ingest

    store.partitioned("ev", TEXT, "day")
    rows = [("a", "hello there", 5), ("b", "hello again", DAY + 5)]
    spark.createDataFrame(rows, "key string, text string, created_at long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, text string, created_at long").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(stream, store, "ev", str(tmp_path / "check")).awaitTermination()
    store.refresh()
    assert store.reader().collections() == ["ev:1970-01-01", "ev:1970-01-02"] and store.reader().stats()["frames"] == 2


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "d1", "title": "t", "text": "x"}\n')
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    assert formats.read_corpus(spark, str(tmp_path / "c.jsonl")).first()["key"] == "d1"
    assert tuple(formats.read_qrels(spark, str(tmp_path / "q.tsv")).first()) == ("q1", "d1", 2)
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "v.f32").write_bytes(x.tobytes())
    got = {r["vector_id"]: r["embedding"] for r in formats.read_f32(spark, str(tmp_path / "v.f32"), 4).collect()}
    assert got == {i: v.tolist() for i, v in enumerate(x)}
    run = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 9, 0.25)], "query_id long, rank int, doc long, score double")
    formats.write_run(run, str(tmp_path / "run"))
    assert sorted(tuple(r) for r in formats.read_run(spark, str(tmp_path / "run")).collect()) == [("1", 1, "7", 0.5, "run"), ("1", 2, "9", 0.25, "run")]
    a, b = (formats.synthetic_vectors(spark, 10, 8, 3, p).orderBy("vector_id").collect() for p in (1, 4))
    assert a == b
