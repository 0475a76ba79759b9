import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquarry.operators import codecs as C
from sparquarry.operators import vector_search as S


def unit(n, dim=64, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vector_id long, embedding array<float>")


def test_splitmix_golden_values():
    draw = C.SplitMix64(0)
    assert [f"{draw.next():016X}" for _ in range(5)] == ["E220A8397B1DCDAF", "6E789E6AA1B965F4", "06C45D188009454F", "F88BB8A8724C81EC", "1B39896A51A8749B"]


@pytest.mark.parametrize("dim", [64, 96, 768, 2048])
def test_rotation_is_orthonormal(dim):
    x = unit(20, dim)
    z = C.rotate(x)
    assert np.allclose(C.rotate_back(z), x, atol=1e-6) and np.allclose(np.linalg.norm(z, axis=1), 1, atol=1e-5)


def test_bits_round_trip():
    x = np.random.default_rng(1).integers(0, 32, (7, 33))
    packed = C.pack_bits(x, 5, 64)
    assert packed.shape[1] % 64 == 0 and (C.unpack_bits(packed, 33, 5) == x).all()


def codec(kind, x):
    z = C.rotate(x)
    sigma = C.Qam.scales(np.hypot(z[:, ::2], z[:, 1::2]).sum(0), len(x))
    return C.Upq(64, C.fit_upq(C.rayleigh_quantiles(20_000)), sigma) if kind == "upq" else C.Qam(64, *kind, sigma)


@pytest.mark.parametrize("kind, floor", [((4, 4), 0.98), ((5, 6), 0.998), ((8, 8), 0.9999), ("upq", 0.995)])
def test_decoding_is_near(kind, floor):
    x = unit(200)
    c = codec(kind, x)
    codes = c.encode(x)
    back = c.decode(codes)
    assert (back * x).sum(1).min() > floor and np.allclose(np.linalg.norm(back, axis=1), 1)
    again = C.from_json(c.to_json())
    assert np.allclose(again.decode(codes), back)
    z, bits = c.rotated(codes), np.unpackbits(c.sketches(codes).view(np.uint8), axis=1, bitorder="little")[:, :64]
    away = np.abs(z) > 1e-6
    assert ((z >= 0) == bits)[away].all()


def test_sketch_bits_at_quarter_turns():
    cos, sin = C.Qam(64, 5, 6, np.ones(32))._table
    assert not cos[16] >= 0 and cos[48] >= 0 and not sin[32] >= 0


def test_upq_design():
    d = C.fit_upq(C.rayleigh_quantiles(50_000))
    assert d.cost < 2.4e-3 and d.phases.sum() <= 2048 and (d.phases >= 4).all() and (d.phases & (d.phases - 1) == 0).all() and (np.diff(d.radii) > 0).all()


def test_distances_of_codes():
    x = unit(50)
    c = codec((8, 8), x)
    codes = c.encode(x)
    q = x[3].astype(float)
    cos = x @ x[3]
    assert np.allclose(c.distances(q, codes, "cosine"), 1 - cos, atol=5e-3)
    assert np.allclose(c.distances(q, codes, "dot"), -cos, atol=5e-3) and np.allclose(c.distances(q, codes, "l2"), 2 - 2 * cos, atol=1e-2)
    assert c.fast_scores(q, codes).argmin() == 3


@pytest.mark.parametrize("kind", ["qam", "upq"])
def test_code_search_finds_itself(spark, kind):
    x = unit(120, seed=5)
    v = table(spark, x)
    c = C.calibrate_qam(v, 64) if kind == "qam" else C.calibrate_upq(v, 64, 20_000)
    coded = C.encode_table(v, c).cache()
    for rerank in ("full", "lossy"):
        for channel_k in (None, 40):
            hits = C.code_search(coded, c, x[17].tolist(), 3, channel_k=channel_k, rerank=rerank).collect()
            assert hits[0]["vector_id"] == 17 and len(hits) == 3
    assert C.code_search(coded, c, x[17].tolist(), 3, scope=F.col("vector_id") != 17).first()["vector_id"] != 17


def test_exact_search(spark):
    x = unit(60, seed=2)
    v = table(spark, x).union(spark.createDataFrame([(99, None), (98, [1.0]), (97, [float("nan")] * 64)], "vector_id long, embedding array<float>"))
    got = [r["vector_id"] for r in S.nearest(v, x[4].tolist(), 5).collect()]
    assert got == np.argsort(-(x @ x[4]), kind="stable")[:5].tolist()
    batch = S.nearest_batch(table(spark, x), table(spark, x[:3]).withColumnRenamed("vector_id", "query_id"), 4)
    rows = {(r["query_id"], r["rank"]): r["vector_id"] for r in batch.collect()}
    for q in range(3):
        assert [rows[q, r] for r in range(1, 5)] == np.argsort(-(x @ x[q]), kind="stable")[:4].tolist()


def test_budget():
    assert S.candidate_budget(10, 10_000) == 2048 and S.candidate_budget(1000, 10_000) == 4000 and S.candidate_budget(10, 500) == 500 and S.candidate_budget(10, 500, 20) == 20


def plain_batch(x, ids, queries, k, metric):
    """By SQL's rules, pair by pair."""
    out = {}
    for qid, q in queries:
        found = []
        for i, v in zip(ids, x):
            if q is None or v is None:
                found.append((2, 0.0, i))
                continue
            dot, qq, vv = (sum(a * b for a, b in zip(*p)) for p in ((q, v), (q, q), (v, v)))
            n = (qq**0.5) * (vv**0.5)
            d = {"cosine": 1 - dot / n if n else float("nan"), "dot": -dot, "l2": sum((a - b) ** 2 for a, b in zip(q, v))}[metric]
            found.append((1, 0.0, i) if d != d else (0, round(d, 6) + 0.0, i))
        out[qid] = [(i, None if c == 2 else "nan" if c else d) for c, d, i in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_batches_follow_sql_on_odd_vectors(spark, metric):
    """Null, zero and non-finite vectors come last; many copies, near ties; fewer vectors than k are numbers."""
    x = [[float(a) for a in v] for v in np.random.default_rng(4).integers(-3, 4, (300, 4))]
    x += [x[0]] * 40 + [[1.0, 1e-7 * i, 0.0, 0.0] for i in range(20)] + [None, [0.0] * 4, [float("nan")] * 4, None, [float("inf"), 1.0, 0.0, 0.0]]
    ids = [(i * 7919) % 100_003 for i in range(len(x))]
    v = spark.createDataFrame(list(zip(ids, x)), "vector_id long, embedding array<double>")
    queries = [(i, x[i]) for i in range(30)] + [(900 + i, x[i]) for i in range(len(x) - 25, len(x))]
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    for rows, which, k in ((v, range(len(x)), 10), (v.where(F.col("vector_id").isin(ids[-5:] + ids[:2])), [*range(2), *range(len(x) - 5, len(x))], 9)):
        got = {}
        for r in S.nearest_batch(rows.repartition(3), q, k, metric).orderBy("query_id", "rank").collect():
            d = r["distance"]
            got.setdefault(r["query_id"], []).append((r["vector_id"], d if d is None or d == d else "nan"))
        want = plain_batch([x[i] for i in which], [ids[i] for i in which], queries, k, metric)
        for qid in want:
            assert [i for i, _ in got[qid]] == [i for i, _ in want[qid]], (metric, qid)
            assert all(a == b or abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got[qid], want[qid]) if not isinstance(b, (str, type(None)))) and all(a == b for (_, a), (_, b) in zip(got[qid], want[qid]) if isinstance(b, (str, type(None))))


def test_codec_recall_makes_no_rows_of_pairs(spark, tmp_path):
    """Zero and null vectors are no error, and no operator of the plan gives a row for each pair."""
    from sparquarry.queries import QUERIES

    x = [v.tolist() for v in unit(400, seed=8)] + [[0.0] * 64, None]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["codec_recall"](spark, str(tmp_path))
    rows = {r["query_id"]: r["recall"] for r in found.collect()}
    assert sorted(rows) == list(range(0, 401, 20)) and sum(rows.values()) / len(rows) > 0.9
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
