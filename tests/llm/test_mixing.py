"""Mixing against a plain version and against its SQL."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquarry.llm import mixing
from sparquarry.llm import queries as Q

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def place(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def plain(rows, a, budget=None):
    """rows: (doc_id, source, tokens).  The list of (doc_id, source, pass, block, place), for ids that do not repeat."""
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    some = {s: n for s, n in total.items() if n}
    z = sum(n**a for n in some.values())
    budget = budget or z * max(n ** (1 - a) for n in some.values())
    out = []
    for s in total:
        mine = sorted((place(0, d), d, n) for d, x, n in rows if x == s)
        share = some[s] ** a / z * budget if s in some else 0
        whole = math.floor(share / some[s] + 1e-9) if s in some else 1
        rest = share - whole * total[s]
        last, used = {}, 0
        for p, d, n in mine:
            used += n
            if n and rest > 0.5 and used <= rest:
                last[d] = p
        for _, d, n in mine:
            out += [(d, s, k, place(0, d, k) >> 44, place(0, d, k)) for k in range(whole)]
            out += [(d, s, whole, last[d] >> 44, last[d])] if d in last else []
    return out


def skewed(seed, n=3000):
    rng = np.random.default_rng(seed)
    source = rng.choice(["hot", "mid", "low", None, "tiny"], n, p=[0.55, 0.3, 0.1, 0.045, 0.005])
    return [(i, " ".join("w" * int(k) for k in rng.integers(1, 5, int(rng.integers(0, 30)))), "en", s, 0) for i, s in enumerate(source)] + [(n, "x " * 20_000, "en", "low", 0), (n + 1, None, "en", "none", 0), (n + 2, "one", "en", "single", 0)]


@pytest.mark.parametrize("seed,budget", [(0, None), (1, None), (2, 9000.0)])
def test_permutation_is_the_plain_one(spark, seed, budget):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("place", F.lit("clash")).withColumn("uid", F.lit(0))
    counted = [(d, s, len(brute.words(t))) for d, t, _, s, _ in rows]
    totals = spark.createDataFrame([(s, sum(n for _, x, n in counted if x == s)) for s in {s for _, s, _ in counted}], "source string, tokens long")
    got = mixing.permutation(df, budget=budget).collect()
    expected = plain(counted, mixing.exponent(totals), budget)
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["source"], r["pass"], r["block"], r["place"])) for r in got)
    assert budget or max(Counter(r["doc_id"] for r in got).values()) > 1


def test_rows_that_repeat(spark):
    """400 rows equal in every column: their source and the others still get their budgets."""
    rows = [(7, "a b c d", "en", "A", 0)] * 400 + [(100 + i, "e f g", "en", "A", 0) for i in range(50)] + [(1000 + i, "h " * (1 + i % 7), "en", "B", 0) for i in range(300)] + [(None, "n n n", "en", "B", 0)] * 30
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for budget in (2400.0, None, 5001.0):
        got = mixing.copies(df, budget=budget).collect()
        assert len(got) == len(rows)
        used, want = defaultdict(int), {}
        for r in got:
            used[r["source"]] += r["copies"] * r["n_tokens"]
            want[r["source"]] = r["passes"]
        tokens = {"A": 1750, "B": sum(r["n_tokens"] for r in got if r["source"] == "B")}
        for s, passes in want.items():
            assert 0 <= passes * tokens[s] - used[s] < 8
        mixed = mixing.mix(df, budget=budget)
        per = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
        again = Counter()
        for r in got:
            again[r["doc_id"], r["source"]] += r["copies"]
        assert sum(per.values()) == sum(r["copies"] for r in got) and sum(v for (d, _, s), v in per.items() if d == 7) == again[7, "A"]


def test_id_with_two_sources_and_texts(spark):
    rows = [(1, "a b", "en", "A", 0), (1, "a b", "fr", "B", 1), (1, "c", "de", "B", 2), (None, None, None, None, None)] + [(10 + i, "q " * 9, "en", "A", 0) for i in range(20)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {tuple(r) for r in mixed.collect()} == set(rows)


@pytest.mark.parametrize("seed", range(2))
def test_against_sql(spark, tmp_path, seed):
    spark.createDataFrame(skewed(10 + seed), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        query = sql.sql(Q.ORACLES["op4_temperature_mixing"])
        names, expected = query.columns, query.fetchall()
    got = Q.op4_temperature_mixing(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in got) and max(r["pass"] for r in got) >= 1
