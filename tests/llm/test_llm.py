"""The corpus operators against plain versions, on made tables and on whole small ones."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparquarry.llm import exact_dedup, html_extract, jaccard, line_dedup, lm_scoring, mixing, packing, quality, suffix_dedup, topk
from sparquarry.llm import queries as Q
from sparquarry.llm.common import read
from sparquarry.llm.graph import components
from sparquarry.llm.html_blocks import Block, blocks
from sparquarry.llm.html_pages import generate, unmark
from sparquarry.llm.words import words

from . import brute
from .pages_by_hand import PAGES

TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, bucket string, rank double"


def path():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def edited(text, at):
    w = text.split(" ")
    w[at] = "changed"
    return " ".join(w)


LINE = "A common line of well over forty characters, for all."


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 150)
    out = [(0, base), (1, base.upper()), (2, base.replace(" ", "\t\n")), (3, edited(base, 70)), (4, edited(edited(base, 20), 120)), (5, None), (6, ""), (7, " \n\t "), (8, "two words"), (9, "two words"), (10, "Two  words")]
    out += [(20 + i, prose(100 + i, 40) + "\n" + LINE + "\n" + ("  " + LINE.upper() + "\t" if i % 2 else "short")) for i in range(9)]
    out += [(40, "x" * 20_000), (41, "é" * 60 + "\x00   <|endoftext|> ﬁ " + base[:120]), (42, prose(7, 30_000)), (43, base[100:300] + " tail " + prose(8, 50))]
    chain = prose(55, 200)
    for i in range(8):  # neighbours are alike, the ends are not
        out.append((60 + i, chain))
        chain = edited(edited(edited(chain, 20 * i + 3), 20 * i + 9), 20 * i + 15)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns of clashing names and many partitions."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 5 else None, None, "x", 1, "b", 0.5) for i, t in rows], SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_exact_dedup(docs, rows, none):
    assert by_id(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)
    for ends in (-1, 8, 10_000):  # all batch, split groups, all history
        assert by_id(exact_dedup.exact_dedup(docs, ends), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)
    assert exact_dedup.exact_dedup(none).collect() == []


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "a b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 3 and {r["keep_id"] for r in got if r["group_size"] == 3} == {1}


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 256, (5000, 32)).astype(np.uint8)
    mph = exact_dedup.PerfectHash.from_bytes(exact_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(mph.slots(keys)) == list(range(5000)) and mph.slots(255 - keys).max() < 5000
    assert exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_line_dedup(docs, rows, none):
    got = by_id(line_dedup.digest_kept(docs, line_dedup.line_dedup(docs)), "n_lines", "n_dropped", "kept_sha256")
    assert got == brute.line_dedup(rows) and sum(v[1] for v in got.values()) == 12
    assert line_dedup.digest_kept(none, line_dedup.line_dedup(none)).collect() == []
    texts = by_id(line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs)), "text", "n_chars")
    assert texts[5] == (None, None) and LINE in texts[28][0] and LINE not in texts[27][0] and texts[27][1] == len(texts[27][0])


def test_line_dedup_can_keep_the_first(docs):
    texts = by_id(line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs, keep="first")), "text")
    assert LINE in texts[20][0] and LINE not in texts[28][0]


def test_jaccard(spark, docs, rows, none):
    got = by_id(jaccard.jaccard_classes(docs), "n_shingles", "component_id")
    assert got == brute.classes(rows)
    assert got[4][1] == 0 and got[67][1] == 60 and got[5] == (0, 5)
    assert jaccard.jaccard_classes(none).collect() == []
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs).collect()}
    assert kept == {d for d, (_, c) in got.items() if c == d}
    twice = docs.union(docs).union(spark.createDataFrame([(None, "two words", "", "", 0, "", 0, "", 0.0)], SCHEMA))
    rows2 = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_classes(twice).collect()]
    assert len(rows2) == 2 * len(rows) + 1 and (None, None) in rows2 and {(d, c) for d, c in rows2 if d is not None} == {(d, c) for d, (_, c) in got.items()}


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_of_random_families(spark, seed):
    rng, out = np.random.default_rng(seed), []
    for family in range(25):
        base = prose(1000 * seed + family, int(rng.integers(3, 400)), 60 if family % 3 else 5000)
        for _ in range(int(rng.integers(1, 9))):
            text = base
            for _ in range(int(rng.integers(0, 5))):
                text = edited(text, int(rng.integers(len(text.split(" ")))))
            out.append((len(out), text))
    assert by_id(jaccard.jaccard_classes(spark.createDataFrame(out, "doc_id long, text string")), "n_shingles", "component_id") == brute.classes(out)


def test_jaccard_of_one_large_family_over_band_edges(spark):
    """Copies of many lengths and edits: most pairs are near the threshold, in lists of two bands."""
    rng, out, base = np.random.default_rng(5), [], prose(9, 150, 5000).split(" ")
    for i in range(150):
        w = base[: int(rng.integers(96, 151))]
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(len(w)))] = f"new{rng.integers(10**6)}"
        out.append((1000 - i, " ".join(w)))
    expected = brute.classes(out)
    assert len({c for _, c in expected.values()}) > 1
    df = spark.createDataFrame(out, "doc_id long, text string").repartition(6)
    assert by_id(jaccard.jaccard_classes(df), "n_shingles", "component_id") == expected
    # every link between different components' pairs is verified: without the first round nothing is lost either
    join = jaccard.Join(df)
    links = {(r["a"], r["b"]) for r in join.links().collect()}
    sets = {d: brute.shingles(t) for d, t in out}
    assert links and all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in links)


def all_links(rows):
    sets = {d: brute.shingles(t) for d, t in rows}
    ids = sorted(d for d, s in sets.items() if s)
    return sets, {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("side", (7, 1024))
def test_jaccard_gives_every_link(spark, docs, rows, side, monkeypatch):
    """A family of different near-copies has links between all of them, not only those that join it."""
    monkeypatch.setattr(jaccard, "SIDE", side)
    monkeypatch.setattr(jaccard, "COLUMNS", 8 * side)
    base = prose(77, 300, 5000)
    family = [(200 + i, edited(base, 13 * i)) for i in range(20)] + [(300, edited(base, 0)), (301, edited(base, 0).upper())]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(family, "doc_id long, text string"))
    sets, links = all_links(rows + family)
    expected = {d: (sum(d in p for p in links),) for d in sets}
    assert expected[200] == (21,) and expected[5] == (0,)
    assert by_id(jaccard.jaccard_classes(df), "n_links") == {d: v for d, v in expected.items()}
    of = {}
    for d in sorted(sets):
        of.setdefault(frozenset(sets[d]), d)
    reps = set(of.values())
    assert {(r["a"], r["b"]) for r in jaccard.Join(df).links().collect()} == {p for p in links if p[0] in reps and p[1] in reps}
    twice = jaccard.jaccard_classes(df.union(df))
    assert {(r["doc_id"], r["n_links"]) for r in twice.collect()} == {(d, v[0]) for d, v in expected.items()}


def test_jaccard_when_cells_are_single_members(spark, rows, monkeypatch):
    """The way of sets with too few cells in use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard.Join(df)
    join.rows = join.rows.withColumn("weak", F.when(F.col("n") > 0, F.lit(0).cast("int")).otherwise(F.lit(-1)) + F.lit(int(jaccard.band_of(np.array([146]))[0])))
    assert by_id(join.classes(), "n_shingles", "component_id") == brute.classes(rows)


@pytest.mark.parametrize("long,gather", [(3, 200), (40, 1 << 20)])
def test_jaccard_of_sets_that_share_a_phrase(spark, long, gather, monkeypatch):
    """A phrase and a passage in most texts, families among them, and entries of long lists that leave before a bucket ends."""
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "GATHER", gather)
    rng, out = np.random.default_rng(11), []
    passage = prose(5, 30, 5000)
    for i in range(260):
        tail = prose(3000 + i, int(rng.integers(1, 9)), 9000) if i % 2 else passage + " " + prose(3000 + i, int(rng.integers(4, 60)), 9000)
        out.append((len(out), "a phrase that all share " + tail))
        for _ in range(int(rng.integers(0, 3)) if i % 5 == 0 else 0):
            out.append((len(out), edited(out[-1][1], int(rng.integers(5)) if i % 10 else -1)))
    for i in range(40):
        out.append((len(out), edited(passage + " " + passage.upper() + " tail", int(rng.integers(60)))))
    df = spark.createDataFrame(out, "doc_id long, text string").repartition(4)
    expected = brute.classes(out)
    assert by_id(jaccard.jaccard_classes(df), "n_shingles", "component_id") == expected and len({c for _, c in expected.values()}) < len(out) - 30


def test_one_row_of_each_repeated_row(spark):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 3 + [(2, "A b c d e f", "en", "s", 1), (3, None, None, None, None), (3, None, None, None, None), (None, "a b c d e f", "en", "s", 1), (4, "x", "en", "s", 1), (4, "other words", "en", "s", 1)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, [(1, "a b c d e f"), (3, None), (None, "a b c d e f"), (4, "x"), (4, "other words")]))


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.r_[a[: 300 - int(rng.integers(0, 60))], rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)]
        sa, sb = jaccard.sketch(a), jaccard.sketch(b)
        size = min(len(sa), len(sb))
        assert np.bitwise_count(jaccard.fold(sa, size) ^ jaccard.fold(sb, size)).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1000] == got[1001] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeats(docs, rows, none):
    got = by_id(suffix_dedup.suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows) and got[43][1] > 150
    assert suffix_dedup.suffix_dedup(none).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_random_texts(spark, seed):
    """Pasted pieces around the length of a window, periodic runs, texts of few letters."""
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abé "), int(rng.integers(30, 160)))) for _ in range(12)] + ["ab" * 60, "z" * 90]
    out = []
    for i in range(60):
        parts = [pool[int(rng.integers(len(pool)))][int(rng.integers(0, 25)) :] if rng.random() < 0.6 else "".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 60)))) for _ in range(int(rng.integers(0, 6)))]
        out.append((int(i), "".join(parts)))
    got = by_id(suffix_dedup.suffix_dedup(spark.createDataFrame(out, "doc_id long, text string").repartition(4)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(out)


@pytest.mark.parametrize("block,bucket", [(300, 50), (1 << 20, 1 << 21)])
def test_repeats_of_rows_that_share_an_id(spark, block, bucket, monkeypatch):
    """Repeated rows, null ids and ids that go on in the next block are not smaller than one another; confused names are told apart."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "MARGIN", 60)
    a, b = prose(1, 40), prose(2, 60)
    rows = [(None, a), (None, a), (None, b[:70]), (3, a), (3, a), (3, a + b), (3, a + a), (5, b), (5, b), (6, None), (7, ""), (8, "x" * 49), (9, "x" * 49), (10, "x" * 120), (11, a + " " + b)]
    got = sorted(map(repr, ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())))
    # each row against one row of every smaller id's texts, null first
    order = lambda d: -1 if d is None else d
    expected = []
    for d, t in rows:
        smaller = [(i, u) for i, (e, u) in enumerate(rows) if order(e) < order(d)]
        expected.append(repr((d, *brute.repeats([*smaller, (10**6, t)])[10**6])))
    assert got == sorted(expected)


def test_order_of_names_that_agree_in_their_upper_bits():
    rng = np.random.default_rng(3)
    name = rng.integers(0, 40, 3000).astype(np.uint64) + (rng.integers(0, 5, 3000).astype(np.uint64) << np.uint64(40))
    extra = rng.integers(0, 3, 3000).astype(np.uint64)
    for e in (None, extra):
        order = suffix_dedup.Winners._order(name, e)
        got = list(zip(name[order], e[order])) if e is not None else list(name[order])
        assert got == sorted(got) and sorted(order) == list(range(3000))


def test_lm_scores(spark, docs, rows, none):
    targets = spark.createDataFrame([(i,) for i in (0, 3, 8, 20, 24, 63, None)], "doc_id long")
    got = by_id(lm_scoring.lm_scores(docs, targets, 12), "n_tokens", "target_loss", "background_loss", "score")

    def cls(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(lm_scoring.classes(raw, np.array([0, len(raw)]), 12)[2][0])

    expected = brute.losses(rows, {0, 3, 8, 20, 24, 63}, cls, 1 << 12, lm_scoring.MASS)
    assert got.keys() == expected.keys()
    for d, (n, t, b) in expected.items():
        assert got[d][0] == n and got[d][1:] == (pytest.approx((t, b, t - b), abs=1e-4) if n else (None, None, None))
    assert lm_scoring.lm_scores(none, targets).collect() == []
    again = lm_scoring.lm_scores(docs.union(docs), targets.limit(0), 12)
    assert again.count() == 2 * len(rows)


def test_small_numbers():
    x = np.array([0, 0, 1, 254, 255, 256, 510, 3, 70_000, 0])
    assert lm_scoring._sums(lm_scoring._small(x)).tolist() == np.cumsum(x).tolist() and lm_scoring._small(x[:3]) == bytes([0, 0, 1])
    assert lm_scoring._small(x[:0]) == b"" and lm_scoring._sums(b"").tolist() == []


def test_sets_of_ids(spark):
    """Few and many ids of a chunk, negative ones, the ends of chunks, nulls."""
    some = [*range(0, 20_000, 3), 65_535, 65_536, 70_000, -1, -65_537, 2**62, -(2**63), 2**63 - 1]
    rows = lm_scoring.Ids.of(spark.createDataFrame([(i,) for i in some], "doc_id long")).collect()
    assert {len(r["ids"]) for r in rows if r["chunk"] == 0} == {8192} and sum(len(r["ids"]) == 8192 for r in rows) == 1
    ids = lm_scoring.Ids(rows)
    asked = [*some, None, 1, 65_534, 65_537, -2, -65_536, 2**62 + 1, 2**61, 0, None]
    assert ids.holds(pa.array(asked, pa.int64())).tolist() == [i is not None and i in set(some) for i in asked]
    assert not lm_scoring.Ids([]).holds(pa.array([0, None], pa.int64())).any()


@pytest.mark.parametrize("frequent", (16, 7, 0))
def test_lm_scores_of_real_words(spark, docs, rows, frequent, monkeypatch):
    """Words and histories are counted each for itself, broadcast or not; so are the ids of targets."""
    monkeypatch.setattr(lm_scoring, "IDS", 32 << 20 if frequent else 0)
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    more = [(500 + i, " ".join(f"r{(i * 3000 + j) % 70_000}" for j in range(3500))) for i in range(24)]
    some = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    chosen = {0, 3, 8, 20, 24, 63, 501, 511}
    expected = brute.losses(rows + more, chosen, lambda w: w, len({w for _, t in rows + more for w in brute.words(t)}), lm_scoring.MASS)
    got = by_id(lm_scoring.lm_scores(some, spark.createDataFrame([(i,) for i in chosen], "doc_id long")), "n_tokens", "target_loss", "background_loss", "score")
    assert got.keys() == expected.keys()
    for d, (n, t, b) in expected.items():
        assert got[d][0] == n and got[d][1:] == (pytest.approx((t, b, t - b), abs=1e-4) if n else (None, None, None))


def test_quality(spark, sf_dir, docs, none):
    labels = read(spark, sf_dir, "labels")
    rows = quality.quality(read(spark, sf_dir, "documents"), labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(held) > 0.9
    # labels of held-out rows and other columns have no say
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert [r["score"] for r in quality.quality(read(spark, sf_dir, "documents").withColumn("source", F.lit("z")), flipped).orderBy("doc_id").collect()] == [r["score"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    one_class = labels.where("quality = 1")
    assert {r["score"] for r in quality.quality(docs, one_class).collect()} == {1.0} and quality.quality(none, labels).collect() == []
    model = quality.train(read(spark, sf_dir, "documents"), labels)
    kept = {r["doc_id"] for r in quality.keep_good(read(spark, sf_dir, "documents").withColumn("kept", F.lit(0)), model).collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"]}
    assert quality.keep_good(docs, model).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_bradley_terry_orders_by_the_feature_that_matters():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_FEATURES))
    y = (x[:, 3] + 0.1 * rng.normal(size=400) > 0.8).astype(int)
    model = quality.BradleyTerry.fit(x, y, pairs=20_000)
    assert model.weights.argmax() == 3 and ((model.score(x) >= 0.7) == y).mean() > 0.95


def area(score, y):
    """Area under the curve: how often a good row is above a bad one."""
    above = score[y == 1][:, None] - score[y == 0][None]
    return ((above > 0) + 0.5 * (above == 0)).mean()


def test_quality_knows_what_is_said(spark):
    """Texts written alike, that differ by their words alone."""
    rng = np.random.default_rng(1)
    good, bad = ([" ".join(p) for p in rng.choice(list("bdfglmnprst"), (300, 6))] for _ in range(2))
    good, bad = ([w.replace(" ", "a") for w in words] for words in (good, bad))
    rows, labels = [], []
    for i in range(900):
        y = int(rng.random() < 0.6)
        mine, other = (good, bad) if y else (bad, good)
        ws = [str(rng.choice(mine if rng.random() < 0.7 else other)) for _ in range(int(rng.integers(30, 90)))]
        rows.append((i, " ".join(ws)))
        labels.append((i, y))
    scored = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in scored if r["held_out"]]
    y, score = np.array([dict(labels)[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])
    assert area(score, y) > 0.9 and ((score >= 0.7) == y).mean() > 0.8


def test_fitted_weights_are_a_minimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, quality.N_FEATURES))
    y = (x[:, 5] - x[:, 60] + rng.normal(size=150) > 0).astype(int)
    m = quality.BradleyTerry.fit(x, y, pairs=3000)
    pick = np.random.default_rng(0)
    z = (x - m.mean) / m.scale
    d = z[pick.choice(np.flatnonzero(y == 1), 3000)] - z[pick.choice(np.flatnonzero(y == 0), 3000)]
    ridge = np.where(np.arange(x.shape[1]) < quality.N_RATES, quality.RIDGE, quality.CELL_RIDGE)
    loss = lambda w: np.logaddexp(0, -(d @ w)).mean() + (ridge * w * w).sum() / 2
    assert all(loss(m.weights) <= loss(m.weights + step) + 1e-9 for step in 0.05 * rng.normal(size=(50, len(m.weights))))
    # the cut is the quantile of the share labelled 0
    assert (m.strength(x) < m.cut).sum() == (y == 0).sum()


def test_html_template(spark, sf_dir):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in read(spark, sf_dir, "pages").collect()}
    got = {r["page_id"]: r for r in html_extract.extract(read(spark, sf_dir, "pages").withColumn("text", F.lit("x"))).collect()}
    for i, page in pages.items():
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[i]["text"] == "\n\n".join(p for p in parts if p) and got[i]["n_chars"] == len(got[i]["text"])


def test_html_of_held_out_layouts():
    right = total = 0
    for page in generate(120, 4242):
        found, y = [], []
        for b in blocks(page):
            label, text = unmark(b.text)
            found.append(Block(text, b.path, b.linked))
            y.append(label)
        if found:
            z = html_extract.trained().label([html_extract.vectors(found, html_extract.trained().known)])[0]
            right += int(((np.array(y) == 0) == (z == 0)).sum())
            total += len(y)
    assert right / total > 0.98


def test_html_of_pages_by_hand():
    """Pages that no generator made: F1 of the blocks kept."""
    right = kept = wanted = 0
    for page in PAGES.values():
        want = [b.text.replace("§", "") for b in blocks(page) if b.text.startswith("§")]
        found = blocks(page.replace("§", ""))
        labels = html_extract.trained().label([html_extract.vectors(found, html_extract.trained().known)])[0]
        got = [b.text for b, y in zip(found, labels) if y == 0]
        right += sum(x in want for x in got)
        kept, wanted = kept + len(got), wanted + len(want)
    assert len(PAGES) >= 30 and 2 * right / (kept + wanted) > 0.95


def test_html_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<p>a &amp; b&#33;\n <i>c</i><br>d"), (4, None, "<script>x<p>y"), (5, "u", "<article><p>" + "w " * 50_000), (6, "u", "<" * 5000 + "<a href='"), (7, "u", "<p><!-- never closed <p>x")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[1] == got[2] == got[4] == got[7] == "" and got[3] in ("a & b! c d", "") and len(got[5]) == 99_999
    assert html_extract.extract(df.limit(0)).collect() == []
    assert [b.text for b in blocks("<p>a<p>b<div>c<span> d</span></div>e<ul><li>f<li>g</ul>")] == ["a", "b", "c d", "e", "f", "g"]


def test_html_keeps_formulas_and_fallbacks():
    of = lambda page: [b.text for b in blocks(page)]
    assert of("<p>a <svg class='x'/> b</p><p>c <math /> d</p><p>e</p>") == ["a b", "c d", "e"]
    assert of("<p>if <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> then</p><p>f</p>") == ["if x=2 then", "f"]
    assert of("<svg><path d='M0'/><style/><text>drawn</text></svg> g<p>h") == ["drawn g", "h"]
    assert of("<p>i</p><object data='x'><p>j</p></object><canvas>k</canvas><noscript><p>l</p></noscript><p>m") == ["i", "j", "k", "l", "m"]
    assert of("<p>n</p><svg><g>never closed<p>o</p><p>p") == ["n", "never closed", "o", "p"]
    assert of("<p>q</p><script>r</script><style>s</style><iframe>t</iframe><p>u") == ["q", "u"]


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    pages = [rng.normal(size=(n, html_extract.WIDTH)).astype(np.float32) for n in (3, 5)]
    labels = [rng.integers(0, 10, len(p)) for p in pages]
    m = html_extract.Labeller.train(pages, labels, epochs=1, hidden=4)
    _, grads = m.gradients(pages, labels)
    for w, g in zip((m.ahead.w, m.back.w, m.out), grads):
        for at in [(0, 1), (w.shape[0] - 1, 2), (w.shape[0] - 3, 0)]:
            old, both = w[at], []
            for step in (1e-2, -1e-2):
                w[at] = old + step
                both.append(m.gradients(pages, labels)[0])
            w[at] = old
            assert (both[0] - both[1]) / 2e-2 == pytest.approx(g[at], abs=2e-3)


def test_mixing(spark, docs, none):
    big = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 3000, F.lit("hot")).when(F.col("id") < 3800, F.lit("mid")).otherwise(F.lit("low")).alias("source"), F.lit(5).cast("long").alias("n_chars"))
    totals = big.groupBy("source").agg((3 * F.count("*")).alias("tokens"))
    p = np.array([3000, 800, 200]) / 4000
    assert mixing.exponent(totals, 0.6, None) == 1.0  # the natural mix has more
    for target in (0.7, 0.8, 0.95):
        q = p ** mixing.exponent(totals, target, None)
        q /= q.sum()
        assert -(q * np.log(q)).sum() / np.log(3) == pytest.approx(target, abs=1e-4)
    assert mixing.exponent(totals, 1.0, 2.0) == pytest.approx(1 - np.log(2) / np.log(15), abs=1e-6)
    rows = mixing.copies(big, 0.9, 3.0).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    assert min(r["copies"] for r in rows) == 1 and len(rows) == 4000 and sum({s: v[0]["weight"] for s, v in by.items()}.values()) == pytest.approx(1)
    for s, v in by.items():
        assert abs(sum(3 * r["copies"] for r in v) - v[0]["passes"] * 3 * len(v)) <= 3 and max(r["copies"] for r in v) - min(r["copies"] for r in v) <= 1
    small = mixing.copies(big, 0.9, 3.0, budget=1500).collect()
    assert abs(sum(3 * r["copies"] for r in small) - 1500) <= 9
    assert [r["copies"] for r in mixing.copies(big.repartition(9), 0.9, 3.0).orderBy("doc_id").collect()] == [r["copies"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    odd = mixing.copies(docs).collect()
    assert {r["source"] for r in odd} == {"s0", "s1", "s2", None} and all(r["copies"] >= 1 for r in odd) and mixing.copies(none).collect() == []
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and mixed.count() == sum(r["copies"] for r in odd)


def test_mixing_deals_each_pass_anew(spark):
    some = spark.createDataFrame([(i, f"text {i} " * (1 + i % 5), "en", "big" if i % 10 else "small", 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows = mixing.copies(some).collect()
    assert max(r["copies"] for r in rows) > 1
    assert all([x["pass"] for x in r["deals"]] == list(range(r["copies"])) and len({x["place"] for x in r["deals"]}) == r["copies"] for r in rows)
    twice = [r for r in rows if r["copies"] > 1]
    first, second = (sorted((r["doc_id"] for r in twice), key=lambda d, k=k: {r["doc_id"]: r["deals"][k]["place"] for r in twice}[d]) for k in (0, 1))
    assert first != second
    mixed = [[r["doc_id"] for r in part] for part in mixing.mix(some).rdd.glom().collect()]
    assert sorted(d for part in mixed for d in part) == sorted(r["doc_id"] for r in rows for _ in range(r["copies"]))
    passes = {r["doc_id"]: {x["pass"] for x in r["deals"]} for r in rows}
    again = [d for part in mixed for d, e in zip(part, part[1:]) if d == e and passes[d] > {0}]
    assert len(again) <= len(twice) // 10


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    ids = {d: np.array([*Tokenizer.from_file(path()).encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for d, t in rows}
    out = packing.pack(docs, path()).collect()
    seen = {d: np.zeros(len(x), int) for d, x in ids.items()}
    seqs = {}
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((x == 1).all() for x in seen.values())
    padding = 0
    for parts in seqs.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 2048 - ends[-1]
    assert padding == 0 and packing.pack(none, path()).collect() == []


def test_packing_under_all_limits(spark, docs):
    prompts = docs.withColumn("prompt", F.lit(5))
    out = packing.pack(prompts, path(), tokens=256, segments=3, loss=200, prompt_tokens="prompt").collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for parts in seqs.values():
        assert sum(r["length"] for r in parts) <= 256 and len(parts) <= 3 and sum(r["loss_tokens"] for r in parts) <= 200
    per = {}
    for r in out:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["loss_tokens"]
    total = {r["doc_id"]: r["doc_tokens"] for r in out}
    assert all(n == max(0, total[d] - 5) for d, n in per.items())


def test_word_encoder_is_the_tokenizer(spark, sf_dir):
    cache = packing.WordCache(path())
    texts = [r["text"] or "" for r in read(spark, sf_dir, "documents").collect()] + ["a\x01b \x1c c", "<|endoftext|>x", "ΑΣ ﬁ x² ½ _a_ don't I'LL b\u0085c", "naïve Å Å 中文 \U0001f600!!", "", "  \t "]
    assert cache.fast is not None
    for text, got in zip(texts, cache.encode(texts)):
        assert got.tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_cache_forgets_long_words():
    cache = packing.WordCache(path())
    texts = ["".join(chr(0x4E00 + (i * 7 + j) % 2000) for j in range(2000)) + " word" for i in range(40)]
    got = cache.encode(texts)
    assert all(x.tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids for x, t in zip(got, texts))
    assert sum(len(k) + len(v) for k, v in cache.known.items()) < 1000 and "word" in cache.known
    assert [x.tolist() for x in cache.encode(texts)] == [x.tolist() for x in got]


@pytest.mark.parametrize("together, of_bounds", [(1024, 4096), (3, 4)])
def test_top_k(spark, together, of_bounds, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", together)
    monkeypatch.setattr(topk, "BOUNDS", of_bounds)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:400] = x[100]  # one vector holds much of the table
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [float("nan")] * 8), (1000, [float("inf")] * 8), (1050, [1.0, None]), (1100, []), (1150, [0.5] * 3), (1200, [1.5] * 3), (1250, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in topk.search(topk.build_index(df, annulus=32), 50, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    for q in range(0, 700, 50):
        scores = v @ v[q]
        order = [i for i in sorted(range(700), key=lambda i: (-scores[i], i)) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, i, int(scores[i])) for k, i in enumerate(order)]
    assert sorted(got[1150]) == [(1, 1200, 3 * 128 * 384)] and set(got) == {*range(0, 700, 50), 1150, 1200}
    assert topk.search(topk.build_index(df.limit(0)), 50, 5).collect() == []


def test_blocks_of_queries_by_cell(monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 10)
    pivots = {2: np.array([[0, 0], [9, 9], [1, 0], [2, 0]]), 3: np.zeros((1, 3))}
    sizes = {(2, 0): 4, (2, 1): 25, (2, 2): 5, (2, 3): 6, (3, 0): 1}
    assert topk._deal(sizes, pivots) == [(2, 0, 0, 1), (2, 2, 0, 1), (2, 3, 1, 1), (2, 1, 2, 3), (3, 0, 5, 1)]
    assert topk._deal({}, {}) == []


def test_far_annuli_are_not_sent(spark):
    """Vectors in six far clusters, each with pivots of its own: a block of queries of one cluster gets the annuli of that cluster alone."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * 0.01 + 100 * np.eye(6)[i // 100]).tolist()) for i in range(600)]
    index = topk.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), pivots=64, annulus=16)
    q = np.floor(256 * np.array(rows[0][1], np.float32).astype(float)).astype("<i8")
    packed = spark.createDataFrame([(0, 6, 1, np.int64(0).tobytes(), q.tobytes(), np.int64(int(0.9 * (q @ q))).tobytes())], topk.QUERY)
    annuli = {r["annulus"]: set(np.frombuffer(r["ids"], "<i8") // 100) for r in index.blocks.collect()}
    assert len({tuple(p.argsort()[-1:]) for p in index.pivots[6]}) == 6
    found = {r["annulus"] for r in topk.survivors(index, packed, 1, len(annuli)).collect()}
    assert found == {a for a, clusters in annuli.items() if 0 in clusters} and len(found) < len(annuli) / 2


def test_words_as_arrays():
    texts = ["", " a  bc\n", "é\x0bd", "x" * 70]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found = [(int(d), bytes(data[s:e]).decode()) for s, e, d in zip(*words(data, offsets))]
    assert found == [(i, w) for i, t in enumerate(texts) for w in brute.words(t)]


def test_whole_small_tables(spark, sf_dir):
    """The registered queries over the whole of the smallest tables."""
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf_dir, "documents").collect()]
    assert by_id(Q.op1_exact_dedup(spark, sf_dir), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)
    assert by_id(Q.op5_parity_sketch_jaccard(spark, sf_dir), "n_shingles", "component_id") == brute.classes(rows)
    assert by_id(Q.op6_line_dedup(spark, sf_dir), "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(rows)
    assert by_id(Q.op9_prefix_doubling(spark, sf_dir), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)
    assert set(Q.queries()) >= {f for f in dir(Q) if f.startswith("op") and f[2].isdigit()} and len(Q.queries()) == 10
