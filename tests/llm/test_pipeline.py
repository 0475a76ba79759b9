import corpus_pipeline as P
from sparquarry.llm import quality
from sparquarry.llm.common import materialise, read

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    scored = {r["doc_id"] for r in quality.quality(docs, read(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    one = materialise(P.STAGES[0][1](spark, docs, sf_dir), "t")
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert one.columns == COLUMNS and {d for d, _ in rows} == scored
    two = materialise(P.STAGES[1][1](spark, one, sf_dir), "t")
    lines = brute.line_dedup(rows)
    kept = [(r["doc_id"], r["text"]) for r in two.collect()]
    assert two.columns == COLUMNS and {d: (t.count("\n") + 1) for d, t in kept if lines[d][1] < lines[d][0]} == {d: n - k for d, (n, k, _) in lines.items() if k < n}
    three = materialise(P.STAGES[2][1](spark, two, sf_dir), "t")
    assert three.columns == COLUMNS and {r["doc_id"] for r in three.collect()} == {d for d, (_, c) in brute.classes(kept).items() if c == d}
    four = materialise(P.STAGES[3][1](spark, three, sf_dir), "t")
    assert four.columns == COLUMNS and {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()}
    five = P.STAGES[4][1](spark, four, sf_dir)
    whole = P.run(spark, sf_dir)
    assert sum(r["length"] for r in five.collect()) == sum(r["length"] for r in whole.collect()) > 0


def test_empty_tables(spark, sf_dir):
    none = read(spark, sf_dir, "documents").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.collect() == []
