import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparquarry.functions.porter2 import stem
from sparquarry.functions.text import Analyzer, UnsupportedError

CASES = [
    (Analyzer(form="NFC", fold_accents=True, min_length=3), "Une ÉTÉ à Cadix: 4 crêpes, ñandú—où?", "une ete cadix crepes nandu"),
    (Analyzer.raw(), " Wait,\twhat?  It's\n9 p.m. ", "Wait, what? It's 9 p.m."),
    (Analyzer(), "ÜBER Straße Ödön", "über straße ödön"),
    (Analyzer(fold_case=False, fold_accents=True), "Ángel Öztürk", "Angel Ozturk"),
    (Analyzer(min_length=3, max_length=5), "to row nine boats across it", "row nine boats"),
    (Analyzer(form="NFKC"), "oﬀer № 7³", "offer no 73"),
    (Analyzer.english(), "The sailors were sailing the boats to their harbour", "sailor were sail boat harbour"),
    (Analyzer.english(), "ponies easily hopeful nationally troubles", "poni easili hope nation troubl"),
    (Analyzer(stopwords=("a", "and")), "A hat and a scarf", "hat scarf"),
    (Analyzer(stemmer="porter2"), "the boats were leaking", "the boat were leak"),
    (Analyzer.english(), "Maria’s boats", "maria s boat"),
    (Analyzer(fold_case=False), "N.A.T.O can't", "N A T O can t"),
]


@pytest.mark.parametrize("analyzer, text, expected", CASES)
def test_vectors(analyzer, text, expected):
    assert analyzer.analyze(text) == expected.split()


def test_columns_agree_with_strings(spark):
    for analyzer, text, expected in CASES:
        df = spark.createDataFrame([(text,), (None,)], "t string")
        from pyspark.sql import functions as F

        rows = [r[0] for r in df.select(analyzer.tokens(F.col("t"))).collect()]
        assert rows == [expected.split(), []]


def test_reserved_tokenizers():
    with pytest.raises(UnsupportedError):
        Analyzer(tokenizer="char_ngram")


@pytest.mark.parametrize("word, expected", [("consistency", "consist"), ("knightly", "knight"), ("skies", "sky"), ("dying", "die"), ("happy", "happi"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("by", "by"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("agreed", "agre"), ("bed", "bed"), ("shed", "shed"), ("communism", "communism"), ("arsenal", "arsenal"), ("succeed", "succeed"), ("youth", "youth"), ("say", "say")])
def test_porter2(word, expected):
    assert stem(word) == expected


@settings(max_examples=200)
@given(st.text(alphabet="abcdefgilmnoprstuy'", min_size=0, max_size=14))
def test_stems_are_never_longer_by_more_than_an_e(word):
    assert len(stem(word)) <= len(word) + 1


@pytest.mark.parametrize("text, expected", [("हिन्दी Café", "हिन्दी café"), ("ΟΔΟΣ İKİ", "οδοσ iki"), ("Ⓐ x² Ⅷ a_b", "x² ⅷ a b")])
def test_marked_words(spark, text, expected):
    from pyspark.sql import functions as F

    marked = Analyzer(tokenizer="marked")
    assert marked.analyze(text) == expected.split() == spark.createDataFrame([(text,)], "t string").select(marked.tokens(F.col("t"))).first()[0]
