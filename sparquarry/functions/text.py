"""Text analysis: normalise, tokenise, fold, strip possessives, drop stopwords, stem, filter by length.

An Analyzer without Unicode normalisation, accent folding and stemming is a plain
column expression; the other steps run as one Arrow UDF over whole batches.
"""

from __future__ import annotations

import dataclasses
import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter2 import stem

#: The 33 stopwords of the English preset.
STOPWORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()

WORDS, MARKED, WHITESPACE = "words", "marked", "whitespace"
#: Runs by tokenizer: alphanumeric characters; letters, marks and numbers, as SQL takes them.
JAVA_RUNS = {WORDS: "([\\p{IsAlphabetic}\\p{N}]+)", MARKED: "([\\p{L}\\p{M}\\p{N}]+)"}


class UnsupportedError(ValueError):
    """What the engine knows of but doesn't offer."""


@dataclasses.dataclass(frozen=True)
class Analyzer:
    """The steps in their fixed order.  form: None, "NFC" or "NFKC"; lengths in characters of the stem, 0 = no limit."""

    form: str | None = None
    tokenizer: str = WORDS
    fold_case: bool = True
    fold_accents: bool = False
    possessive: bool = False
    stopwords: tuple[str, ...] = ()
    stemmer: str | None = None
    min_length: int = 0
    max_length: int = 0

    def __post_init__(self):
        if self.tokenizer in ("char_ngram", "token_shingle"):
            raise UnsupportedError(f"tokenizer {self.tokenizer} is reserved")
        if self.tokenizer not in (WORDS, MARKED, WHITESPACE):
            raise ValueError(f"unknown tokenizer {self.tokenizer}")
        if self.form not in (None, "NFC", "NFKC") or self.stemmer not in (None, "porter2"):
            raise ValueError("unknown normalisation form or stemmer")

    @classmethod
    def english(cls) -> Analyzer:
        return cls("NFKC", WORDS, True, False, True, tuple(STOPWORDS), "porter2", 1, 64)

    @classmethod
    def raw(cls) -> Analyzer:
        return cls(tokenizer=WHITESPACE, fold_case=False)

    @property
    def is_expression(self) -> bool:
        return not (self.form or self.fold_accents or self.stemmer)

    def tokens(self, text: Column) -> Column:
        """array<string> of tokens; null text gives an empty array."""
        text = F.coalesce(text, F.lit(""))
        if not self.is_expression:
            return _udf(self)(text)
        if self.fold_case and self.tokenizer == MARKED:  # letter by letter, as SQL's lower: no final sigma, one letter for İ
            text = F.when(text.contains("İ") | text.contains("Σ"), F.translate(text, "İΣ", "iσ")).otherwise(text)
        out = F.lower(text) if self.fold_case else text
        out = F.regexp_extract_all(out, F.lit(JAVA_RUNS[self.tokenizer]), F.lit(1)) if self.tokenizer in JAVA_RUNS else F.filter(F.split(out, "(?U)\\s+"), lambda t: t != "")
        if self.possessive:
            out = F.transform(out, lambda t: F.regexp_replace(t, "['’][sS]$", ""))
        if self.stopwords:
            stop = F.array(*[F.lit(w) for w in self.stopwords])
            out = F.filter(out, lambda t: ~F.array_contains(stop, t))
        if self.min_length or self.max_length:
            out = F.filter(out, lambda t: self.fits(F.char_length(t)))
        return F.filter(out, lambda t: t != "")

    def fits(self, n: Column) -> Column:
        low = n >= self.min_length
        return low & (n <= self.max_length) if self.max_length else low

    def analyze(self, text: str) -> list[str]:
        """The same on one string, for query texts."""
        if self.form:
            text = unicodedata.normalize(self.form, text)
        if self.fold_case and self.tokenizer == MARKED:
            text = text.replace("İ", "i")
        found = _word_runs(text, self.tokenizer == MARKED) if self.tokenizer in JAVA_RUNS else text.split()
        out = []
        for t in found:
            if self.fold_case:
                t = t.lower() if "Σ" not in t else "".join(c.lower() for c in t)  # letter by letter: no final sigma
            if self.fold_accents:
                t = fold_accents(t)
            if self.possessive:
                t = re.sub("['’][sS]$", "", t)
            if t in self._stop:
                continue
            if self.stemmer:
                t = stem(t)
            n = len(t)
            if n and n >= self.min_length and (not self.max_length or n <= self.max_length):
                out.append(t)
        return out

    @functools.cached_property
    def _stop(self) -> frozenset:
        return frozenset(self.stopwords)


PLAIN_RUNS = re.compile(r"[^\W_]+")


def _word_runs(text: str, marked: bool = False) -> list[str]:
    if text.isascii() or (text and max(text) < "\u0300"):  # no combining marks there
        return PLAIN_RUNS.findall(text)
    out, run = [], []
    for c in text:
        if unicodedata.category(c)[0] in "LMN" if marked else c.isalnum() or unicodedata.category(c) in ("Mn", "Mc") and _alphabetic_mark(c):
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    if run:
        out.append("".join(run))
    return out


def _alphabetic_mark(c: str) -> bool:
    """Dependent vowel signs count as letters; combining accents don't."""
    return unicodedata.combining(c) == 0


def fold_accents(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


@functools.lru_cache(64)
def _udf(analyzer: Analyzer):
    @F.pandas_udf("array<string>")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(analyzer.analyze)

    return tokens


def normalise(text: Column, form: str) -> Column:
    """Unicode normalisation of a string column."""

    @F.pandas_udf("string")
    def apply(part: pd.Series) -> pd.Series:
        return part.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return apply(text)


def stem_column(term: Column) -> Column:
    """Porter2 stems of a column of single terms; run it over distinct terms."""

    @F.pandas_udf("string")
    def apply(part: pd.Series) -> pd.Series:
        return part.map(lambda t: None if t is None else stem(t))

    return apply(term)
