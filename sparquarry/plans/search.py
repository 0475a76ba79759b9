"""What to search for: one text channel, any number of vector channels, fusion, recency."""

from __future__ import annotations

import dataclasses

from ..functions.text import UnsupportedError
from ..operators.scorers import LOG, Scorer


@dataclasses.dataclass(frozen=True)
class Rrf:
    k: int = 60


@dataclasses.dataclass(frozen=True)
class Weighted:
    text: float = 0.5
    vector: float = 0.5


@dataclasses.dataclass(frozen=True)
class Range:
    start: int
    end: int


@dataclasses.dataclass(frozen=True)
class HalfLife:
    days: float


@dataclasses.dataclass(frozen=True)
class RrfChannel:
    """Newest first as a channel of its own.  The half-life is accepted and has no effect."""

    half_life_days: float
    weight: float = 1.0


def bm25(k1: float = 1.2, b: float = 0.75) -> Scorer:
    return Scorer("bm25", k1=k1, b=b)


def tfidf(tf: str = LOG, norm: str | None = None) -> Scorer:
    return Scorer("tfidf", tf=tf, norm=norm)


def tfidf_cosine(tf: str = LOG, exact: bool = True) -> Scorer:
    return Scorer("tfidf_cosine" if exact else "tfidf_cosine_approx", tf=tf)


def count_cosine(exact: bool = True) -> Scorer:
    return Scorer("count_cosine" if exact else "count_cosine_approx")


@dataclasses.dataclass(frozen=True)
class TextChannel:
    field: str
    query: str
    scorer: Scorer


@dataclasses.dataclass(frozen=True)
class VectorChannel:
    field: str
    query: tuple[float, ...]
    rerank: str = "full"
    channel_k: int | None = None


@dataclasses.dataclass(frozen=True)
class Search:
    """Immutable; every method gives a new search.  A second text() replaces the first."""

    text_channel: TextChannel | None = None
    vector_channels: tuple[VectorChannel, ...] = ()
    fusion: Rrf | Weighted = Rrf()
    recency_by: Range | HalfLife | RrfChannel | None = None
    k: int = 10
    now_at: int | None = None

    def text(self, field: str, query: str, scorer: Scorer | None = None) -> Search:
        return dataclasses.replace(self, text_channel=TextChannel(field, query, scorer or bm25()))

    def vector(self, field: str, query, rerank: str = "full", channel_k: int | None = None) -> Search:
        return dataclasses.replace(self, vector_channels=(*self.vector_channels, VectorChannel(field, tuple(float(x) for x in query), rerank, channel_k)))

    def accurate(self) -> Search:
        return dataclasses.replace(self, vector_channels=tuple(dataclasses.replace(v, rerank="full") for v in self.vector_channels))

    def fast(self) -> Search:
        return dataclasses.replace(self, vector_channels=tuple(dataclasses.replace(v, rerank="lossy") for v in self.vector_channels))

    def fuse(self, fusion: Rrf | Weighted) -> Search:
        return dataclasses.replace(self, fusion=fusion)

    def recency(self, by: Range | HalfLife | RrfChannel) -> Search:
        return dataclasses.replace(self, recency_by=by)

    def top_k(self, k: int) -> Search:
        return dataclasses.replace(self, k=k)

    def now(self, at: int) -> Search:
        return dataclasses.replace(self, now_at=at)

    def check(self) -> None:
        if self.text_channel is None and not self.vector_channels:
            raise ValueError("no channels")
        if isinstance(self.recency_by, RrfChannel) and isinstance(self.fusion, Weighted):
            raise UnsupportedError("a recency channel needs reciprocal-rank fusion")
