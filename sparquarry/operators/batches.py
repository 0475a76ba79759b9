"""Many queries against many vectors as matrices: each task's k nearest of every query.

Distances are first had to within a stated error by matrix products; only pairs that
this error lets into the k nearest are computed again in doubles, component after
component as the SQL does, rounded, and ranked with ties to the smaller id.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Queries that go to the vectors at once; entries of a matrix of distances; components of pairs computed again at once.
QUERIES, ENTRIES, COMPONENTS = 65_536, 1 << 20, 1 << 22
FOUND = "query_id long, vector_id long, distance double"
#: Stands for a null id, which comes after all others.
NO_ID = np.iinfo(np.int64).max
#: How distances are ordered: numbers, no numbers, null; places that hold nothing yet.
NUMBER, NAN, NULL, FREE = range(4)
NULL_KIND = 3


def _ids(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


@dataclasses.dataclass
class Vectors:
    """Ids and rows of doubles.

    kind: 0 plain; 1 of a norm near the ends of doubles; 2 zero or with components that are no finite
    numbers; 3 null, of another dimension or with null components.
    """

    ids: np.ndarray
    x: np.ndarray
    norm2: np.ndarray
    kind: np.ndarray

    def at(self, some: np.ndarray) -> Vectors:
        return Vectors(self.ids[some], self.x[some], self.norm2[some], self.kind[some])

    @property
    def unit(self) -> np.ndarray:
        return (self.x / np.sqrt(self.norm2)[:, None]).astype(np.float32)


def vectors_of(ids: np.ndarray, column: pa.ListArray, dim: int) -> Vectors:
    n = len(column)
    offsets, values = column.offsets.to_numpy(), column.values
    good = np.diff(offsets) == dim
    good &= ~column.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    at = offsets[:-1][rows][:, None] + np.arange(dim)
    x = np.zeros((n, dim))
    if len(rows):
        if values.null_count:
            lost = values.is_null().to_numpy(zero_copy_only=False)[at].any(1)
            good[rows[lost]] = False
            values = values.fill_null(0.0)
        x[rows] = values.to_numpy()[at]
    with np.errstate(all="ignore"):
        norm2 = in_order(x * x)
    kind = np.where((norm2 > 1e-290) & (norm2 < 1e290), 0, 1)
    rare = np.flatnonzero(kind)
    kind[rare[~np.isfinite(x[rare]).all(1) | ~x[rare].any(1)]] = 2
    kind[~good] = NULL_KIND
    return Vectors(ids, x, norm2, kind)


def query_passes(ids: pa.ChunkedArray, embeddings: pa.ChunkedArray) -> list[Vectors]:
    """The queries by dimension, in passes of a bounded number."""
    ids, embeddings = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (ids, embeddings))
    sizes = np.where(embeddings.is_null().to_numpy(zero_copy_only=False), -1, np.diff(embeddings.offsets.to_numpy()))
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        for at in range(0, len(rows), QUERIES):
            some = pa.array(rows[at : at + QUERIES])
            q = vectors_of(_ids(ids.take(some)), embeddings.take(some), max(int(dim), 0))
            out.append(q.at(np.argsort(q.kind, kind="stable")))
    return out


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows, component after component."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL's round; never -0."""
    y = d * 10.0**digits
    whole = np.trunc(y)
    whole += np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0.0)
    out = whole / 10.0**digits
    return np.where(np.isfinite(out), out, d) + 0.0


def distances(q: Vectors, rows: np.ndarray, v: Vectors, cols: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Rounded distances of pairs."""
    out, step = np.empty(len(rows)), max(1, COMPONENTS // max(1, q.x.shape[1]))
    for at in range(0, len(rows), step):
        r, c = rows[at : at + step], cols[at : at + step]
        if metric == "l2":
            d = in_order((v.x[c] - q.x[r]) ** 2)
        else:
            dot = in_order(v.x[c] * q.x[r])
            d = -dot if metric == "dot" else 1 - dot / (np.sqrt(v.norm2[c]) * np.sqrt(q.norm2[r]))
        out[at : at + step] = rounded(d, digits)
    return out


def _first_copies(v: Vectors, k: int) -> Vectors:
    """Of equal vectors the k of smallest ids: others are among no query's k nearest."""
    same = np.zeros(len(v.ids), np.int64)
    if v.x.size:
        rows = np.ascontiguousarray(v.x).view(np.dtype((np.void, v.x.itemsize * v.x.shape[1]))).ravel()
        same = np.unique(rows, return_inverse=True)[1]
    order = np.lexsort((v.ids, same))
    s = same[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    place = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    return v.at(np.sort(order[place < k]))


def _smallest(v: Vectors, k: int) -> Vectors:
    return v.at(np.argsort(v.ids, kind="stable")[:k])


class Nearest:
    """The k nearest so far of each query."""

    def __init__(self, queries: Vectors, k: int, metric: str, digits: int):
        self.q, self.k, self.metric, self.digits = queries, k, metric, digits
        n = len(queries.ids)
        self.d, self.rank, self.ids = np.full((n, k), np.inf), np.full((n, k), FREE, np.int8), np.full((n, k), NO_ID)
        self.minus = -queries.at(np.flatnonzero(queries.kind == 0)).unit if metric == "cosine" else None  # plain queries come first

    def offer(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray | None) -> None:
        """Pairs of queries and ids with their distances; None: null."""
        if not len(rows):
            return
        some, back = np.unique(rows, return_inverse=True)
        rank = np.full(len(rows), NULL, np.int8) if d is None else np.where(np.isnan(d), NAN, NUMBER).astype(np.int8)
        d = np.zeros(len(rows)) if d is None else np.where(np.isnan(d), 0.0, d)
        row = np.r_[np.repeat(np.arange(len(some)), self.k), back]
        d, rank, ids = np.r_[self.d[some].ravel(), d], np.r_[self.rank[some].ravel(), rank], np.r_[self.ids[some].ravel(), ids]
        order = np.lexsort((ids, d, rank, row))
        starts = np.searchsorted(row[order], np.arange(len(some)))
        best = order[starts[:, None] + np.arange(self.k)]
        self.d[some], self.rank[some], self.ids[some] = d[best], rank[best], ids[best]

    def _all(self, rows: np.ndarray, v: Vectors) -> None:
        """Each query of rows with each vector, computed in doubles."""
        step = max(1, ENTRIES // max(1, len(v.ids)))
        for at in range(0, len(rows) if len(v.ids) else 0, step):
            some = rows[at : at + step]
            r, c = np.repeat(some, len(v.ids)), np.tile(np.arange(len(v.ids)), len(some))
            self.offer(r, v.ids[c], distances(self.q, r, v, c, self.metric, self.digits))

    def _null(self, rows: np.ndarray, v: Vectors) -> None:
        ids = np.sort(v.ids)[: self.k]
        self.offer(np.repeat(rows, len(ids)), np.tile(ids, len(rows)), None)

    def _plain(self, n: int, v: Vectors) -> None:
        """The first n queries with vectors, by matrix products."""
        dim, k = v.x.shape[1], self.k
        unit, less = (v.unit.T, 1.0) if self.metric == "cosine" else (None, 0.0)
        most = np.sqrt(v.norm2.max())
        step = max(1, ENTRIES // len(v.ids))
        for at in range(0, n, step):
            rows = slice(at, min(n, at + step))
            if unit is not None:
                near, error = self.minus[rows] @ unit, np.full(rows.stop - at, (dim + 8) * 2.0**-23)
            else:
                near, norm2 = -(self.q.x[rows] @ v.x.T), self.q.norm2[rows]
                error = (dim + 8) * 2.0**-50 * np.sqrt(norm2) * most
                if self.metric == "l2":
                    near, error = norm2[:, None] + v.norm2 + 2 * near, (dim + 8) * 2.0**-50 * (np.sqrt(norm2) + most) ** 2
            # near is the distance, less 1 for cosines; rounding makes a tie of what is less than its step apart
            full = self.rank[rows, -1] == NUMBER
            limit = np.where(full, self.d[rows, -1] - less, np.inf)
            if not full.all() and len(v.ids) > k:
                limit[~full] = np.partition(near[~full], k - 1, axis=1)[:, k - 1].astype(float) + error[~full]
            limit += 10.0**-self.digits + error
            above = limit.astype(near.dtype)
            r, c = np.divmod(np.flatnonzero(near <= np.nextafter(above, np.array(np.inf, near.dtype))[:, None]), len(v.ids))
            self.offer(r + at, v.ids[c], distances(self.q, r + at, v, c, self.metric, self.digits))

    def meet(self, v: Vectors) -> None:
        kinds = lambda x: [np.flatnonzero(x.kind == kind) for kind in range(4)]
        plain, odd, lost, null = kinds(self.q)
        v_plain, v_odd, v_lost, v_null = (v.at(some) for some in kinds(v))
        v_plain, v_odd, v_lost = (_first_copies(x, self.k) for x in (v_plain, v_odd, v_lost))
        if len(plain) and len(v_plain.ids):
            self._plain(len(plain), v_plain)
        self._all(odd, v_plain)
        self._all(np.r_[plain, odd], v_odd)
        if self.metric == "cosine":  # theirs are no numbers
            self._all(np.r_[plain, odd], _smallest(v_lost, self.k))
            self._all(lost, _smallest(v.at(np.flatnonzero(v.kind < NULL_KIND)), self.k))
        else:
            self._all(np.r_[plain, odd], v_lost)
            for x in (v_plain, v_odd, v_lost):
                self._all(lost, x)
        self._null(np.r_[plain, odd, lost], v_null)
        self._null(null, v)

    def found(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.q.ids), 8192):
            r, c = np.nonzero(self.rank[at : at + 8192] != FREE)
            r += at
            qid, ids, d = self.q.ids[r], self.ids[r, c], np.where(self.rank[r, c] == NAN, np.nan, self.d[r, c])
            yield pa.RecordBatch.from_arrays([pa.array(qid, mask=qid == NO_ID), pa.array(ids, mask=ids == NO_ID), pa.array(d, mask=self.rank[r, c] == NULL, from_pandas=False)], names=["query_id", "vector_id", "distance"])


def best_of(queries: Vectors, k: int, metric: str, digits: int):
    """For mapInArrow over (vector_id, embedding): the k nearest of each query among a task's vectors."""
    dim = queries.x.shape[1]

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            nearest = Nearest(queries, k, metric, digits)
            for part in parts:
                if part.num_rows:
                    nearest.meet(vectors_of(_ids(part.column(0)), part.column(1), dim))
            yield from nearest.found()

    return best
