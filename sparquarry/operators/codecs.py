"""Polar vector codecs: rotation, QAM (amplitude and phase) and UPQ (rings of phases), sketches and distances.

Codes are BINARY columns written by Arrow UDFs; a code's sketch is one sign bit per
rotated component, ARRAY<BIGINT>, so candidates are found by XOR and bit_count in
the JVM and only they are decoded.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .vector_search import DIGITS, candidate_budget

#: Fixed values of the code format.
SIGN_SEED = 0x6C616D615F71616D
MAX_BLOCK, ALIGN, UPQ_CELLS, UPQ_BITS, UPQ_RINGS = 1024, 64, 2048, 11, (24, 28, 32, 40)
MASK = 2**64 - 1


class SplitMix64:
    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)


@functools.lru_cache(32)
def signs(dim: int) -> np.ndarray:
    """One sign a component: bits of successive draws, lowest first; a 0 bit is +1."""
    draw, out = SplitMix64(SIGN_SEED), []
    for start in range(0, dim, 64):
        bits = draw.next()
        out += [-1.0 if bits >> i & 1 else 1.0 for i in range(min(64, dim - start))]
    return np.array(out)


@functools.lru_cache(32)
def hadamard(n: int) -> np.ndarray:
    """The orthonormal Hadamard matrix of a power of two."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / math.sqrt(n)


def block_size(dim: int) -> int:
    return min(dim & -dim, MAX_BLOCK)


def rotate(x: np.ndarray) -> np.ndarray:
    """Signs, then the Hadamard transform of each block; rows are vectors."""
    n = block_size(x.shape[1])
    return ((x * signs(x.shape[1])).reshape(len(x), -1, n) @ hadamard(n)).reshape(x.shape)


def rotate_back(z: np.ndarray) -> np.ndarray:
    n = block_size(z.shape[1])
    return (z.reshape(len(z), -1, n) @ hadamard(n)).reshape(z.shape) * signs(z.shape[1])


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in np.atleast_1d(x)])


@functools.lru_cache(16)
def rayleigh_codebook(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(levels, inner boundaries) of the Lloyd-Max quantiser of a Rayleigh amplitude with scale 1."""
    n = 1 << bits
    grid = np.linspace(0, 8, 8192)
    mass = np.cumsum((grid * np.exp(-(grid**2) / 2)) ** (1 / 3))
    levels = np.interp((np.arange(n) + 0.5) / n, mass / mass[-1], grid)
    for _ in range(200):
        edges = np.r_[0.0, (levels[1:] + levels[:-1]) / 2, np.inf]
        lo, hi = edges[:-1], edges[1:]
        tail = lambda r: np.where(np.isinf(r), 0.0, np.exp(-(np.minimum(r, 1e3) ** 2) / 2))
        weight = tail(lo) - tail(hi)
        first = lo * tail(lo) - np.where(np.isinf(hi), 0.0, np.minimum(hi, 1e3)) * tail(hi) + math.sqrt(math.pi / 2) * (_erf(np.minimum(hi, 40) / math.sqrt(2)) - _erf(lo / math.sqrt(2)))
        new = np.where(weight > 1e-300, first / np.maximum(weight, 1e-300), levels)
        done = np.abs(new - levels).max() < 1e-10
        levels = new
        if done:
            break
    return levels, (levels[1:] + levels[:-1]) / 2


def pack_bits(values: np.ndarray, bits: int, align: int) -> np.ndarray:
    """Rows of whole numbers as bytes, lowest bit first, each row padded to a multiple of align."""
    flat = ((values[..., None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(len(values), -1)
    size = -(-flat.shape[1] // 8)
    out = np.zeros((len(values), -(-size // align) * align), np.uint8)
    out[:, :size] = np.packbits(flat, axis=1, bitorder="little")
    return out


def unpack_bits(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(raw, axis=1, bitorder="little")[:, : n * bits].reshape(len(raw), n, bits)
    return (flat.astype(np.int64) << np.arange(bits)).sum(2)


def pack_signs(positive: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words, lowest bit first."""
    padded = np.zeros((len(positive), -(-positive.shape[1] // 64) * 64), np.uint8)
    padded[:, : positive.shape[1]] = positive
    return np.packbits(padded, axis=1, bitorder="little").view(np.int64)


class Codec:
    """dim and sigma (one scale per pair of rotated components).  Subclasses give encode() and rotated()."""

    dim: int
    sigma: np.ndarray

    def pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = rotate(np.asarray(x, np.float64))
        return np.hypot(z[:, ::2], z[:, 1::2]) / self.sigma, np.arctan2(z[:, 1::2], z[:, ::2])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Unit vectors."""
        x = rotate_back(self.rotated(codes))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def distances(self, query: np.ndarray, codes: np.ndarray, metric: str = "cosine") -> np.ndarray:
        """Of a full-precision query to coded vectors, by the metric, as if those were of unit length."""
        q, y = rotate(np.asarray(query, np.float64)[None])[0], self.rotated(codes)
        dot, norm, qn = y @ q, np.maximum(np.linalg.norm(y, axis=1), 1e-12), np.linalg.norm(q)
        if metric == "cosine":
            return 1 - dot / (max(qn, 1e-12) * norm)
        return -dot / norm if metric == "dot" else qn**2 + 1 - 2 * dot / norm

    def fast_scores(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Query rounded to 8-bit integers against rounded tables; cosine order whatever the metric; smaller is nearer."""
        q = rotate(np.asarray(query, np.float64)[None])[0]
        scale = max(np.abs(q).max(), 1e-12) / 127
        y = self.rotated(codes)
        step = max(np.abs(y).max(), 1e-12) / 127
        dot = np.rint(y / step) @ np.rint(q / scale)
        return -dot * scale * step / np.maximum(np.linalg.norm(y, axis=1), 1e-12)

    def query_sketch(self, query: np.ndarray) -> list[int]:
        return pack_signs(rotate(np.asarray(query, np.float64)[None]) >= 0)[0].tolist()


@dataclasses.dataclass(frozen=True)
class Qam(Codec):
    """Amplitude and phase of each pair of rotated components, amp_bits and phase_bits each."""

    dim: int
    amp_bits: int
    phase_bits: int
    sigma: np.ndarray = dataclasses.field(repr=False)

    family = "qam"

    def __post_init__(self):
        if not (1 <= self.amp_bits <= 8 and 1 <= self.phase_bits <= 8):
            raise ValueError("amp_bits and phase_bits must be from 1 to 8")
        if self.dim % 2:
            raise ValueError("dim must be even")

    @staticmethod
    def scales(total: np.ndarray, n: int) -> np.ndarray:
        return np.maximum(total / max(n, 1) / math.sqrt(math.pi / 2), 1e-12)

    @functools.cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        angle = (2 * np.pi * np.arange(1 << self.phase_bits) / (1 << self.phase_bits)).astype(np.float32)
        return np.cos(angle), np.sin(angle)

    def _split(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.dim // 2
        amp = -(-n * self.amp_bits // 8 // ALIGN) * ALIGN if (n * self.amp_bits) % (8 * ALIGN) == 0 else (n * self.amp_bits // (8 * ALIGN) + 1) * ALIGN
        return unpack_bits(codes[:, :amp], n, self.amp_bits), unpack_bits(codes[:, amp:], n, self.phase_bits)

    def encode(self, x: np.ndarray) -> np.ndarray:
        a, theta = self.pairs(x)
        n = 1 << self.phase_bits
        amp = np.searchsorted(rayleigh_codebook(self.amp_bits)[1], a)
        phase = np.rint(theta * n / (2 * np.pi)).astype(np.int64) % n
        return np.hstack([pack_bits(amp, self.amp_bits, ALIGN), pack_bits(phase, self.phase_bits, ALIGN)])

    def rotated(self, codes: np.ndarray) -> np.ndarray:
        amp, phase = self._split(codes)
        a = rayleigh_codebook(self.amp_bits)[0][amp] * self.sigma
        out = np.empty((len(codes), self.dim))
        out[:, ::2], out[:, 1::2] = a * self._table[0][phase], a * self._table[1][phase]
        return out

    def sketches(self, codes: np.ndarray) -> np.ndarray:
        _, phase = self._split(codes)
        bits = np.empty((len(codes), self.dim), bool)
        bits[:, ::2], bits[:, 1::2] = self._table[0][phase] >= 0, self._table[1][phase] >= 0
        return pack_signs(bits)

    def to_json(self) -> str:
        return json.dumps({"family": self.family, "dim": self.dim, "amp_bits": self.amp_bits, "phase_bits": self.phase_bits, "sigma": self.sigma.tolist()})


@dataclasses.dataclass(frozen=True)
class UpqDesign:
    radii: np.ndarray
    phases: np.ndarray
    cost: float


def fit_upq(radii: np.ndarray, rings: tuple[int, ...] = UPQ_RINGS, cells: int = UPQ_CELLS, rounds: int = 300) -> UpqDesign:
    """Rings with power-of-two phases for a sample of normalised amplitudes, by alternation; the best number of rings wins."""
    r = np.sort(np.asarray(radii, np.float64))
    best = None
    for n in rings:
        # rings start evenly over the amplitudes, which the cube root of the density is near to
        centre = (np.arange(n) + 0.5) / n * r[-1 - len(r) // 5000]
        phases = np.full(n, 64)
        for _ in range(rounds):
            edges = np.searchsorted(r, (centre[1:] + centre[:-1]) / 2)
            start, end = np.r_[0, edges], np.r_[edges, len(r)]
            count = end - start
            sums, squares = np.r_[0, np.cumsum(r)], np.r_[0, np.cumsum(r**2)]
            s1, s2 = sums[end] - sums[start], squares[end] - squares[start]
            mean = np.where(count > 0, s1 / np.maximum(count, 1), centre)

            def error(p):
                # best radius for p phases is sinc times the mean amplitude
                shrink = np.sinc(1.0 / p)
                return s2 - count * (shrink * mean) ** 2

            phases = np.full(n, 4)
            while True:  # the doubling that gains most per phase
                gain = np.where(phases + phases.sum() <= cells, (error(phases) - error(2 * phases)) / phases, -1)
                at = int(gain.argmax())
                if gain[at] <= 0:
                    break
                phases[at] *= 2
            new = np.sort(np.sinc(1.0 / phases) * mean)
            if np.abs(new - centre).max() < 1e-7:
                break
            centre = new
        order = np.argsort(centre)
        centre, phases = centre[order], phases[order]
        for _ in range(40):  # phases stay; rings move to where their own amplitudes want them
            ring = _ring(r, centre, phases)
            count = np.bincount(ring, minlength=n)
            mean = np.where(count > 0, np.bincount(ring, r, n) / np.maximum(count, 1), centre)
            centre = np.sinc(1.0 / phases) * mean
        order = np.argsort(centre)
        centre, phases = centre[order], phases[order]
        ring = _ring(r, centre, phases)
        shrink = np.sinc(1.0 / phases)
        cost = float(np.mean(r**2 + centre[ring] ** 2 - 2 * r * centre[ring] * shrink[ring]))
        if best is None or cost < best.cost:
            best = UpqDesign(centre, phases, cost)
    return best


def _ring(r: np.ndarray, centre: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """The ring of least expected error for each amplitude."""
    shrink, out = np.sinc(1.0 / phases), np.empty(np.shape(r), np.int64)
    flat, res = np.ravel(r), np.ravel(out)
    for a in range(0, len(flat), 1 << 16):
        x = flat[a : a + (1 << 16), None]
        res[a : a + (1 << 16)] = (centre**2 - 2 * x * centre * shrink).argmin(1)
    return res.reshape(np.shape(r))


def rayleigh_quantiles(n: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(1 - (np.arange(n) + 0.5) / n))


@dataclasses.dataclass(frozen=True)
class Upq(Codec):
    """Each pair of rotated components is one of up to 2048 cells: a phase of a ring; 11 bits a pair."""

    dim: int
    design: UpqDesign
    sigma: np.ndarray = dataclasses.field(repr=False)

    family = "upq"

    @property
    def stride(self) -> int:
        return -(-(-(-UPQ_BITS * (self.dim // 2) // 8) + 4) // 16) * 16

    @functools.cached_property
    def _cells(self) -> tuple[np.ndarray, np.ndarray]:
        radius = np.repeat(self.design.radii, self.design.phases)
        base = np.cumsum(self.design.phases) - self.design.phases
        k = np.arange(len(radius)) - np.repeat(base, self.design.phases)
        angle = (2 * np.pi * k / np.repeat(self.design.phases, self.design.phases)).astype(np.float32)
        return (radius * np.cos(angle)).astype(np.float32), (radius * np.sin(angle)).astype(np.float32)

    def encode(self, x: np.ndarray) -> np.ndarray:
        a, theta = self.pairs(x)
        ring = _ring(a, self.design.radii, self.design.phases)
        n = self.design.phases[ring]
        cell = (np.cumsum(self.design.phases) - self.design.phases)[ring] + np.rint(theta * n / (2 * np.pi)).astype(np.int64) % n
        packed = pack_bits(cell, UPQ_BITS, 1)
        return np.pad(packed, ((0, 0), (0, self.stride - packed.shape[1])))

    def _index(self, codes: np.ndarray) -> np.ndarray:
        return unpack_bits(codes, self.dim // 2, UPQ_BITS)

    def rotated(self, codes: np.ndarray) -> np.ndarray:
        cell, out = self._index(codes), np.empty((len(codes), self.dim))
        out[:, ::2], out[:, 1::2] = self._cells[0][cell] * self.sigma, self._cells[1][cell] * self.sigma
        return out

    def sketches(self, codes: np.ndarray) -> np.ndarray:
        cell, bits = self._index(codes), np.empty((len(codes), self.dim), bool)
        bits[:, ::2], bits[:, 1::2] = self._cells[0][cell] >= 0, self._cells[1][cell] >= 0
        return pack_signs(bits)

    def to_json(self) -> str:
        return json.dumps({"family": self.family, "dim": self.dim, "radii": self.design.radii.tolist(), "phases": self.design.phases.tolist(), "cost": self.design.cost, "sigma": self.sigma.tolist()})


def from_json(text: str) -> Codec:
    d = json.loads(text)
    if d["family"] == "qam":
        return Qam(d["dim"], d["amp_bits"], d["phase_bits"], np.array(d["sigma"]))
    if d["family"] == "upq":
        return Upq(d["dim"], UpqDesign(np.array(d["radii"]), np.array(d["phases"]), d["cost"]), np.array(d["sigma"]))
    raise ValueError(f"codec family {d['family']} is not supported")


def amplitude_scales(vectors: DataFrame, dim: int) -> np.ndarray:
    """sigma of every pair, from partial sums of each task; one row per task reaches the driver's aggregate."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dim // 2), 0
        for f in frames:
            if len(f):
                z = rotate(np.stack(f["embedding"]).astype(np.float64))
                total += np.hypot(z[:, ::2], z[:, 1::2]).sum(0)
                n += len(f)
        yield pd.DataFrame({"at": range(dim // 2), "total": total, "n": n})

    rows = vectors.where(V.usable(F.col("embedding"), dim)).select("embedding").mapInPandas(partial, "at int, total double, n long")
    found = rows.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").toPandas()
    return Qam.scales(found["total"].to_numpy(), int(found["n"].iloc[0]))


def calibrate_qam(vectors: DataFrame, dim: int, amp_bits: int = 5, phase_bits: int = 6) -> Qam:
    return Qam(dim, amp_bits, phase_bits, amplitude_scales(vectors, dim))


def calibrate_upq(vectors: DataFrame, dim: int, quantiles: int = 50_000) -> Upq:
    """Scales from all vectors; the rings fit the amplitudes' Rayleigh law."""
    return Upq(dim, fit_upq(rayleigh_quantiles(quantiles)), amplitude_scales(vectors, dim))


def encode_column(codec: Codec, embedding: Column) -> Column:
    """struct<code: binary, sketch: array<bigint>>"""

    @F.pandas_udf("code binary, sketch array<long>")
    def encode(part: pd.Series) -> pd.DataFrame:
        codes = codec.encode(np.stack(part)) if len(part) else np.zeros((0, 1), np.uint8)
        return pd.DataFrame({"code": [c.tobytes() for c in codes], "sketch": list(codec.sketches(codes)) if len(part) else []})

    return encode(embedding)


def encode_table(vectors: DataFrame, codec: Codec) -> DataFrame:
    """vectors without the embedding, with code and sketch."""
    rows = vectors.where(V.usable(F.col("embedding"), codec.dim)).withColumn("__e", encode_column(codec, F.col("embedding")))
    return rows.select(*[c for c in vectors.columns if c != "embedding"], F.col("__e.code").alias("code"), F.col("__e.sketch").alias("sketch"))


def _matrix(part: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1)


def decode_column(codec: Codec, code: Column) -> Column:
    @F.pandas_udf("array<float>")
    def decode(part: pd.Series) -> pd.Series:
        return pd.Series(list(codec.decode(_matrix(part)).astype(np.float32))) if len(part) else pd.Series([], dtype=object)

    return decode(code)


def code_search(coded: DataFrame, codec: Codec, query: list[float], k: int = 10, total: int | None = None, channel_k: int | None = None, metric: str = "cosine", rerank: str = "full", scope=None) -> DataFrame:
    """vector_id, distance: Hamming candidates in the JVM, then "lossy" (8-bit) or "full" (8-bit, then exact among 3 k) reranking.

    scope is applied before the candidate budget, so a narrow scope never goes short.
    """
    q = np.asarray(query, np.float64)
    rows = coded if scope is None else coded.where(scope)
    total = rows.count() if total is None else total
    sketch = F.array(*[F.lit(w) for w in codec.query_sketch(q)])
    cand = rows.withColumn("hamming", V.hamming(F.col("sketch"), sketch)).orderBy("hamming", "vector_id").limit(candidate_budget(k, total, channel_k))

    def scored(f):
        @F.pandas_udf("double")
        def score(part: pd.Series) -> pd.Series:
            return pd.Series(f(_matrix(part))) if len(part) else pd.Series([], dtype=float)

        return score(F.col("code"))

    fast = cand.select("vector_id", "code", F.round(scored(lambda c: codec.fast_scores(q, c)), DIGITS).alias("distance"))
    pool = fast.orderBy("distance", "vector_id").limit(3 * k if rerank == "full" else k)
    if rerank == "full":
        pool = pool.select("vector_id", "code", F.round(scored(lambda c: codec.distances(q, c, metric)), DIGITS).alias("distance"))
    return pool.select("vector_id", "distance").orderBy("distance", "vector_id").limit(k)
